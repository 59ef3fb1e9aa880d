"""Inputs and outputs: Parquet tables, Arrow, pandas, NumPy, and the ways a null can be written down."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import BY_NAME, DType


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table; Spark reads only the columns that are used."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def from_arrow(spark: SparkSession, data: pa.Table | pa.RecordBatch | Mapping[str, pa.Array]) -> DataFrame:
    """Arrow data of any chunking and offset; validity becomes null. Unsigned columns widen."""
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    elif not isinstance(data, pa.Table):
        data = pa.table(dict(data))
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20)}
    fields = [pa.field(f.name, wider.get(f.type, f.type), f.nullable) for f in data.schema]
    return spark.createDataFrame(data.cast(pa.schema(fields)))


def from_numpy(spark: SparkSession, columns: Mapping[str, Any], masks: Mapping[str, Any] | None = None, *, true_means_null: bool = True) -> DataFrame:
    """Equal-length arrays or buffers; masks, bytes or packed bits, mark nulls of the columns they name."""
    out = {}
    sizes = {len(np.asarray(v)) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns differ in length: {sorted(sizes)}")
    for name, values in columns.items():
        values = np.asarray(values)
        null = None
        if masks and name in masks:
            null = np.asarray(masks[name])
            if null.dtype == np.uint8 and len(null) < len(values):
                null = np.unpackbits(null, bitorder="little")[: len(values)]
            null = null.astype(bool) == true_means_null
        out[name] = pa.array(values, mask=null)
    return from_arrow(spark, out)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(frame)


def with_mask(value: Column, mask: Column, *, true_means_null: bool = True) -> Column:
    """A value and its null mask, of either polarity, as one nullable column."""
    return F.when(~mask if true_means_null else mask, value)


def with_bitmap(value: Column, bitmap: Column, row: Column, *, true_means_null: bool = False) -> Column:
    """A value whose mask is bit row % 8 of byte row / 8 in a binary column."""
    byte = F.conv(F.hex(F.substring(bitmap, (row / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (row % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return with_mask(value, bit, true_means_null=true_means_null)


def with_sentinel(value: Column, sentinel: Any) -> Column:
    """A value that stands for null, as null."""
    return F.when(value != sentinel, value)


def to_sentinel(value: Column, sentinel: Any) -> Column:
    return F.coalesce(value, F.lit(sentinel))


def to_mask(value: Column, *, true_means_null: bool = True) -> Column:
    return value.isNull() if true_means_null else value.isNotNull()


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_numpy(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns as arrays; NumPy has no nulls, so a null is an error."""
    data = df.toArrow()
    for name in data.column_names:
        if data[name].null_count:
            raise ValueError(f"column {name!r} has nulls, which a NumPy array cannot hold")
    return {name: data[name].to_numpy() for name in data.column_names}


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def run_into(result, buffers: Mapping[str, np.ndarray]) -> None:
    """Write outputs into caller's arrays, which must have the lengths of the outputs."""
    for name, buffer in buffers.items():
        values = result[name]
        values = np.asarray(values if isinstance(values, list) else [values])
        if len(values) != len(buffer):
            raise ValueError(f"{name!r} has {len(values)} values for {len(buffer)} places")
        buffer[:] = values


def numpy_type(t: DType) -> np.dtype:
    return np.dtype({"i": "int", "u": "uint", "f": "float"}[t.name[0]] + str(t.width) if t in BY_NAME.values() and t.width > 1 else "bool")
