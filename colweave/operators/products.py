"""Wrapping integer products, which Spark has no aggregate for.

Each partition multiplies its rows in numpy, by group, and sends one factor per
group; the factors of a group, as many as partitions, are multiplied in the JVM.
Multiplication modulo 2^64 is associative, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def products(rows: DataFrame, factors: list[str], key: str | None = None) -> DataFrame:
    """Bigint products modulo 2^64 of the factor columns, nulls skipped, by the key column or of all rows."""
    names = [key] * bool(key) + factors

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            frame = pd.DataFrame({n: batch.column(n).fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64) for n in factors})
            by = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(batch.num_rows, np.int64)
            order = np.argsort(by, kind="stable")
            keys, starts = np.unique(by[order], return_index=True)
            if not len(keys):
                continue
            part = pd.DataFrame({n: np.multiply.reduceat(frame[n].to_numpy()[order], starts) for n in factors}, index=keys)
            if held is None:
                held = part
            else:
                everyone = held.index.union(part.index)
                held = held.reindex(everyone, fill_value=1).astype(np.int64) * part.reindex(everyone, fill_value=1).astype(np.int64)
        if held is not None:
            columns = [pa.array(held.index.to_numpy(), pa.int64())] * bool(key) + [pa.array(held[n].to_numpy(), pa.int64()) for n in factors]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{n}` bigint" for n in names)
    parts = rows.select(names).mapInArrow(partial, schema)
    whole = parts.groupBy(*[key] * bool(key)).agg(*[F.collect_list(n).alias(n) for n in factors])
    times = [F.aggregate(n, F.lit(1).cast("bigint"), lambda a, b: a * b).alias(n) for n in factors]
    return whole.select(*[key] * bool(key), *times)
