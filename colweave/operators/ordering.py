"""Dense row numbers without a single sorting task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a local master without one gets its own."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def with_row_number(df: DataFrame, order_by: list, name: str = "row") -> DataFrame:
    """df with its row numbers, 0 to n - 1, in the order of order_by.

    A range-partitioned sort is written once; its partitions' sizes, one row each, give the
    number of the first row of every partition. Rows that tie get some order that stays.
    """
    placed = _settle(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a partition: the running sum is a window over a small table, by its nature in one task.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    return placed.join(first, "_part").withColumn(name, F.col("_first") + F.col("_in")).drop("_at", "_part", "_in", "_first")


def append_indices(selection: DataFrame, more: DataFrame, name: str = "at") -> DataFrame:
    """(place, name): the entries of a selection vector, in their order, then those of more in row order.

    selection and more have columns row and name, as packed outputs do; selection may be what this returns, with place for row.
    """
    old = selection.select(F.lit(0).alias("_side"), F.col("place" if "place" in selection.columns else "row").alias("_key"), F.col(name))
    new = more.select(F.lit(1).alias("_side"), F.col("row").alias("_key"), F.col(name))
    return with_row_number(old.unionByName(new), ["_side", "_key"], "place").select("place", name)
