"""Connected components by repeated contraction, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, settle


def _mix(x: Column) -> Column:
    """A bijection on longs whose order looks random, so that long chains of ids contract fast: a Feistel network of hashes."""
    low = F.lit(0xFFFFFFFF)
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(low)
    for key in range(3):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(key)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, root) for every id that has a link to another.

    All ids of one component share a root; the root is an opaque long. Each round
    hangs every node on its smallest neighbour, halves the resulting trees' depth
    and keeps only links between different trees, so the graph shrinks
    geometrically. Self links, repeated links and nulls are ignored; no edges
    give no rows.
    """
    links = edges.select(_mix(F.col("a")).alias("u"), _mix(F.col("b")).alias("v")).where("u <> v")
    links = settle(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    nodes = edges.select("a").union(edges.select("b")).where("a is not null").distinct()
    label = nodes.select(F.col("a").alias("node"), _mix(F.col("a")).alias("root"))
    first = True
    while not is_empty(links):
        hung = links.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        above = hung.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hung = settle(hung.join(above, "p").select("u", F.col("q").alias("p")))
        at_u = links.join(hung, "u").select(F.col("p").alias("u"), "v")
        at_v = at_u.join(hung.select(F.col("u").alias("v"), F.col("p").alias("q")), "v")
        links = settle(at_v.select("u", F.col("q").alias("v")).where("u <> v").distinct())
        step = hung.select(F.col("u").alias("root"), F.col("p").alias("next"))
        label = label.join(step, "root", "inner" if first else "left").select(
            "node", F.coalesce("next", "root").alias("root")
        )
        first = False
    if first:
        return label.where("false")
    return settle(label)


class Labels:
    """Components of a shard's members, merged by arrays of pairs; a root is its least member."""

    def __init__(self, n: int) -> None:
        self.at = np.arange(n)

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.at[p], self.at[q]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.at, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.at[self.at], self.at):
                self.at = jumped
