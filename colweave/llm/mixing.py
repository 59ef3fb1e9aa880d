"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order (by md5 of the id),
gone through twice. A document's virtual finish time is the source's words up to
its end divided by the source's target, so at any virtual time all sources have
been served in proportion to their targets; sorting by it is the global order of
the mix, and the total budget is spent at virtual time 1, where the document in
service of each source is cut. Cumulative words are summed in two levels, within buckets of
the shuffled order and over the buckets' sums. Buckets are the leading hex digits of the md5,
as many as keep a bucket near BUCKET_ROWS, three at least; rows without an id, which share one md5, are
parted by size, the next key of the order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
REPEATS = 2
BUCKET_ROWS = 1_000_000
#: md5 of the empty string, for rows without an id.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> also target.

    Sources by code point, null last, weigh WEIGHTS in turn. Targets are
    level * weight, stopped at repeats * source_size; the level is the one at which
    they sum to budget * all sizes, found from running sums over the sources in
    order of the level that fills them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int"))
    everyone = Window.partitionBy(F.lit(0))
    before = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(repeats))
    out = out.withColumn("full", F.col("cap") / F.col("weight"))
    out = out.withColumn("rest", F.sum("source_size").over(everyone) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if this source and all that fill later share what the earlier ones leave; the first that is not above its own is the true one.
    out = out.withColumn("try", F.col("rest") / F.col("left"))
    level = F.min(F.when(F.col("try") <= F.col("full"), F.struct(F.col("full").alias("a"), (-F.col("try")).alias("b")))).over(everyone)["b"]
    out = out.withColumn("level", -level)
    filled = F.col("level").isNull() | (F.col("full") < F.col("level"))
    return out.select("source", "source_size", F.when(filled, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: what a budget of BUDGET times all words takes of it.

    Returns doc_id, size, source_size, target, taken (words, repeats counted,
    0 to REPEATS * size), source and virtual_finish (of the first copy; null where the source has no
    target), in order of virtual_finish. Null and blank texts have size 0 and are not
    taken; a null source is a source; null or repeated ids are queued like others
    (ties by size); an empty table gives no rows. Other columns are not read.
    """
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    docs = documents.select(
        F.col(id_column).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key")
    )
    docs = settle(docs)
    digits = max(3, math.ceil(math.log(max(1, docs.count() / BUCKET_ROWS), 16)))
    first = F.substring("key", 1, digits)
    parted = F.when(F.col("key") < NO_ID, first).when(F.col("key") > NO_ID, F.concat(first, F.lit("~"))).otherwise(F.concat(first, F.lit("-"), F.lpad(F.col("size").cast("string"), 20, "0")))
    docs = docs.withColumn("bucket", F.when(first == NO_ID[:digits], parted).otherwise(first))
    buckets = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    known = buckets.alias("b").join(goal.alias("g"), F.expr("b.source <=> g.source")).select(
        F.col("b.source").alias("s"), F.col("b.bucket").alias("k"), "ahead", "source_size", "target"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = docs.join(known, F.expr("source <=> s and bucket = k"))
    start = F.col("ahead") + F.col("inside")
    zero, size = F.lit(0).cast("long"), F.col("size")
    total = F.round("target").cast("long")

    def served(copy: int) -> Column:
        return F.greatest(zero, F.least(size, total - start - F.col("source_size") * F.lit(copy)))

    taken = served(0)
    for copy in range(1, REPEATS):
        taken = taken + served(copy)
    finish = F.when(F.col("target") > 0, (start + size) / F.col("target"))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", finish.alias("virtual_finish")).orderBy("virtual_finish")


def corpus(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes words of, all their columns, with size, taken and virtual_finish, in the mix's order.

    Of a text whose taken is below its size only so many words belong to the mix; above it, the text comes again. Rows
    that share an id and a size are told apart by their text's hash, so repeated rows each keep a row of the mix. Null and blank texts are not
    taken; an empty table gives no rows. Columns named size, taken or virtual_finish are replaced.
    """
    names = ["size", "taken", "virtual_finish"]
    named = lambda i: F.when(i.isNull(), "null").otherwise(F.concat(F.lit("id "), i.cast("string")))
    mixed = mix(documents, id_column, text, source)
    chosen = mixed.select(named(F.col("doc_id")).alias("_m_key"), *[F.col(n).alias(f"_m_{n}") for n in names])
    turn = F.row_number().over(Window.partitionBy("_m_key", "_m_size").orderBy("_m_virtual_finish"))
    chosen = chosen.withColumn("_m_turn", turn).where("_m_taken > 0")
    docs = documents.drop(*names).withColumn("_d_key", named(F.col(id_column))).withColumn("_d_size", word_count(F.col(text)))
    # Rows that differ in nothing are alike to the mix, so any order of them will do.
    docs = docs.withColumn("_d_turn", F.row_number().over(Window.partitionBy("_d_key", "_d_size").orderBy(F.xxhash64(F.col(text)))))
    # The turns are compared beside the join's keys, so that texts stay where the window has them.
    same = (F.col("_d_key") == F.col("_m_key")) & (F.col("_d_size") == F.col("_m_size")) & (F.col("_d_turn") - F.col("_m_turn") == 0)
    kept = [docs[c] for c in documents.columns if c not in names]
    return docs.join(chosen, same).select(*kept, *[F.col(f"_m_{n}").alias(n) for n in names]).orderBy("virtual_finish")


#: DuckDB: the same mix from documents.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / weight AS full_at FROM w),
t AS (SELECT *, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER o, 0))
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0)) AS try
      FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(struct_pack(a := full_at, b := -try)).b * -1 AS level FROM t WHERE try <= full_at),
g AS (SELECT source, source_size, CASE WHEN level IS NULL OR full_at < level THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM t, l),
q AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(coalesce(sum(d.size) OVER (
        PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - start))
          + greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN (start + size) / target END AS virtual_finish
FROM q
"""
