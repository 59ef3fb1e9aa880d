"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, mixing, pii, quality, repeats, secretscan, simhash, urlfilter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256 and spans, from doc_id and an array of spans."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secretscan.scan(table(spark, sf_dir, "documents")), secretscan.KINDS[:3])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii.find(table(spark, sf_dir, "documents")), pii.KINDS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_secrets,
        op3_pii,
        op4_decontaminate,
        op5_mix,
        op6_urls,
        op7_quality,
        op8_embeddings,
        op9_repeats,
        op10_language,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_mix": mixing.ORACLE_SQL.format(documents="documents"),
    "op6_urls": urlfilter.oracle_sql(),
    "op8_embeddings": embeddings.ORACLE_SQL,
}
