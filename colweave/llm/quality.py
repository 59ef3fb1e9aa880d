"""Quality classification with histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned statistics (logistic loss, second-order
gains), then kept as flat arrays: a batch of documents descends all of them by
numpy indexing. Texts are counted whole, in one pass beside the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_sample, held_out

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 1.0
THRESHOLD = 0.3

# Bytes whose shares are statistics of their own.
MARKS = b"!?.,;:'\"-_*#$%&@|/\\<>{}[]()=+~^`"
_CLASS = np.zeros(256, np.int64)
for _k in range(256):
    _c = chr(_k)
    _CLASS[_k] = 5 if _k >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 0
_MARK = np.frombuffer(MARKS, np.uint8).astype(np.int64)
FEATURES = 6 + len(MARKS) + 14


def statistics(text: str | None) -> np.ndarray:
    """Statistics of the whole text; all zero for an empty or null one."""
    out = np.zeros(FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[:6] = np.bincount(_CLASS, counts, 6) / n
    out[6 : 6 + len(MARKS)] = counts[_MARK] / n
    words = raw.split()
    lines = raw.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    heads = {x[:6] for x in words}
    p = counts[counts > 0] / n
    full = [x for x in lines if x.strip()]
    out[6 + len(MARKS) :] = (
        math.log1p(n),
        math.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        len(set(words)) / w,
        len(heads) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        len(full) / w,
        len(set(full)) / max(1, len(full)),
        max(map(len, lines)) / n,
        float(-(p * np.log(p)).sum()),
        float((lengths <= 3).mean()),
        sum(x[-1:] in b".!?" for x in full) / max(1, len(full)),
    )
    return out


class Trees:
    """Boosted trees in flat arrays: feature, threshold and value of node k at [tree, k]; children 2k+1, 2k+2."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        nodes = 2 ** (DEPTH + 1) - 1
        self.prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
        self.feature = np.zeros((TREES, nodes), np.int32)
        self.threshold = np.full((TREES, nodes), np.inf, np.float32)
        self.value = np.zeros((TREES, nodes))
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)).astype(np.float32) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        margin = np.full(len(y), self.prior)
        shape = (len(cuts), BINS)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first = 2**level - 1
                width = 2**level
                live = node >= first
                key = (node[live, None] - first) * (shape[0] * BINS) + np.arange(shape[0]) * BINS + bins[live]
                total = width * shape[0] * BINS
                gs = np.bincount(key.ravel(), np.repeat(g[live], shape[0]), total).reshape(width, *shape).cumsum(2)
                hs = np.bincount(key.ravel(), np.repeat(h[live], shape[0]), total).reshape(width, *shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                for k in range(width):
                    best = int(gain[k].argmax())
                    f, b = divmod(best, BINS)
                    if gain[k].flat[best] > 1e-6 and b < len(cuts[f]):
                        self.feature[t, first + k] = f
                        self.threshold[t, first + k] = cuts[f][b]
                node = np.where(live, 2 * node + 1 + (x[np.arange(len(y)), self.feature[t, node]] > self.threshold[t, node]), node)
            gl, hl = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
            self.value[t] = -RATE * gl / (hl + L2)
            margin += self.value[t, node]

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(TREES)[None, :]
        node = np.zeros((len(x), TREES), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.prior + self.value[trees, node].sum(1))))


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Trees from at most SAMPLE_ROWS labelled documents that are not held out.

    Rows with a null id, label or document are not learned from; repeated labels
    of an id count by their largest; without two classes the trees score the prior.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.where(~held_out(F.col("_id"), 5, 0)).groupBy("_id").agg(F.max("_label").alias("_label"))
    known = bounded_sample(known, F.col("_id"), SAMPLE_ROWS)
    rows = documents.select(F.col(id_column).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(known), F.expr("_doc = _id"))
    rows = rows.select("_id", "_label", "_text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(stats, pa.binary())], ["i", "y", "x"])

    got = sorted(map(tuple, rows.mapInArrow(made, "i long, y int, x binary").collect()))
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float32).reshape(-1, FEATURES)
    return Trees(x, np.array([float(r[1] > 0) for r in got]))


def scorer(model: Trees, spark):
    """A column function: text -> score."""
    shared = Shared(spark, model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            stats = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, FEATURES), np.float32)
            yield pd.Series(np.concatenate([shared.value.score(stats[k : k + 1024]) for k in range(0, len(stats), 1024)] or [np.zeros(0)]))

    return score


def classify(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", model: Trees | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 likelier), predicted (score >= THRESHOLD).

    Every row gets a score, null and empty texts that of all-zero statistics; rows
    with a null id are not held out; repeated rows score alike; an empty table gives no rows.
    model is what train has returned, to share.
    """
    score = scorer(model or train(documents, labels, id_column, text), documents.sparkSession)
    out = documents.select(F.col(id_column).alias("doc_id"), score(F.col(text)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", model: Trees | None = None) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored by all-zero statistics; rows without an id are scored but not learned from;
    repeated rows are kept or dropped together; an empty table gives none.
    """
    score = scorer(model or train(documents, labels, id_column, text), documents.sparkSession)
    return documents.where(score(F.col(text)) >= THRESHOLD)
