"""Language identification with blended-spectrum string kernels.

The kernel of two texts is the number of character n-grams (N_GRAMS) present in
both, normalised to 1 for a text with itself; n-grams are hashed to DIMENSIONS
places, so a text is a 0/1 vector whatever its length. Kernel ridge regression,
one language against the rest, runs on Nyström features of LANDMARKS training
texts; scoring a batch is two matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, held_out, share_of

N_GRAMS = (1, 2, 3, 4)
DIMENSIONS = 1 << 13
LANDMARKS = 256
SAMPLE_ROWS = 4000
RIDGE = 1e-3
UNKNOWN = "und"


def presence(text: str | None) -> np.ndarray:
    """0/1 by hashed n-gram of the whole lower-cased text, letters only, other characters as one space."""
    out = np.zeros(DIMENSIONS, bool)
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letters = (codes - 97 < 26) | (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7)
    codes = np.where(letters, codes, 32).astype(np.uint64)
    gap = codes == 32
    codes = codes[~(gap & np.roll(gap, 1))] if len(codes) else codes
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        if len(codes) < n:
            break
        value = value[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in N_GRAMS:
            mixed = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out[(mixed >> np.uint64(51)).astype(np.int64)] = True
    return out


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float32) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Kernel:
    """Landmarks and one weight vector per language."""

    def __init__(self, languages: list[str], rows: np.ndarray) -> None:
        self.names = sorted(set(languages))
        x = unit(list(rows))
        step = max(1, len(x) // LANDMARKS)
        self.landmarks = x[::step][:LANDMARKS]
        k = self.landmarks.astype(np.float64) @ self.landmarks.T.astype(np.float64)
        w, v = np.linalg.eigh(k)
        keep = w > 1e-6
        self.map = (v[:, keep] / np.sqrt(w[keep])) if len(w) else np.zeros((0, 0))
        z = (x @ self.landmarks.T).astype(np.float64) @ self.map
        y = np.array([[1.0 if a == b else -1.0 for b in self.names] for a in languages]).reshape(len(x), len(self.names))
        self.weights = self.map @ np.linalg.solve(z.T @ z + RIDGE * max(1, len(x)) * np.eye(z.shape[1]), z.T @ y)

    def __call__(self, rows: list[np.ndarray]) -> np.ndarray:
        return (unit(rows) @ self.landmarks.T).astype(np.float64) @ self.weights


def train(documents: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang") -> Kernel:
    """Learn from at most SAMPLE_ROWS documents, an equal bound for each language, none held out; null ids, texts and languages are left out.

    Of more than SAMPLE_ROWS languages the most frequent are learned.
    """
    ids = documents.select(F.col(id_column).alias("_id"), F.col(language).alias("_lang")).where("_id is not null and _lang is not null")
    ids = ids.where(~held_out(F.col("_id"), 4, 2))
    sizes = ids.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(SAMPLE_ROWS)
    kinds = max(1, sizes.count())
    # Far above the expected cut of its language an id is left out before the ranking, so that no language gathers in a task.
    side = F.broadcast(sizes)
    ids = ids.join(side, "_lang").where(share_of(F.col("_id")) < (2 * SAMPLE_ROWS / kinds + 50) / F.col("_n")).drop("_n")
    order = Window.partitionBy("_lang").orderBy(F.md5(F.col("_id").cast("string")), "_id")
    ids = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(1, SAMPLE_ROWS // kinds)).drop("_r")
    rows = documents.select(F.col(id_column).alias("_doc"), F.col(language).alias("_named"), F.col(text).alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(ids), F.expr("_doc = _id and _named = _lang")).select("_id", "_lang", "_text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(presence(t)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(bits, pa.binary())], ["i", "l", "x"])

    got = sorted({tuple(r) for r in rows.mapInArrow(made, "i long, l string, x binary").collect()}, key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & ((1 << 64) - 1), r[1], r[2]))
    bits = np.array([np.unpackbits(np.frombuffer(r[2], np.uint8)) for r in got], np.uint8).reshape(-1, DIMENSIONS)
    return Kernel([r[1] for r in got], bits)


def identify(documents: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang", model: Kernel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) for every row, from its whole text.

    Texts that are null or have no letter get und with score 0, and so does every
    text where nothing could be learned. Repeated rows score alike; ties go to the
    first language in order; an empty table gives no rows. model is what train has returned, to share.
    """
    model = Shared(documents.sparkSession, model or train(documents, id_column, text, language))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for k in range(0, len(texts), 512):
                part = list(texts.iloc[k : k + 512])
                margins = model.value([presence(t) for t in part]) if model.value.names else None
                for n, t in enumerate(part):
                    if margins is None or not t or not any(map(str.isalpha, t)):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(margins[n].argmax())
                    names.append(model.value.names[best])
                    scores.append(float(min(1.0, max(0.0, (margins[n][best] + 1) / 2))))
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    out = documents.select(F.col(id_column).alias("doc_id"), predict(F.col(text)).alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "p.lang_pred", "p.score")
