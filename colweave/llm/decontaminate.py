"""Benchmark decontamination by pigeonhole edit matching.

A test item of L normalised characters may differ from a passage by
k = floor(ERROR_RATE * L) edits. Of k+1 pieces of the item at least one then
stands in the passage unchanged, so one Aho-Corasick pass over a document finds
every candidate; Myers' bit-parallel distance verifies it, first over a short
stretch beside the piece and then over the whole item. Items travel to the
executors in blocks of at most BLOCK_CHARS characters, one automaton at a time,
so memory is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
PROBE = 48


def normalise(text: str | None) -> str:
    """Lower case, white space collapsed to single spaces."""
    return " ".join((text or "").lower().split())


def distance_to_prefix(pattern: str, text: str, most: int) -> int:
    """Least edit distance of pattern to any prefix of text, or most + 1 if above most (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = mask, 0, m
    best = score
    for c in text[: m + most]:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best = score
    return best if best <= most else most + 1


def _extend(pattern: str, text: str, most: int) -> int:
    """distance_to_prefix, given up early where a first stretch alone costs more than most."""
    if len(pattern) > 2 * PROBE and distance_to_prefix(pattern[:PROBE], text[: PROBE + most], most) > most:
        return most + 1
    return distance_to_prefix(pattern, text, most)


class Items:
    """Normalised items and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            n, k = len(text), int(rate * len(text))
            edges = [j * n // (k + 1) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, int]:
        """Least verified distance by position of the item."""
        found: dict[int, int] = {}
        for end, (size, where) in self.automaton.iter(text):
            for which, a in where:
                _, item, k = self.items[which]
                limit = found.get(which, k + 1) - 1
                at = end - size + 1
                if limit < 0:
                    continue
                if at >= a and text.startswith(item, at - a):
                    found[which] = 0
                    continue
                tail = _extend(item[a + size :], text[end + 1 : end + 1 + len(item) - a - size + limit], limit)
                if tail > limit:
                    continue
                head = _extend(item[:a][::-1], text[max(0, at - a - limit) : at][::-1], limit - tail)
                if head + tail <= limit:
                    found[which] = head + tail
        return found


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """(doc_id, item_id, distance): every document with a passage within rate edits a character of an item.

    distance is the least verified one. Texts are compared in lower case with
    white space collapsed; null texts count as empty. An item of n characters may
    have int(rate * n) edits, whatever its length. Repeated
    document rows report their pairs each; repeated items report theirs each; empty
    items and empty tables give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, distance int"
    out = None
    for block in _blocks(benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))):
        shared = spark.sparkContext.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                rows = []
                for doc, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    rows += [(doc, items.items[k][0], d) for k, d in items.matches(normalise(value)).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)],
                        ["doc_id", "item_id", "distance"],
                    )

        part = docs.mapInArrow(found, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        value = normalise(row["text"])
        if not value:
            continue
        block.append((row["item_id"], value))
        size += len(value)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without those that hold a passage of the benchmark; rows with a null id stay unless they do.

    The decision is made row by row beside the text, so no id has to be unique.
    """
    flagged = documents
    for block in _blocks(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        flagged = flagged.where(~_holds(shared)(F.col(text)))
    return flagged


def _holds(shared):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(shared.value, ERROR_RATE)
        for texts in batches:
            yield pd.Series([bool(items.matches(v)) for v in map(normalise, texts)], dtype=bool)

    return holds
