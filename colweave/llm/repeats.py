"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A string of LENGTH bytes that starts anywhere else is a repeat; every byte it
covers is one. Windows of LENGTH bytes are dealt by content: a window's key is
the least hash of its CORE-byte strings (its minimizer), so equal windows share a
key whatever the documents, and successive windows with one key form a run, a
stretch of text that a single row stands for.

1. Keys that occur once hold no repeat. Runs that are equal as a whole are
   repeats throughout and are counted, not compared. One run of each such class
   stays, for others to be compared with.
2. The remaining runs of a key go, as text, to its task, which cuts them into
   shards and builds each shard's Burrows-Wheeler transform, over super-characters
   of STEP bytes. The transforms are merged by interleave refinement (Holt and
   McMillan 2014): pass k brings the suffixes of all shards into the order of
   their first k super-characters and carries the borders between blocks that
   share a prefix. After LENGTH / STEP passes a block of two or more suffixes is a
   repeated interval; no suffix is sorted across shards.
3. Keys whose different runs hold more than KEY_BYTES, however many, do not gather
   in a task: each window of theirs is a key of its own, counted by its hash in two
   phases. Only hashes and positions travel, and a run that repeats itself sends a
   hash once.

Every join on a key of unknown frequency goes through spread_join. Hashes of 64 bits stand for strings in keys and
super-characters, and pairs of them for whole runs and counted windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, spread_join, stash

LENGTH = 200
STEP = 40
#: Length of the strings whose least hash is a window's key: longer ones make more runs, shorter ones more keys that common lines share.
CORE = 96
KEY_BYTES = 1 << 17
#: Windows of a text that are dealt at once.
STRETCH = 1 << 20
SHARD_BYTES = 1 << 17
TASK_BYTES = 1 << 19

_TABLE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.random.default_rng(6).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of size bytes, by doubling."""
    part, done, out, covered, k = _TABLE[raw], 1, None, 0, 0
    while True:
        if size & done:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - covered)
                out = out[:n] * _ODD[32 + k] + part[covered : covered + n]
            covered += done
        done *= 2
        if done > size:
            break
        part = part[: len(part) - done // 2] * _ODD[k] + part[done // 2 :]
        k += 1
    out = out[: len(raw) - size + 1]
    out = out ^ (out >> np.uint64(29))
    out = out * _ODD[31]
    return out ^ (out >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(data: bytes, size: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(key, digest, start, end, again): the runs of windows; again: the key's string stands more than once in it."""
    if len(data) < LENGTH:
        return
    raw = np.frombuffer(data, np.uint8)
    strings = hashes(raw, size)
    width = LENGTH - size + 1
    least = _sliding(strings, width, np.minimum)
    borders = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, ends = np.concatenate([[0], borders]), np.concatenate([borders, [len(least)]])
    pad = np.zeros(width - 1, np.uint64)
    chosen = strings[_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == strings]
    twice = len(np.unique(chosen)) < len(chosen)
    keys = least[starts]
    for key, a, z in zip(keys.tolist(), starts.tolist(), ends.tolist(), strict=True):
        again = twice and bool((strings[a : z + width - 1] == np.uint64(key)).sum() > 1)
        yield _long(key), _long(xxhash.xxh3_64_intdigest(data[a : z + LENGTH - 1])), a, z + LENGTH - 1, again


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Shard:
    """The transform of some texts over super-characters: at each rank of its suffixes, the one before.

    A text of n bytes is read in STEP phases, so it has n + 1 suffixes: one at each
    byte where a super-character fits, and STEP ends of texts. Symbol 0 is an end.
    """

    def __init__(self, texts: list[bytes], symbols: list[np.ndarray]) -> None:
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        symbol = np.zeros(total, np.int64)
        inside = np.arange(total) - np.repeat(first, sizes)
        for a, s in zip(first, symbols, strict=True):
            symbol[a : a + len(s)] = s
        end = symbol == 0
        self.ends = int(end.sum())
        rank = np.where(end, 0, self.ends + symbol)
        rank[end] = np.arange(self.ends)
        following = np.minimum(np.arange(total) + STEP, total - 1)
        following[end] = np.flatnonzero(end)
        while True:
            # An end has a rank of its own already, so what follows it is never looked at.
            order = np.lexsort((rank[following], rank))
            pairs = np.stack([rank[order], rank[following[order]]])
            fresh = np.concatenate([[0], (np.diff(pairs) != 0).any(0).cumsum()])
            rank = np.empty(total, np.int64)
            rank[order] = fresh
            if fresh[-1] == total - 1:
                break
            following = following[following]
        self.order = order
        before = np.where(inside >= STEP, symbol[np.maximum(np.arange(total) - STEP, 0)], 0)
        self.before = before[order]


def merge(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard, by rank: whether the suffix shares its first depth super-characters with another of any shard."""
    total = [len(s.before) for s in shards]
    ends = np.repeat(np.arange(len(shards)), [s.ends for s in shards]).astype(np.uint16)
    source = np.repeat(np.arange(len(shards)), total).astype(np.uint16)
    before = np.concatenate([s.before for s in shards])
    block = np.zeros(len(source), np.int64)
    for _ in range(depth):
        place = np.argsort(source, kind="stable")
        symbol = np.empty(len(source), np.int64)
        symbol[place] = before
        live = np.flatnonzero(symbol)
        live = live[np.argsort(symbol[live].astype(np.int32), kind="stable")]
        chosen, inner = symbol[live], block[live]
        border = np.ones(len(live), bool)
        border[1:] = (chosen[1:] != chosen[:-1]) | (inner[1:] != inner[:-1])
        source = np.concatenate([ends, source[live]])
        block = np.concatenate([np.arange(len(ends)), len(ends) + border.cumsum()])
    shared = np.bincount(block)[block] > 1
    place = np.argsort(source, kind="stable")
    return np.split(shared[place], np.cumsum(total)[:-1])


def repeated(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, whether each window of LENGTH bytes stands anywhere else in the texts."""
    grams = [hashes(np.frombuffer(t, np.uint8), STEP) for t in texts]
    sizes = [len(g) for g in grams]
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    symbols = np.split(ids.astype(np.int64) + 1, np.cumsum(sizes)[:-1])
    parts: list[tuple[int, int]] = []
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SHARD_BYTES or k == len(texts) - 1:
            parts.append((begin, k + 1))
            begin, size = k + 1, 0
    shards = [Shard(texts[a:b], symbols[a:b]) for a, b in parts]
    out: list[np.ndarray] = []
    for (a, b), shard, flags in zip(parts, shards, merge(shards, LENGTH // STEP), strict=True):
        here = np.empty(len(flags), bool)
        here[shard.order] = flags
        at = 0
        for t in texts[a:b]:
            out.append(here[at : at + len(t) - LENGTH + 1])
            at += len(t) + 1
    return out


def _intervals(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Covered stretches of a text whose windows have flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield a, z + LENGTH - 1


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_RUN = [("g", pa.int64()), ("d", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("again", pa.bool_())]
_TEXT = [("g", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int32()), ("live", pa.bool_()), ("t", pa.binary())]
_COUNT = [*_TEXT[:5], ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]
_SPAN = [("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]


def _of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_RUN)
    for batch in batches:
        rows = []
        for k1, k2, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            # By stretches, so that memory is bounded; a run that a border cuts is two.
            for at in range(0, len(text) - LENGTH + 1, STRETCH):
                for g, d, s, e, again in runs(text[at : at + STRETCH + LENGTH - 1], CORE):
                    rows.append((g, d, k1, k2, at + s, at + e, again))
                    if len(rows) >= 65536:
                        yield from _batches(rows, schema)
                        rows = []
        yield from _batches(rows, schema)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(k1, k2, text, wanted) of the joined rows; copies of a row, which come together, count once."""
    last = None
    for batch in batches:
        for k1, k2, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (k1, k2) != last:
                yield k1, k2, text, wanted
            last = k1, k2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_TEXT)
    rows, size = [], 0
    for k1, k2, text, wanted in _wanted(batches):
        for w in wanted:
            rows.append((w["g"], k1, k2, w["s"], w["live"], text[w["s"] : w["e"]]))
            size += w["e"] - w["s"]
            if size >= TASK_BYTES:
                yield from _batches(rows, schema)
                rows, size = [], 0
    yield from _batches(rows, schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a run's windows and where each stands first; at is -1 - start where it stands there again."""
    schema = pa.schema(_COUNT)
    rows, size = [], 0
    for k1, k2, text, wanted in _wanted(batches):
        for w in wanted:
            strings = hashes(np.frombuffer(text, np.uint8, w["e"] - w["s"], w["s"]), LENGTH)
            kinds, first, place, many = np.unique(strings, return_index=True, return_inverse=True, return_counts=True)
            once = many == 1
            rows.append((w["g"], k1, k2, w["s"], w["live"], kinds.view(np.int64), np.where(once, first, -1 - first).astype(np.int32)))
            size += len(kinds)
            if size >= TASK_BYTES // 8:
                yield from _batches(rows, schema)
                rows, size = [], 0
    yield from _batches(rows, schema)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of runs whose windows repeat within the run."""
    schema = pa.schema(_SPAN)
    rows = []
    for k1, k2, text, wanted in _wanted(batches):
        for w in wanted:
            strings = hashes(np.frombuffer(text, np.uint8, w["e"] - w["s"], w["s"]), LENGTH)
            _, place, many = np.unique(strings, return_inverse=True, return_counts=True)
            rows += [(k1, k2, w["s"] + a, w["s"] + z) for a, z in _intervals(many[place] > 1)]
            if len(rows) >= 8192:
                yield from _batches(rows, schema)
                rows = []
    yield from _batches(rows, schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come with equal keys together; whole keys are compared, TASK_BYTES or so at a time."""
    schema = pa.schema(_SPAN)
    held: list[tuple] = []
    size, last = 0, None

    def done() -> Iterator[pa.RecordBatch]:
        rows = []
        flags = repeated([t for *_, t in held])
        for (k1, k2, s, live, _), f in zip(held, flags, strict=True):
            if live:
                rows += [(k1, k2, s + a, s + z) for a, z in _intervals(f)]
        yield from _batches(rows, schema)

    for batch in batches:
        for g, k1, k2, s, live, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if g != last and size >= TASK_BYTES:
                yield from done()
                held, size = [], 0
            last = g
            held.append((k1, k2, s, live, t))
            size += len(t)
    if held:
        yield from done()


def _counted(crowd: DataFrame) -> DataFrame:
    """Spans of the runs of crowded keys, each window a key of its own."""
    every = crowd.mapInArrow(_windows, "g long, k1 long, k2 long, s int, live boolean, h array<long>, at array<int>")
    each = every.select("g", "k1", "k2", "s", "live", F.explode(F.arrays_zip("h", "at")).alias("w")).select("g", "k1", "k2", "s", "live", "w.h", "w.at")
    counts = each.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1")
    known = spread_join(each.where("live and at >= 0"), counts, ["g", "h"], ["k1", "k2", "s"])
    known = known.select("k1", "k2", (F.col("s") + F.col("at")).alias("s"), (F.col("s") + F.col("at") + LENGTH).alias("e"))
    own = crowd.select("k1", "k2", "text", F.filter("wanted", lambda w: w["live"] & w["again"]).alias("wanted")).where(F.size("wanted") > 0)
    return known.unionByName(own.mapInArrow(_again, "k1 long, k2 long, s int, e int"))


def _spans(documents: DataFrame) -> DataFrame:
    """(k1, k2, text) -> (k1, k2, s, e): stretches of repeats, overlapping ones too."""
    every = stash(documents.mapInArrow(_of_documents, "g long, d long, k1 long, k2 long, s int, e int, again boolean"))
    keys = every.groupBy("g").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("z"), F.max("again").alias("twice"))
    keys = stash(keys.where("n > 1 or twice").select("g", "n", F.expr("a <> z or (twice and n = 1)").alias("mixed")))
    some = stash(spread_join(every, keys, ["g"], ["k1", "k2", "s"]))
    out = some.where("not mixed").select("k1", "k2", "s", "e")
    some = some.where("mixed").drop("mixed")
    # What is equal as a whole is a repeat; one of each such class stays, not live, for the others to be compared with.
    classes = some.groupBy("g", "d").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "s", "e")).alias("one"))
    classes = stash(classes)
    out = out.unionByName(spread_join(some, classes.where("n > 1").select("g", "d", "n"), ["g", "d"], ["k1", "k2", "s"]).select("k1", "k2", "s", "e"))
    size = F.col("one.e") - F.col("one.s")
    groups = classes.groupBy("g").agg(F.count("*").alias("n"), F.max("again").alias("any"), F.sum(size).alias("bytes")).where("n > 1 or any")
    groups = stash(groups.select("g", "n", (F.col("bytes") > KEY_BYTES).alias("crowded")))
    left = spread_join(classes.withColumnRenamed("n", "copies"), groups, ["g"], ["d"]).select("g", "one.*", "again", (F.col("copies") == 1).alias("live"), "crowded")
    wanted = left.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "s", "e", "live", "again", "crowded")).alias("wanted"))
    left = documents.join(wanted, ["k1", "k2"])

    def those(test) -> DataFrame:
        return left.select("k1", "k2", "text", F.filter("wanted", test).alias("wanted")).where(F.size("wanted") > 0)

    texts = those(lambda w: ~w["crowded"]).mapInArrow(_cut, "g long, k1 long, k2 long, s int, live boolean, t binary")
    # As many tasks as partitions: comparing costs time, which partitions merged by their bytes would not show.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.unionByName(texts.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(_compare, "k1 long, k2 long, s int, e int"))
    if is_empty(groups.where("crowded")):
        return out
    return out.unionByName(_counted(those(lambda w: w["crowded"])))


def remove(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start and end, in bytes, end exclusive) and kept (binary).

    Spans are the maximal removed stretches; kept is the rest, joined. Null texts
    count as empty, texts shorter than LENGTH bytes keep everything, and repeated rows are
    copies of each other. Rows with a null id are documents like any other. An empty table
    gives no rows; other columns are not read.
    """
    docs = documents.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    spans = _spans(docs).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                whole: list[list[int]] = []
                for w in sorted((w["s"], w["e"]) for w in found or ()):
                    if whole and w[0] <= whole[-1][1]:
                        whole[-1][1] = max(whole[-1][1], w[1])
                    else:
                        whole.append([w[0], w[1]])
                edges = [0, *(x for w in whole for x in w), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": z} for a, z in whole])
                kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, stretch), pa.array(kept, pa.binary())], ["k1", "n_bytes", "spans", "kept"]
            )

    out = docs.join(spans, ["k1", "k2"], "left").select("k1", "text", "spans")
    out = out.mapInArrow(cleared, "k1 long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")
    return out.select(F.when(F.col("k1") != -(2**63), F.col("k1")).alias("doc_id"), "n_bytes", "spans", "kept")


def digest(cleared: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from what remove returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, w: t + (w["end"] - w["start"]))
    return cleared.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
