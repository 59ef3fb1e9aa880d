"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of
about sixteen dimensions. If two are within squared distance e, one block holds
at most its proportional share of e; that block's range-join finds the pair.
The join is on a grid over the block's coordinates, two at a time: a vector goes to its
own cell and, within the radius of a border, to neighbouring cells before it. A cell with
more than SHARD classes is divided by the block's next two coordinates, and so on
while there are any, so that the work does not grow with the square of a crowded cell.
Equal vectors are joined once, as a class. Cells that are crowded in all coordinates
are cut into shards, every pair of shards a task. A pair is verified by its
exact cosine where found, and counted by the first block that admits it, so
tasks return sums and a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, settle, spread_join
from .components import Labels, components

COSINE = 0.98
BLOCK = 16
SHARD = 4096
#: So many of the vectors with the most copies are broadcast, to part their rows.
HEAVY_VECTORS = 1000


#: Rotations by dimensions, each made once a task.
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dimensions: int) -> np.ndarray:
    if dimensions not in _ROTATIONS:
        _ROTATIONS[dimensions] = np.linalg.qr(np.random.default_rng(11).normal(size=(dimensions, dimensions)))[0]
    return _ROTATIONS[dimensions]


def blocks(dimensions: int) -> list[slice]:
    n = max(1, dimensions // BLOCK)
    edges = [k * dimensions // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, against overflow."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def radii(dimensions: int, cosine: float) -> np.ndarray:
    """The blocks' radii, with a little room for rounding."""
    share = np.array([(b.stop - b.start) / dimensions for b in blocks(dimensions)])
    return np.sqrt(2 * (1 - cosine) * share) + 1e-9


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, matrix) for each length of list in the column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


_CELL = pa.schema([("cls", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("b", pa.int32()), ("cell", pa.string()), ("lack", pa.int32())])
CELL = "cls long, label long, d int, b int, cell string, lack int"


def _places(xs: np.ndarray, ys: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(members, x, y, own): the cells of width 2r that points go to; a pair within r meets in one cell that is one of the two's own."""
    width = 2 * r
    x, y = np.floor(xs / width), np.floor(ys / width)
    low_x, low_y, high_y = xs - x * width <= r, ys - y * width <= r, (y + 1) * width - ys <= r
    for dx, dy, near in ((0, 0, np.ones(len(xs), bool)), (0, -1, low_y), (-1, 0, low_x), (-1, -1, low_x & low_y), (-1, 1, low_x & high_y)):
        k = np.flatnonzero(near)
        if len(k):
            yield k, (x[k] + dx).astype(np.int64), (y[k] + dy).astype(np.int64), dx == dy == 0


def _pair(turned: np.ndarray, s: slice, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's coordinates of a level; zeros where it has no second one."""
    at = s.start + 2 * level
    return turned[:, at], turned[:, at + 1] if at + 1 < s.stop else np.zeros(len(turned))


def cells(classes: DataFrame, cosine: float) -> DataFrame:
    """Where each class goes by the first two coordinates of each block; lack is 0 in its own cell, else 1."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), np.asarray(batch.column(1)).astype(np.int64)
            for d, rows, matrix in _matrix(batch.column(2)):
                turned = unit(matrix) @ rotation(d)
                for b, (s, r) in enumerate(zip(blocks(d), radii(d, cosine), strict=True)):
                    for k, x, y, own in _places(*_pair(turned, s, 0), r):
                        n, names = len(k), [f"{i}:{j}" for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids[rows][k], labels[rows][k], np.full(n, d), np.full(n, b), names, np.full(n, int(not own))), _CELL, strict=True)], schema=_CELL)

    return classes.select("cls", "label", "embedding").mapInArrow(made, CELL)


def divided(crowded: DataFrame, cosine: float, level: int) -> DataFrame:
    """The rows of crowded cells, with their vectors, dealt to cells within by the block's next two coordinates; lack gains a bit a level."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, blocked, lack = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            outer = batch.column(3).to_pylist()
            for d, rows, matrix in _matrix(batch.column(5)):
                turned = unit(matrix) @ rotation(d)
                for b in np.unique(blocked[rows]).tolist():
                    here = np.flatnonzero(blocked[rows] == b)
                    for k, x, y, own in _places(*_pair(turned[here], blocks(d)[b], level), radii(d, cosine)[b]):
                        at = rows[here[k]]
                        names = [f"{outer[a]}/{i}:{j}" for a, i, j in zip(at.tolist(), x.tolist(), y.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip((ids[at], labels[at], np.full(len(k), d), np.full(len(k), b), names, lack[at] | int(not own) << level), _CELL, strict=True)], schema=_CELL
                        )

    return crowded.select("cls", "label", "b", "cell", "lack", "embedding").mapInArrow(made, CELL)


def join_shard(cls: np.ndarray, weight: np.ndarray, lack: np.ndarray, side: np.ndarray, vectors: np.ndarray, b: int, cosine: float):
    """(cls, links, root) of the vectors of a shard that have links this shard counts.

    side: 0 everywhere for a shard with itself, else 0 and 1 for the two shards.
    """
    d = vectors.shape[1]
    u = unit(vectors)
    turned, r = u @ rotation(d), radii(d, cosine)
    near = turned[:, blocks(d)[b]]
    square = (near**2).sum(1)
    labels, links = Labels(len(cls)), np.zeros(len(cls), np.int64)
    alone = not side.any()
    first, second = (np.arange(len(cls)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for k in range(0, len(first), 512):
        mine = first[k : k + 512]
        distance = square[mine][:, None] + square[second][None, :] - 2 * near[mine] @ near[second].T
        ok = (distance <= r[b] ** 2 + 1e-9) & ((lack[mine][:, None] & lack[second][None, :]) == 0)
        if alone:
            ok &= mine[:, None] < second[None, :]
        rows, columns = np.nonzero(ok)
        for j in range(0, len(rows), 65536):
            p, q = mine[rows[j : j + 65536]], second[columns[j : j + 65536]]
            true = np.einsum("nd,nd->n", u[p], u[q]) >= cosine
            p, q = p[true], q[true]
            gap = (turned[p] - turned[q]) ** 2
            new = np.ones(len(p), bool)
            for e, s in enumerate(blocks(d)[: b + 1]):
                admitted = gap[:, s].sum(1) <= r[e] ** 2
                new &= admitted if e == b else ~admitted
            np.add.at(links, p[new], weight[q[new]])
            np.add.at(links, q[new], weight[p[new]])
            labels.link(p, q)
    some = np.flatnonzero((links > 0) | (labels.at != np.arange(len(cls))))
    return cls[some], links[some], cls[labels.at[some]]


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, shard: int = SHARD
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Rows link where labels are equal and not null and the cosine is at least that
    given. Vectors that are null, empty, zero, or hold null or non-finite components, and
    rows without a label, link with nothing; so do vectors of different lengths with each
    other. Copies and repeated rows link with each other. A row with a null id
    links too but is no component's name; an empty table gives no rows.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v if vector == "embedding" else F.col(vector).alias("embedding"), F.col(label).cast("long").alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    classes = rows.where("valid").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()))
    key, level, parts = ["label", "d", "b", "cell"], 0, []
    where = settle(cells(classes, cosine))
    while True:
        sizes = where.groupBy(*key).agg(F.count("*").alias("n"), F.bit_and("lack").alias("lacked")).where("n > 1 and lacked = 0").select(*key, "n", F.col("n").alias("size"))
        known = spread_join(where, sizes, key, ["cls"])
        level += 1
        # A block of d dimensions' vectors has d / number of blocks coordinates, at least.
        width = F.floor(F.col("d") / F.greatest(F.lit(1), F.floor(F.col("d") / BLOCK)))
        more = known.where((F.col("size") > shard) & (width > 2 * level))
        parts.append(known.where(~((F.col("size") > shard) & (width > 2 * level))))
        if is_empty(sizes.where((F.col("size") > shard) & (width > 2 * level))):
            break
        where = settle(divided(more.join(classes.select("cls", "embedding"), "cls"), cosine, level))
    where = functools.reduce(DataFrame.unionByName, parts)
    where = where.withColumn("c", F.ceil(F.col("size") / shard).cast("int")).withColumn("s", F.pmod(F.xxhash64("cls"), F.col("c")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least(F.col("s"), o).alias("i"), F.greatest(F.col("s"), o).alias("j")))
    where = where.withColumn("t", F.explode(each)).select("label", "d", "b", "cell", "t.i", "t.j", "lack", (F.col("s") != F.col("t.i")).alias("side"), "cls")
    dealt = where.join(classes.select("cls", "n", "embedding"), "cls").select("label", "d", "b", "cell", "i", "j", "lack", "side", "cls", "n", "embedding")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch], b: int) -> pa.RecordBatch | None:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, links, roots = join_shard(
                t["cls"].to_numpy(), t["n"].to_numpy(), t["lack"].to_numpy(), np.asarray(t["side"]).astype(np.int8),
                np.asarray(t["embedding"].chunk(0).flatten()).reshape(t.num_rows, -1).astype(np.float64), b, cosine,
            )
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["cls", "links", "root"]) if len(ids) else None

        key, parts = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                here = keys[a]
                if here != key:
                    if parts and (out := done(parts, key[2])):
                        yield out
                    key, parts = here, []
                parts.append(batch.slice(a, z - a))
        if parts and (out := done(parts, key[2])):
            yield out

    by = [*key, "i", "j"]
    found = settle(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(linked, "cls long, links long, root long"))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "cls", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("links", F.lit(0)))
    edges = found.select(F.col("cls").alias("a"), F.col("root").alias("b")).where("a <> b")
    if is_empty(edges):
        known = known.withColumn("component_id", F.col("least"))
    else:
        root = components(edges).withColumnRenamed("node", "cls")
        known = known.join(root, "cls", "left")
        whole = known.where("root is not null").groupBy("root").agg(F.min("least").alias("whole"))
        known = known.join(whole, "root", "left").withColumn("component_id", F.coalesce("whole", "least"))
    known = known.select("label", "embedding", "n", "n_links", "component_id")
    linked_rows = spread_join(rows.where("valid"), known, ["label", "embedding"], ["vec_id"], HEAVY_VECTORS)
    out = linked_rows.select("vec_id", "n_links", "component_id").unionByName(
        rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB: all pairs of a label, and what each vector reaches.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, coalesce(links.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.x LEFT JOIN links ON v.vec_id = links.x
"""
