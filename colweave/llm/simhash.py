"""SimHash near-duplicates with sharded BK-trees.

near_duplicates links fingerprints of three-word shingles. Two fingerprints of 64
bits within radius r agree on one of r+1 blocks, and on one of r+1 sub-blocks of
the remaining bits, so each distinct fingerprint goes to (r+1)^2 keys of about 35
bits. Every key that holds several fingerprints is a shard: a task builds its
BK-tree (children keyed by integer Hamming distance to the parent) and follows
only edges within the radius.

deduplicate groups documents of similarity 0.8 or more on five-word shingles.
Such pairs differ in up to 30 bits, too many for blocks of bits, so there
documents that share a min-hash make a shard; its BK-tree gives the pairs within
the radius. Their min-hashes decide where the estimate is far from 0.8; the other
pairs are compared by their whole sets of shingles, in a second pass over the
documents of a shard that have such a pair.

A key with more members than a shard holds is cut, and each pair of shards
becomes a task of its own, so that no task grows with the data. Only a spanning
forest of each shard's links leaves it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, map_rows, settle, spread_join, stash
from .components import Labels, components

WORDS = 3
SEED = 42
RADIUS = 2
SHARD = 8192
ONES = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """Majority bits of the shingles' hashes; 0 without words. Null counts as empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < WORDS:
        starts, ends = [0], [len(whole)]
    else:
        starts, ends = [0, *(ends[:-WORDS] + 1).tolist()], ends[WORDS - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the signed long of the 64 bits."""

    def made(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            yield i, _signed(fingerprint(t))

    return map_rows(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), made, "doc_id long, fp long")


class Tree:
    """A BK-tree over integers: [value, {distance: child}]."""

    def __init__(self) -> None:
        self.top: list | None = None

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.top] if self.top else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            for e in range(max(0, d - radius), d + radius + 1):
                if e in children:
                    todo.append(children[e])

    def add(self, x: int) -> None:
        if not self.top:
            self.top = [x, {}]
            return
        node = self.top
        while d := (node[0] ^ x).bit_count():
            if d not in node[1]:
                node[1][d] = [x, {}]
                return
            node = node[1][d]


def _blocks(radius: int) -> list[int]:
    """Masks of the (block, sub-block) keys: within the radius, two values agree under at least one."""
    def cut(bits: list[int], n: int) -> list[list[int]]:
        edges = [round(k * len(bits) / n) for k in range(n + 1)]
        return [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    masks = []
    for block in cut(list(range(64)), radius + 1):
        rest = [k for k in range(64) if k not in block]
        masks += [sum(1 << k for k in block + part) for part in cut(rest, radius + 1)]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(own: list[int], others: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links among own, or between own and others, by a BK-tree over own."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    tree = Tree()
    for x in own:
        if not others:
            for y in tree.near(x, radius):
                if (a := root(x)) != (b := root(y)):
                    above[a] = b
        tree.add(x)
    for x in others:
        for y in tree.near(x, radius):
            if (a := root(x)) != (b := root(y)):
                above[a] = b
    for x in above:
        if (y := root(x)) != x:
            yield x, y


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(fp) without repeats -> (a, b): links that span every group of fingerprints within the radius."""
    keys = F.array(*[F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(_blocks(radius))])
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.m", "key.v")
    sizes = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["m", "v"]).withColumn("c", F.ceil(F.col("n") / shard).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    each = F.transform(
        F.sequence(F.lit(0), F.col("c") - 1),
        lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")),
    )
    dealt = keyed.withColumn("s", mine).withColumn("t", F.explode(each)).select("m", "v", "t.i", "t.j", "s", "fp")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard pair."""
        at, own, others = None, [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for m, v, i, j, s, fp in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (m, v, i, j) != at:
                    if len(own) + len(others) > 1:
                        out += _forest(own, others, radius)
                    at, own, others = (m, v, i, j), [], []
                (own if s == i else others).append(fp & ONES)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([_signed(x) for x in c], pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(own) + len(others) > 1:
            out += _forest(own, others, radius)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x) for x in c], pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt.repartition("m", "v", "i", "j").sortWithinPartitions("m", "v", "i", "j").mapInArrow(found, "a long, b long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Cluster documents whose fingerprints link at radius or fewer differing bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest id
    reachable. Null, empty and blank texts have fingerprint zero and link like any
    other; repeated rows stay and share a component; rows with a null id keep the
    component of their fingerprint (null only if no id is known there); an empty
    table gives no rows; other columns are not read.
    """
    made = settle(fingerprints(documents, id_column, text))
    distinct = settle(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    root = components(links(distinct.select("fp"), radius))
    joined = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left")
    least = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("whole"))
    named = joined.join(least, "root", "left").select("fp", "n", F.coalesce("whole", "least").alias("component_id"))
    return spread_join(made, named, ["fp"], ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class FlatTree:
    """A BK-tree over different values, in arrays, for many queries at once."""

    def __init__(self, values: np.ndarray) -> None:
        children: list[dict[int, int]] = [{} for _ in values]
        for k, x in enumerate(values.tolist()):
            at = 0
            while k and (d := (int(values[at]) ^ x).bit_count()) in children[at]:
                at = children[at][d]
            if k:
                children[at][d] = k
        self.values = values
        self.first = np.cumsum([0, *map(len, children)])
        self.child = np.array([c for n in children for c in n.values()], np.int64)
        self.edge = np.array([d for n in children for d in n], np.int64)

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) for every pair within the radius, following only edges that can lead there."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            d = np.bitwise_count(self.values[node] ^ queries[q]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit]))
            many = self.first[node + 1] - self.first[node]
            from_pair = np.repeat(np.arange(len(q)), many)
            place = np.arange(len(from_pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[node], many)
            close = np.abs(self.edge[place] - d[from_pair]) <= radius
            q, node = q[from_pair[close]], self.child[place[close]]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


STAGE_WORDS, STAGE_RADIUS, SIMILARITY = 5, 30, 0.8
#: Estimates from LOWEST up to HIGHEST, about six and five standard errors off, are left to the sets themselves.
LOWEST, HIGHEST = 0.65, 0.92
HELD = 1 << 20
SKETCH, KEYS, STAGE_SHARD = 256, 8, 4096
_MIX = np.random.default_rng(8).integers(0, 2**63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = b" ".join(words)
    if len(words) <= STAGE_WORDS:
        parts = [whole]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        parts = [whole[s:e] for s, e in zip([0, *(ends[:-STAGE_WORDS] + 1).tolist()], ends[STAGE_WORDS - 1 :].tolist(), strict=True)]
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64))


def sketch(text: str | None) -> tuple[int, int, int, bytes, list[int]]:
    """(digest of the set of shingles, fingerprint, size of the set, min-hashes of 16 bits, whole min-hashes that serve as keys)."""
    words = (text or "").split()
    hashes = shingles(text)
    ones = np.zeros(64, np.int64)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        part = hashes[k : k + 2048]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        mixed = part[:, None] * _MIX[0] + _MIX[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(0))
    fp = int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if words else 0
    digest = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return _signed(digest), _signed(fp), len(hashes), (least >> np.uint64(16)).astype(np.uint16).tobytes(), least[:KEYS].view(np.int64).tolist()


def _verified(a: np.ndarray, b: np.ndarray, labels: Labels, sets: list[np.ndarray], mark: np.ndarray) -> None:
    """Link those pairs whose sets, of places in mark, have a similarity of SIMILARITY or more."""
    for x in np.unique(a).tolist():
        mark[sets[x]] = True
        alike = []
        for y in b[a == x].tolist():
            if labels.at[x] != labels.at[y]:
                both = int(np.count_nonzero(mark[sets[y]]))
                if both / (len(sets[x]) + len(sets[y]) - both) >= SIMILARITY:
                    alike.append(y)
        mark[sets[x]] = False
        if alike:
            labels.link(np.full(len(alike), x), np.array(alike))


def _similar(m: int, rows: list[tuple], exact: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a shard of key m, and unless exact the places of rows that have a pair left to the sets.

    Such a pair is left to the shard of its first common key.
    """
    side = np.array([r[0] != r[1] for r in rows])
    own = np.flatnonzero(~side)
    crossed = bool(side.any())
    asked = np.flatnonzero(side) if crossed else own
    if not len(own) or not len(asked):
        return [], []
    ids = [r[2] for r in rows]
    prints = np.array([r[3] & ONES for r in rows], np.uint64)
    sketches = np.stack([np.frombuffer(r[4], np.uint16) for r in rows])
    keys = np.array([r[5][:m] for r in rows], np.int64).reshape(len(rows), m)
    sizes = np.array([r[6] for r in rows])
    if exact:
        values, place = np.unique(np.concatenate([np.frombuffer(r[7], np.uint64) for r in rows]), return_inverse=True)
        sets, mark = np.split(place.astype(np.int32), np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
    # Equal fingerprints are one node, with its members listed beside the tree.
    values, place, many = np.unique(prints[own], return_inverse=True, return_counts=True)
    members, first = own[np.argsort(place, kind="stable")], np.cumsum(many) - many
    tree, labels = FlatTree(values), Labels(len(rows))
    left = np.zeros(len(rows), bool)
    held = np.zeros((2, 0), np.int64)
    for k in range(0, len(asked), 256):
        q, node = tree.near(prints[asked[k : k + 256]], STAGE_RADIUS)
        p = np.repeat(asked[k : k + 256][q], many[node])
        inner = np.arange(len(p)) - np.repeat(np.cumsum(many[node]) - many[node], many[node])
        q = members[np.repeat(first[node], many[node]) + inner]
        # No two sets are more alike than their sizes.
        fits = np.minimum(sizes[p], sizes[q]) / np.maximum(sizes[p], sizes[q]) >= SIMILARITY
        if not crossed:
            fits &= p > q
        p, q = p[fits], q[fits]
        for j in range(0, len(p), 16384):
            a, b = p[j : j + 16384], q[j : j + 16384]
            apart = labels.at[a] != labels.at[b]
            a, b = a[apart], b[apart]
            share = (sketches[a] == sketches[b]).mean(1)
            sure = share >= HIGHEST
            labels.link(a[sure], b[sure])
            unsure = (share >= LOWEST) & ~sure & ~(left[a] & left[b])
            a, b = a[unsure], b[unsure]
            fresh = ~(keys[a] == keys[b]).any(1)
            a, b = a[fresh], b[fresh]
            if exact:
                _verified(a, b, labels, sets, mark)
                continue
            held = np.concatenate([held, np.stack([a, b])], axis=1)
            if held.shape[1] > HELD:
                held = held[:, labels.at[held[0]] != labels.at[held[1]]]
                if held.shape[1] > HELD // 2:
                    left[held.ravel()] = True
                    held = held[:, :0]
    left[held[:, labels.at[held[0]] != labels.at[held[1]]].ravel()] = True
    links = [(ids[k], ids[int(labels.at[k])]) for k in np.flatnonzero(labels.at != np.arange(len(rows))).tolist()]
    return links, np.flatnonzero(left).tolist()


_LINK = pa.schema([*((c, pa.int64()) for c in ("a", "b")), ("m", pa.int32()), ("v", pa.int64()), *((c, pa.int32()) for c in ("i", "j", "s")), ("cls", pa.int64())])


def _shards(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard pair; out go links, and the rows that the sets have to decide on."""
    key, held, out = None, [], []

    def done() -> None:
        if len(held) > 1:
            links, left = _similar(key[0], held, exact)
            out.extend((a, b, *[None] * 6) for a, b in links)
            out.extend((None, None, *key, held[k][1], held[k][2]) for k in left)

    for batch in batches:
        for m, v, i, j, s, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (m, v, i, j) != key:
                done()
                key, held = (m, v, i, j), []
            held.append((i, s, *rest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LINK, strict=True)], schema=_LINK)
            out = []
    done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LINK, strict=True)], schema=_LINK)


def similar(classes: DataFrame, texts: DataFrame, shard: int | None = None) -> DataFrame:
    """(cls, fp, size, sketch, keys, one) -> (a, b): links that span every group of classes with similarity of SIMILARITY or more.

    Two sets of similarity 0.8 have one of KEYS min-hashes in common but for one case in 400,000;
    the classes that share one make a shard. Its BK-tree gives the pairs within STAGE_RADIUS, and
    their min-hashes the similarity, to a standard error of 0.025; between LOWEST and HIGHEST the
    sets decide, made again from the class's document one in texts (doc_id, digest, text).
    """
    shard = shard or STAGE_SHARD
    keyed = classes.select("cls", F.posexplode("keys").alias("m", "v"))
    sizes = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["m", "v"]).withColumn("c", F.ceil(F.col("n") / shard).cast("int"))
    mine = F.pmod(F.xxhash64("cls"), F.col("c")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    dealt = keyed.withColumn("s", mine).withColumn("t", F.explode(each)).select("m", "v", "t.i", "t.j", "s", "cls")
    columns = ["m", "v", "i", "j", "s", "cls", "fp", "sketch", "keys", "size"]
    schema = "a long, b long, m int, v long, i int, j int, s int, cls long"

    def compared(rows: DataFrame, exact: bool) -> DataFrame:
        rows = rows.repartition("m", "v", "i", "j").sortWithinPartitions("m", "v", "i", "j")
        return stash(rows.mapInArrow(functools.partial(_shards, exact=exact), schema))

    marks = classes.select("cls", "fp", "sketch", "keys", "size")
    first = compared(dealt.join(marks, "cls").select(columns), False)
    links, left = first.where("cls is null").select("a", "b"), first.where("cls is not null").drop("a", "b")
    if is_empty(left):
        return links

    def made(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            yield i, shingles(t).tobytes()

    wanted = left.select("cls").distinct().join(classes.select("cls", "one"), "cls")
    whole = texts.alias("t").join(wanted.alias("w"), F.expr("t.doc_id <=> w.one.doc_id and t.digest = w.one.digest"))
    whole = map_rows(whole.groupBy("cls").agg(F.first("text").alias("text")), made, "cls long, shingles binary", rows_per_batch=256)
    left = left.join(marks, "cls").join(stash(whole), "cls").select(*columns, "shingles")
    return links.unionByName(compared(left, True).select("a", "b"))


def similar_groups(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, component_id, root): groups of documents linked by a similarity of SIMILARITY or more on five-word shingles.

    digest is a hash of the text as it is. Documents with equal sets of shingles are one class. Texts without words
    are alike; a text of five words or fewer is one shingle; the smallest id reachable names a group, and is null
    where no id is known there. root tells groups apart that share the id.
    """

    def made(ids, digests, texts):
        for i, d, t in zip(ids, digests, texts, strict=True):
            yield i, d, *sketch(t)

    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    rows = stash(map_rows(texts, made, "doc_id long, digest long, cls long, fp long, size int, sketch binary, keys array<long>"))
    least = rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    firsts = rows.groupBy("cls").agg(F.max("fp").alias("fp"), F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.max("keys").alias("keys"), F.min(F.struct("doc_id", "digest")).alias("one"))
    root = components(similar(settle(firsts), texts))
    joined = least.join(root.withColumnRenamed("node", "cls"), "cls", "left")
    whole = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("whole"))
    named = joined.join(whole, "root", "left").select("cls", "n", F.coalesce("whole", "least").alias("component_id"), F.coalesce("root", "cls").alias("root"))
    return spread_join(rows.select("doc_id", "digest", "cls"), named, ["cls"], ["doc_id", "digest"]).select("doc_id", "digest", "component_id", "root")


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with one document of each group of similar_groups: the one with the smallest id.

    Of a group's rows that repeat the id, or have none, one stays, that with the least digest.
    Groups that share the id keep a row each.
    """
    kept = settle(similar_groups(documents, id_column, text)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = kept.groupBy("doc_id", "root").agg(F.min("digest").alias("digest"))
    rows = kept.groupBy("doc_id", "digest").agg(F.count("*").alias("_rows"))
    one = settle(one.alias("o").join(rows.alias("r"), F.expr("o.doc_id <=> r.doc_id and o.digest = r.digest")).select("o.doc_id", "o.digest", "_rows"))

    def among(chosen: DataFrame) -> DataFrame:
        same = documents[id_column].cast("long").eqNullSafe(chosen["doc_id"]) & (F.xxhash64(documents[text]) == chosen["digest"])
        return documents.join(chosen, same, "left_semi")

    repeated = one.where("_rows > 1")
    if is_empty(repeated):
        return among(one)
    return among(one.where("_rows = 1")).unionByName(among(repeated).dropDuplicates([id_column, text]))
