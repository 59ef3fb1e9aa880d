"""SimHash, embeddings, repeated strings and components against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from colweave.llm import common, embeddings, repeats, simhash
from colweave.llm.components import components

from .conftest import prose


def closure(items, linked):
    """Components of items by brute force: item -> least item reachable."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts, word = [], ""
    for c in words + " ":
        if c in " \t\n\v\f\r":
            if word:
                parts.append(word)
            word = ""
        else:
            word += c
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + 3]) for k in range(max(1, len(parts) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def corpus(rng):
    rows = [(k, prose(rng, words=rng.randrange(1, 90))) for k in range(60)]
    for k in range(60, 100):
        words = rows[rng.randrange(60)][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(100, rows[5][1]), (101, rows[5][1].upper()), (102, None), (103, ""), (104, " \t\n"), (105, "one"), (106, "one two"), (107, "ÄÖ\u00a0é x\u2003y ſ K"), (108, "w " * 50_000)]
    return rows + [(5, rows[5][1]), (None, rows[7][1]), (None, "nothing like any other text here")]


def test_simhash(docs, rng):
    rows = corpus(rng)
    got = simhash.near_duplicates(docs(rows)).collect()
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, f in prints)
    component = closure({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in prints:
        if i is not None:
            least[component[f]] = min(i, least.get(component[f], i))
    for r in got:
        assert r["component_id"] == least.get(component[int(r["fingerprint"], 16)])


def test_simhash_shards(spark):
    """Shards of a crowded key find the links that one tree does."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    want = closure(values, lambda a, b: (a ^ b).bit_count() <= 2)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    for shard in (8192, 16):
        edges = [(r.a & simhash.ONES, r.b & simhash.ONES) for r in simhash.links(frame, shard=shard).collect()]
        assert all((a ^ b).bit_count() for a, b in edges)
        pairs = {frozenset(e) for e in edges}
        assert closure(values, lambda a, b: frozenset((a, b)) in pairs) == want


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_deduplicate(docs, rng, monkeypatch):
    """One row of every group linked at a similarity of 0.8; pairs nearer to 0.8 than the sketch's error are not in the rows."""
    texts = [prose(rng, words=rng.randrange(60, 200)) for _ in range(40)]
    for k in range(30):
        words = texts[k].split()
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), None, "", " \n", "one two", "ONE two", "one two three", "w " * 30_000]
    sets = [shingles(t) for t in texts]
    alike = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    unclear = {k for k in range(len(texts)) if any(0.72 < alike[k][j] < 0.88 for j in range(len(texts)))}
    rows = [(k, t) for k, t in enumerate(texts) if k not in unclear]
    component = closure([k for k, _ in rows], lambda a, b: alike[a][b] >= 0.8)
    rows += [(3, texts[3]), (None, texts[3]), (None, "no other text is like this one, which has no id"), (None, "no other text is like this one, which has no id")]
    frame = docs(rows)
    for shard in (4096, 4):
        monkeypatch.setattr(simhash, "STAGE_SHARD", shard)
        kept = simhash.deduplicate(frame)
        assert kept.columns == frame.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == sorted(set(component.values())) and ids.count(None) == 1
    assert len(set(component.values())) < len(rows) - 15


def test_deduplicate_near_the_limit(docs, rng, monkeypatch):
    """Pairs from 0.72 to 0.88, and short ones at 0.8 itself, are decided by their sets."""
    def words(n):
        return [f"w{rng.getrandbits(48)}" for _ in range(n)]

    pairs = []
    for t in range(13, 32):
        for _ in range(8):
            base = words(200)
            pairs.append((base, base[:-t] + words(t)))
    pairs += [(base, base[:8]) for base in (words(9) for _ in range(150))]
    texts = [" ".join(w) for pair in pairs for w in pair]
    want = []
    for k in range(0, len(texts), 2):
        a, b = shingles(texts[k]), shingles(texts[k + 1])
        want += [k] if len(a & b) / len(a | b) >= 0.8 else [k, k + 1]
    for shard, held in ((4096, 1 << 20), (1, 0)):
        monkeypatch.setattr(simhash, "STAGE_SHARD", shard)
        monkeypatch.setattr(simhash, "HELD", held, raising=False)
        assert sorted(r["doc_id"] for r in simhash.deduplicate(docs(list(enumerate(texts)))).collect()) == want


def test_deduplicate_repeated_ids(docs, rng):
    """Groups that share their smallest id, or have none, keep a document each."""
    a, b, c = ([f"w{rng.getrandbits(48)}" for _ in range(100)] for _ in range(3))
    rows = [(1, a), (1, b), (2, a[:-1]), (3, b[:-1]), (1, a[:-2]), (None, c), (None, c[:-1])]
    kept = simhash.deduplicate(docs([(k, " ".join(w)) for k, w in rows])).collect()
    assert sorted((str(r["doc_id"]), r["text"].split()[0]) for r in kept) == sorted([("1", a[0]), ("1", b[0]), ("None", c[0])])


def test_flat_tree():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    q, member = simhash.FlatTree(values).near(values, 3)
    assert sorted(zip(q.tolist(), member.tolist(), strict=True)) == sorted((a, b) for a, x in enumerate(values.tolist()) for b, y in enumerate(values.tolist()) if (x ^ y).bit_count() <= 3)


def test_simhash_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.deduplicate(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, rng.randrange(2000, 2100)) for _ in range(80)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)]
    edges += [(7, 7), (9000, 9000), (1, 0), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    pairs = {frozenset(e) for e in edges}
    want = closure(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert set(got) == nodes
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in nodes})
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def vectors(rng, n=120, d=24):
    out = []
    for k in range(n):
        if k % 3 and out:
            base = out[rng.integers(len(out))]
            out.append(base + rng.normal(size=d) * rng.choice([0.02, 0.04, 0.06]) * np.linalg.norm(base))
        else:
            out.append(rng.normal(size=d))
    return [v.astype(np.float32) for v in out]


@pytest.mark.parametrize("d,shard", [(40, 4096), (40, 8), (3, 4096), (1, 4096)])
def test_embeddings(spark, d, shard):
    rng = np.random.default_rng(d)
    made = vectors(rng, 120, d)
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(made)]
    rows += [(200, rows[4][1], 0), (201, rows[4][1], 0), (202, rows[4][1], 1), (203, None, 0), (204, [], 0), (205, [0.0] * d, 0), (206, [math.nan] * d, 0)]
    rows += [(207, [math.inf] * d, 0), (208, [None] * d, 0), (209, rows[4][1], None), (4, rows[4][1], 0), (210, (np.array(rows[4][1]) * 2).tolist(), 0), (211, [1.0] * (d + 1), 0), (212, [1e30] * d, 0), (213, [1e-30] * d, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS cls", "2 AS n")
    got = embeddings.near_duplicates(frame, shard=shard).collect()

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, u, p), (_, v, q) = rows[a], rows[b]
        if a == b or not usable(u, p) or not usable(v, q) or p != q or len(u) != len(v):
            return False
        x, y = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98

    n = len(rows)
    links = [sum(linked(a, b) for b in range(n)) for a in range(n)]
    component = closure(range(n), linked)
    least = {}
    for k in range(n):
        least[component[k]] = min(rows[k][0], least.get(component[k], rows[k][0]))
    want = Counter((rows[k][0], links[k], least[component[k]], rows[k][0] == least[component[k]]) for k in range(n))
    assert Counter(tuple(r) for r in got) == want
    assert sum(links) > 50


def test_embeddings_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(frame).collect() == []
    lone = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embeddings.near_duplicates(lone).collect()] == [(None, 1, None, False)] * 2


def slow_repeats(texts, size=200):
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                covered[k : k + size] = b"\1" * size
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(t, covered, strict=True) if not c)).hexdigest()))
    return out


def repeated_corpus(rng):
    passage = prose(rng, words=70)
    texts = [prose(rng, words=rng.randrange(1, 200)) for _ in range(12)]
    texts += [prose(rng, words=20) + " " + passage + " " + prose(rng, words=20) for _ in range(25)]
    texts += [texts[0], texts[0][:150], "é" + texts[1], texts[2][5:230] if len(texts[2]) > 230 else texts[3], "ab" * 300, "x" * 199, "x" * 200, "y" * 201, None, "", passage + passage]
    edited = list(texts[13])
    edited[90] = "#"
    return [*texts, "".join(edited)]


@pytest.mark.parametrize("key,task,shard,stretch", [(1 << 17, 1 << 19, 1 << 17, 1 << 20), (600, 2000, 700, 90), (0, 2000, 700, 1 << 20)])
def test_repeats(docs, rng, monkeypatch, key, task, shard, stretch):
    """Compared, partly counted and all counted; texts in one stretch and in many."""
    monkeypatch.setattr(repeats, "STRETCH", stretch)
    monkeypatch.setattr(repeats, "KEY_BYTES", key)
    monkeypatch.setattr(repeats, "TASK_BYTES", task)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rows = list(enumerate(repeated_corpus(rng)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, prose(rng, words=90))]
    got = repeats.digest(repeats.remove(docs(rows))).collect()
    want = slow_repeats([(t or "").encode() for _, t in rows])
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def held_repeats(docs, rows):
    got = repeats.digest(repeats.remove(docs(rows))).collect()
    want = slow_repeats([(t or "").encode() for _, t in rows])
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    return sum(w[1] for w in want)


def test_repeats_of_one_byte(docs, rng):
    """Runs of one byte in more lengths than a task takes, alone and inside prose."""
    rows = [(k, "=" * (200 + k)) for k in range(300)]
    assert held_repeats(docs, rows) == 104850
    rows = [(k, prose(rng, words=9) + " " + "-" * (200 + k) + " " + prose(rng, words=9)) for k in range(300)]
    assert held_repeats(docs, rows) > 104850


def test_repeats_of_near_copies(docs, rng):
    """More near copies of a text than a task compares, each edited elsewhere."""
    base = prose(rng, words=200)
    rows = []
    for k in range(700):
        at = rng.randrange(len(base))
        rows.append((k, base[:at] + f"#{k}" + base[at + 1 :]))
    assert held_repeats(docs, rows) > 0


def test_repeats_of_equal_rows(docs, rng, spark):
    """Equal rows, some without an id: spans grow with the rows, not with their square."""
    rows = [(7, prose(rng, words=120))] * 500 + [(None, prose(rng, words=120))] * 60 + [(8, prose(rng, words=120))]
    assert held_repeats(docs, rows) > 0
    frame = docs(rows[:500])
    assert repeats.remove(frame).selectExpr("max(size(spans))").first()[0] == 1


def test_repeats_in_a_long_text(docs, rng):
    passage = prose(rng, words=60)
    long = prose(rng, words=30_000)
    assert held_repeats(docs, [(0, long + passage + long[:5000]), (1, passage), (2, prose(rng, words=50))]) > 5000


def test_discard(spark):
    from pathlib import Path

    common.discard(spark)
    kept = common.stash(spark.range(5))
    path = Path(common._written[-1].removeprefix("file:"))
    assert kept.count() == 5 and path.is_dir()
    assert common.discard(spark) == 1 and not path.exists() and common.discard(spark) == 0


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 10)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(400)], "a int, b int")
    counts = rows.groupBy("a").count().withColumnRenamed("count", "n").where("a <> 5")
    got = common.spread_join(rows, counts.withColumn("x", counts["a"] * 10), ["a"], ["b"])
    assert got.columns == ["a", "b", "x"]
    assert sorted(map(tuple, got.collect())) == sorted((a, b, a * 10) for a, b in map(tuple, rows.collect()) if a != 5)


def test_repeats_empty(docs):
    assert repeats.remove(docs([])).count() == 0


def test_transforms_merge():
    rng = random.Random(4)
    base = bytes(rng.choices(b"abc", k=3000))
    texts = [base[a : a + rng.randrange(200, 700)] for a in (rng.randrange(0, 2500) for _ in range(30))] + [b"z" * 900]
    texts = [t for t in texts if len(t) >= 200]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for flags, t in zip(repeats.repeated(texts), texts, strict=True):
        assert flags.tolist() == [seen[t[k : k + 200]] > 1 for k in range(len(t) - 199)]
