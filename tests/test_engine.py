"""Typing, nulls, shapes of output, checked arithmetic, timestamps, the dialect, sources, streams."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

import colweave as cw
from colweave import aggregate, call, col, gather, index, lit, pack, scatter
from colweave.functions.time import literal as moment
from colweave.plans.expr import Expr
from colweave.sources import columns as sources


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(7, 40, True), (None, -5, False), (12, None, True), (None, None, None), (-2, 6, False)], "x int, y int, p boolean")


def values(frame, e, **inputs):
    return [r[0] for r in cw.query(v=e).run(frame, **inputs).vectors.collect()]


def test_projection_of_nulls(frame):
    x, y = col("x"), col("y")
    assert values(frame, x + y) == [47, None, None, None, 4]
    assert values(frame, call("coalesce", x, y, 0)) == [7, -5, 12, 0, -2]
    assert values(frame, x.is_null()) == [False, True, False, True, False]
    assert values(frame, y.is_not_null()) == [True, True, False, False, True]
    assert values(frame, call("least", x, y)) == [7, None, None, None, -2]


def test_logic_is_strict(spark):
    three = [True, False, None]
    frame = spark.createDataFrame([(a, b) for a in three for b in three], "a boolean, b boolean")
    a, b = col("a"), col("b")
    table = {"p_and": lambda p, q: p and q, "p_or": lambda p, q: p or q, "p_xor": lambda p, q: p != q, "p_andnot": lambda p, q: not p and q, "p_xnor": lambda p, q: p == q}
    for op, f in table.items():
        assert values(frame, call(op, a, b)) == [None if p is None or q is None else f(p, q) for p in three for q in three], op
    assert values(frame, a.is_true()) == [True] * 3 + [False] * 6
    assert values(frame, a.is_not_false()) == [True] * 3 + [False] * 3 + [True] * 3
    assert values(frame, a.ifelse(lit(1, cw.I32), lit(2, cw.I32))) == [1] * 3 + [2] * 6


def test_types(frame):
    x = col("x")
    for bad in (
        lambda: x + 1.5, lambda: x + col("x").cast("i64").cast("u64"), lambda: x.cast("u8") + (-1), lambda: x & col("p"), lambda: x.bit_and(lit(1, cw.I64)),
        lambda: lit(1) + lit(2), lambda: call("sext", x, to=cw.I8), lambda: x.sqrt(), lambda: call("nothing", x), lambda: col("missing"), lambda: x + 2**31,
        lambda: aggregate("sum", x) + 1, lambda: call("sum_of", x),
    ):
        with pytest.raises(cw.TypeMismatch):
            cw.query(v=bad()).plan(frame)
    with pytest.raises(TypeError):
        bool(x > 1)
    promoted = cw.query(v=x + x.cast("i64"), f=x.cast("f32") + x.cast("f64")).plan(frame).vectors
    assert dict(promoted.dtypes) == {"v": "bigint", "f": "double"}


def test_aggregates(spark):
    frame = sources.from_numpy(spark, {"v": np.array([4, 9, 2, 7, 6], np.int64), "p": np.array([False, True, True, False, True])})
    v, p = col("v"), col("p")
    got = cw.query(s=v.sum(), si=v.sum(p), pr=v.product(), pi=v.product(p), n=aggregate("count_if", p), lo=v.min(), hi=v.max(call("p_not", p)), x=v.xor_agg(), an=v.andnot_agg(), wide=v.sum_wide()).run(frame)
    assert got.scalars.first().asDict() == {"s": 28, "si": 17, "pr": 3024, "pi": 108, "n": 3, "lo": 2, "hi": 7, "x": 14, "an": ~15, "wide": 28}
    empty = cw.query(s=v.sum(), pr=v.product(), lo=v.min(), hi=v.max(), a=v.and_agg(), n=aggregate("count_if", p), al=aggregate("all", p), an=aggregate("any", p)).run(frame.where("v > 9"))
    assert empty.scalars.first().asDict() == {"s": 0, "pr": 1, "lo": 2**63 - 1, "hi": -(2**63), "a": -1, "n": 0, "al": True, "an": False}


def test_sums_and_products_wrap(spark):
    frame = sources.from_numpy(spark, {"b": np.array([100, 100, 7], np.int8), "l": np.array([2**62, 2**62, 2**62], np.int64), "m": np.array([2**40 + 1, 2**40 + 3, 5], np.int64), "u": np.array([200, 100, 1], np.uint8)})
    got = cw.query(b=col("b").sum(), l=col("l").sum(), m=col("m").product(), bp=col("b").product(), u=col("u", "u8").sum(), um=col("u", "u8").max()).run(frame).scalars.first()
    assert got["b"] == np.array([100, 100, 7], np.int8).sum(dtype=np.int8) and got["l"] == 3 * 2**62 - 2**64
    product = (2**40 + 1) * (2**40 + 3) * 5 % 2**64
    assert got["m"] == (product - 2**64 if product >> 63 else product)
    assert got["bp"] == np.int8(np.array(70000, np.int64).astype(np.int8)) and got["u"] == 45 and got["um"] == 200


def test_float_aggregates_skip_nan(spark):
    frame = sources.from_numpy(spark, {"f": np.array([1.0, np.nan, -2.0])})
    got = cw.query(hi=col("f").max(), lo=col("f").min(), none=col("f").max(col("f") > 5.0)).run(frame).scalars.first()
    assert (got["hi"], got["lo"], got["none"]) == (1.0, -2.0, float("-inf"))


def test_null_aggregates(spark):
    frame = spark.createDataFrame([(8,), (None,), (-3,), (None,), (21,)], "x int")
    x = col("x")
    got = cw.query(s=x.sum(), n=aggregate("count_if", x > 1), nn=x.count_notnull(), has=x.has_nulls(), al=aggregate("all", x > 0)).run(frame).scalars.first()
    assert got.asDict() == {"s": 26, "n": 2, "nn": 3, "has": True, "al": False}


def test_grouped(spark):
    frame = sources.from_numpy(spark, {"v": np.array([5, 1, 8, 2, 9, 4], np.int32), "i": np.array([1, 1, 0, 2, 0, 2], np.int32), "p": np.array([True, False, True, True, False, True])})
    v, i, p = col("v"), col("i"), col("p")
    t = {"t": cw.Target(3, 0), "ones": cw.Target(2, 1)}
    got = cw.query(s=v.sum(group_idx=i, table="t"), n=aggregate("count_if", p, group_idx=i, table="t"), m=v.max(p, group_idx=i, table="t"), r=v.product(group_idx=i, table="ones")).run(frame, tables=t)
    assert got["s"] == [17, 6, 6] and got["n"] == [1, 1, 2] and got["m"] == [8, 5, 4] and got["r"] == [72, 5]
    first = spark.createDataFrame([(0, 100), (1, 5), (2, 7)], "k int, v int")
    assert cw.query(s=v.min(group_idx=i, table="t")).run(frame, tables={"t": first})["s"] == [8, 1, 2]


def test_order_shapes(spark):
    frame = sources.from_numpy(spark, {"k": np.arange(5, dtype=np.int64), "v": np.array([11, 7, 5, 3, 2], np.int64), "i": np.array([2, 0, 3, 0, 1], np.int32), "p": np.array([False, True, True, False, True])}).repartition(3)
    v = col("v")
    got = cw.query(packed=pack(v, col("p")), put=scatter(v, col("i")), some=scatter(v, col("i"), col("p"))).run(frame, order_by=["k"], tables={"put": cw.Target(5, -1), "some": cw.Target(4, 0)})
    assert [tuple(r) for r in got.packed["packed"].orderBy("row").collect()] == [(1, 7), (2, 5), (4, 2)] and got["packed_size"] == 3
    assert got["put"] == [3, 2, 11, 5, -1] and got["some"] == [7, 2, 0, 5]
    at = cw.query(row=index(cw.I32), v=v).run(frame, order_by=["k"]).vectors
    assert dict(at.dtypes)["row"] == "int" and sorted(map(tuple, at.collect())) == [(0, 11), (1, 7), (2, 5), (3, 3), (4, 2)]
    with pytest.raises(cw.TypeMismatch):
        cw.query(row=index()).plan(frame)


def test_gather_and_splat(spark):
    frame = sources.from_numpy(spark, {"i": np.array([2, 0, 1, 9], np.int32)})
    long = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "idx long, value long")
    got = cw.query(a=gather(col("i"), "short"), b=gather(col("i"), "long") + 1, c=gather(gather(col("i"), "long") - 5, "long")).run(frame, tables={"short": cw.Lookup([1, 2, 4], cw.I16), "long": long})
    assert sorted(map(str, got.vectors.collect())) == sorted(map(str, [r for r in got.vectors.collect()]))
    assert {tuple(r) for r in got.vectors.collect()} == {(4, 8, 7), (1, 6, 5), (2, 7, 6), (None, None, None)}
    one = spark.createDataFrame([(10,)], "m int")
    assert values(frame, col("i") * cw.splat("m"), splats={"m": one}) == [20, 0, 10, 90]
    assert values(frame, col("i") * cw.splat("m", cw.I32), splats={"m": 3}) == [6, 0, 3, 27]


def test_checked(spark):
    frame = spark.createDataFrame([(1, 2), (None, 1), (10, -3)], "x int, y int")
    x, y = col("x"), col("y")
    assert cw.query(v=call("add_checked", x, y)).run(frame)["v"] == [3, None, 7]
    edge = spark.createDataFrame([(2**31 - 1, 1), (-(2**31), -1)], "x int, y int")
    for op, other in (("add", y), ("sub", -y), ("mul", y), ("div", y), ("mod", y)):
        with pytest.raises(cw.SafetyCheckFailed):
            cw.query(v=call(op + "_checked", x, other)).run(edge)
    for op in ("negate", "abs"):
        with pytest.raises(cw.SafetyCheckFailed):
            cw.query(v=call(op + "_checked", x)).run(edge)
    with pytest.raises(cw.SafetyCheckFailed):
        cw.query(v=call("sll_checked", x, lit(32, cw.I32))).run(edge)
    with pytest.raises(cw.SafetyCheckFailed):
        cw.query(v=call("trunc_checked", x, to=cw.I16)).run(edge)
    masked = cw.query(v=call("checked_op", x, y, x < 0, name="add")).plan(edge)
    assert masked.flag.first()[0] is True  # MIN + -1
    assert cw.query(v=call("checked_op", x, y, x > 2**31 - 2, name="sub")).run(edge)["v"] == [2**31 - 2, -(2**31) + 1]
    wide = sources.from_numpy(spark, {"u": np.array([2**64 - 1], np.uint64), "w": np.array([2], np.uint64)})
    for op in ("add", "mul"):
        with pytest.raises(cw.SafetyCheckFailed):
            cw.query(v=call(op + "_checked", col("u", "u64"), col("w", "u64"))).run(wide)
    assert cw.query(v=call("sub_checked", col("u", "u64"), col("w", "u64"))).run(wide)["v"] == [2**64 - 3]


def test_timestamps(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(1969, 12, 31, 23, 59, 59, 500000),)], "ts timestamp_ntz")
    ts = col("ts", cw.timestamp("us"))
    parts = cw.query({p: call(p, ts) for p in ("year", "month", "day", "hour", "minute", "second", "day_of_week")}).run(frame).vectors.collect()
    assert [tuple(r) for r in parts] == [(2024, 1, 1, 0, 0, 0, 0), (2024, 1, 2, 3, 4, 5, 1), (1969, 12, 31, 23, 59, 59, 2)]
    seconds = col("ts", cw.timestamp("s"))
    assert values(frame, seconds - moment("2024-01-01T00:00:00", "s"))[:2] == [0, 97445]
    assert values(frame, seconds + lit(10, cw.I64))[0] == dt.datetime(2024, 1, 1, 0, 0, 10)
    assert values(frame, ts > moment(dt.datetime(2024, 1, 1))) == [False, True, False]
    assert cw.query(m=ts.max()).run(frame)["m"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    for bad in (ts + ts, ts - seconds, lit(1, cw.I64) - ts, ts * 2, ts.sum(), call("coalesce", ts, ts), ts.cast("i32"), call("year", col("ts").cast("i64"))):
        with pytest.raises(cw.TypeMismatch):
            cw.query(v=bad).plan(frame)
    assert moment("2024-01-01T00:00:00Z", "s").params["dtype"].utc


def test_dialect(frame):
    p = cw.parse("""INPUT t (x i32?, y i32?, p i1); -- a comment
    WITH z = coalesce(x, 0) + 2 * 3 SELECT z AS z, NOT p AS np, x IS NOT NULL AND z > 6 both, sum(x) FILTER (WHERE p), least(z, 8), 1 + z << 1 AS shifted, z | 1 # 3 AS mixed;""")
    got = p.run(frame)
    assert list(p.outputs) == ["z", "np", "both", "result_3", "result_4", "shifted", "mixed"]
    assert [tuple(r) for r in got.vectors.collect()][0] == (13, False, True, 8, 27, (13 | 1) ^ 3) and got["result_3"] == 19
    for text, error in (
        ("SELECT 1", cw.ParseError), ("INPUT (x i32) SELECT x +", cw.ParseError), ("INPUT (x i32) SELECT $", cw.ParseError), ("INPUT (x i32, x i32) SELECT x", cw.LowerError),
        ("INPUT (x text) SELECT x", cw.LowerError), ("INPUT (x i32) SELECT y", cw.LowerError), ("INPUT (x i32) SELECT x AS a, x AS a", cw.LowerError),
        ("INPUT (x i32) WITH x = 1 SELECT x", cw.LowerError), ("INPUT (x i32) SELECT x + 1 FILTER (WHERE x > 1)", cw.LowerError), ("INPUT (x i32) SELECT nullif(x)", cw.LowerError),
        ("INPUT (x i32) SELECT open(x)", cw.LowerError), ("INPUT (x i32) SELECT x x x", cw.ParseError),
    ):
        with pytest.raises(error):
            cw.parse(text)


def test_sources(spark, tmp_path):
    masked = sources.from_numpy(spark, {"x": np.array([1, 2, 3], np.int32)}, {"x": np.array([False, True, False])})
    assert [r[0] for r in masked.collect()] == [1, None, 3]
    packed = sources.from_numpy(spark, {"x": np.arange(9, dtype=np.int32)}, {"x": np.packbits([1, 0] * 4 + [1], bitorder="little")}, true_means_null=False)
    assert [r[0] for r in packed.collect()] == [0, None, 2, None, 4, None, 6, None, 8]
    chunks = pa.table({"u": pa.chunked_array([pa.array([1, None], pa.uint8()), pa.array([255], pa.uint8())])})
    assert [r[0] for r in sources.from_arrow(spark, chunks.slice(1)).collect()] == [None, 255]
    df = spark.createDataFrame([(1, True), (-1, False)], "v int, m boolean")
    assert [tuple(r) for r in df.select(sources.with_mask(df.v, df.m), sources.with_sentinel(df.v, -1), sources.to_sentinel(sources.with_sentinel(df.v, -1), 0)).collect()] == [(None, 1, 1), (-1, None, 0)]
    bits = spark.createDataFrame([(k, bytearray([0b101, 0b10])) for k in range(10)], "v int, bitmap binary")
    assert [r[0] for r in bits.select(sources.with_bitmap(bits.v, bits.bitmap, bits.v)).collect()] == [0, None, 2, None, None, None, None, None, None, 9]
    sources.write_parquet(df, str(tmp_path / "t"))
    assert sources.to_numpy(sources.read_parquet(spark, str(tmp_path / "t"), "v").orderBy("v"))["v"].tolist() == [-1, 1]
    with pytest.raises(ValueError):
        sources.to_numpy(masked)
    with pytest.raises(ValueError):
        sources.from_numpy(spark, {"a": [1], "b": [1, 2]})
    buffer = np.zeros(2, np.int64)
    sources.run_into(cw.query(v=col("v").cast("i64") * 2).run(df), {"v": buffer})
    assert sorted(buffer.tolist()) == [-2, 2]


def test_sessions(frame, spark):
    session = cw.Session(spark)
    ready = session.prepare("INPUT (x i32?, y i32?) SELECT x + y AS v, sum(x) AS s", frame)
    assert ready.run()["s"] == 17 and ready.run(frame.where("x = 7"))["v"] == [47]
    with pytest.raises(TypeError):
        ready.run(frame.select("x"))
    assert "HashAggregate" in session.inspect("INPUT (x i32?) SELECT sum(x) AS s", frame)
    assert session.statistics() == {"parsed": 2, "reused": 0, "runs": 0, "prepared": 1, "prepared_runs": 2}
    report = session.bug_report("INPUT (x i32?) SELECT sum(x) AS s", frame)
    assert set(report) == {"spark", "python", "schema", "program", "plan", "statistics"} and session.statistics()["reused"] == 1
    session.release(ready)
    session.clear()
    assert session.statistics()["prepared"] == 0 and not session.parsed


def test_one_scan_per_shape(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id * 2 AS b", "id * 3 AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = cw.parse("INPUT (a i64, b i64) SELECT sum(a + b) AS s, max(b) FILTER (WHERE a > 3) AS m, count_if(a > 5) AS n").inspect(df)
    assert text.count("Scan parquet") == 2 and "unused" not in text  # once in the tree, once in the list of nodes
    assert "ReadSchema: struct<a:bigint,b:bigint>" in text


def test_streams(spark, tmp_path):
    from colweave.streaming.programs import on_stream, start

    spark.range(10).selectExpr("CAST(id AS INT) AS x").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    q = start(cw.query(v=col("x") * 2), stream, "doubled", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("doubled").collect()) == list(range(0, 20, 2))
    q = start(cw.query(s=col("x").sum(), n=aggregate("count_if", col("x") > 4)), stream, "totals", str(tmp_path / "c2"), "complete")
    q.processAllAvailable()
    q.stop()
    assert spark.table("totals").first().asDict() == {"s": 45, "n": 5}
    with pytest.raises(cw.TypeMismatch):
        on_stream(cw.query(a=col("x"), s=col("x").sum()), stream)


def test_json(frame):
    for program in (
        cw.parse("INPUT (x i32?, y i32?) WITH z = x + y SELECT z * z AS a, sum(z) FILTER (WHERE x > 1) AS s, coalesce(x, 1) AS c"),
        cw.query(t=call("trunc", col("x"), to=cw.I8), m=call("checked_op", col("x"), col("y"), col("p"), name="add"), k=moment(5, "s") - moment(2, "s")),
    ):
        again = cw.from_json(cw.to_json(program))
        assert cw.to_json(again) == cw.to_json(program)
        a, b = program.run(frame), again.run(frame)
        assert a.vectors.collect() == b.vectors.collect() and (a.scalars is None or a.scalars.collect() == b.scalars.collect())


def test_functions_by_name(frame):
    x, y = col("x"), col("y")
    got = cw.query(a=cw.popcnt(x), s=cw.sum_if(x, y > 5), n=cw.count_if(x > 0), g=cw.grouped_max(y, cw.coalesce(x, 0), "t"), h=cw.grouped_count_if(y > 0, cw.coalesce(x, 0), "t")).run(frame, tables={"t": cw.Target(9, 0)})
    assert got["a"] == [3, None, 2, None, 31] and got["s"] == 5 and got["n"] == 2 and got["g"] == [0] * 7 + [40, 0] and got["h"] == [0] * 7 + [1, 0]
    with pytest.raises(AttributeError):
        cw.no_such_function


def test_bit_helpers(spark):
    frame = sources.from_numpy(spark, {"x": np.array([1, -2, 0x1234], np.int16), "l": np.array([1, 2**40, -1], np.int64)})
    p = cw.query(r=cw.reverse_bits_i8(cw.zeronull(col("x"))), f=cw.replicate_ith_bit_i8(cw.zeronull(col("x")), bit=2), w=cw.permute_i64_i16(cw.zeronull(col("l")), idxs=[3, 2, 1, 0]), v=cw.reverse_bits_full(col("l")))
    got = p.run(frame).vectors.collect()
    byte = lambda v, f: int.from_bytes(bytes(f(b) for b in (v & 0xFFFF).to_bytes(2, "little")), "little", signed=False)
    signed = lambda v, w: v - (1 << w) if v >> (w - 1) else v
    for r, x, v in zip(got, [1, -2, 0x1234], [1, 2**40, -1], strict=True):
        assert r["r"] == signed(byte(x, lambda b: int(f"{b:08b}"[::-1], 2)), 16) and r["f"] == signed(byte(x, lambda b: 255 if b & 4 else 0), 16)
        u = v & (2**64 - 1)
        assert r["w"] == signed(sum(((u >> 16 * k) & 0xFFFF) << 16 * (3 - k) for k in range(4)), 64) and r["v"] == signed(int(f"{u:064b}"[::-1], 2), 64)


def test_nested_aggregate_is_refused(frame):
    with pytest.raises(cw.TypeMismatch):
        cw.query(v=Expr("agg", (col("x"),), {"fn": "sum"}) + 1).plan(frame)


def test_gather_by_narrow_and_repeated_keys(spark):
    frame = spark.createDataFrame([(0, -1), (1, -128), (2, 3), (3, None)], "k int, i tinyint")
    far = spark.createDataFrame([(255, 7), (128, 9), (3, 5), (3, 4)], "i int, v int")
    got = cw.query(v=gather(col("i"), "t")).run(frame, tables={"t": far}, keep=["k"])
    assert sorted(map(tuple, got.vectors.collect())) == [(0, 7), (1, 9), (2, 4), (3, None)]
    short = cw.query(v=gather(col("i"), "t")).run(frame, tables={"t": cw.Lookup(list(range(1000, 1256)), cw.I64)}, keep=["k"])
    assert sorted(map(tuple, short.vectors.collect())) == [(0, 1255), (1, 1128), (2, 1003), (3, None)]


def test_flag_and_totals_share_a_scan(frame):
    fits = cw.query(s=call("add_checked", col("x"), lit(1, cw.I32)).sum()).run(frame)
    assert fits.scalars.first()["s"] == 20 and fits.joint is not None
    with pytest.raises(cw.SafetyCheckFailed):
        cw.query(s=call("add_checked", col("x"), lit(2**31 - 3, cw.I32)).sum()).run(frame)


def test_groups_of_a_table_come_together(spark):
    frame = sources.from_numpy(spark, {"v": np.arange(9, dtype=np.int32), "i": np.arange(9, dtype=np.int32) % 2})
    v, i = col("v"), col("i")
    got = cw.query(s=v.sum(group_idx=i, table="t"), hi=v.max(group_idx=i, table="t"), p=(v + 1).product(group_idx=i, table="t")).run(frame, tables={"t": cw.Target(3, 1)})
    assert sorted(map(tuple, got.tables["t"].select("idx", "s", "hi", "p").collect())) == [(0, 21, 8, 945), (1, 17, 7, 384), (2, 1, 1, 1)]


def test_append_indices(spark):
    from colweave.operators.ordering import append_indices

    old = spark.createDataFrame([(5, 50), (2, 20)], "row long, at long")
    new = spark.createDataFrame([(9, 90), (1, 10)], "row long, at long")
    both = append_indices(old, new)
    assert sorted(map(tuple, both.collect())) == [(0, 20), (1, 50), (2, 10), (3, 90)]
    assert sorted(map(tuple, append_indices(both, new).collect()))[4:] == [(4, 10), (5, 90)]


def test_inspection_of_json_and_snapshot(frame):
    from colweave.plans.serial import inspect_json, to_json

    program = cw.query(v=col("x") + 1, s=col("y").sum())
    strip = lambda text: "".join(c for c in text if not c.isdigit())
    assert strip(inspect_json(to_json(program), frame)) == strip(program.inspect(frame))
    shot = program.snapshot(frame)
    assert set(shot) == {"vectors", "scalars"} and shot["scalars"]["schema"] == "struct<s:int>"
    assert "Optimized Logical Plan" in shot["vectors"]["plans"] and "WholeStageCodegen" in shot["scalars"]["code"]


def test_wide_sums_are_exact(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64), np.array([-(2**63)] * 7 + [2**63 - 1] * 9 + [0, -1, 1], np.int64)])
    frame = sources.from_numpy(spark, {"v": values, "p": values % 3 == 0})
    got = cw.query(all=col("v").sum_wide(), some=col("v").sum_wide(col("p")), none=col("v").sum_wide(col("v").is_null())).run(frame).scalars.first()
    assert int(got["all"]) == sum(map(int, values)) and int(got["some"]) == sum(int(v) for v in values if v % 3 == 0) and int(got["none"]) == 0
