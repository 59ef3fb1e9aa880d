"""Operators that the other suites do not reach."""

import datetime as dt

import numpy as np
import pytest

import colweave as cw
from colweave import aggregate, call, col, lit
from colweave.functions.time import literal as moment
from colweave.sources.columns import from_numpy


@pytest.fixture(scope="module")
def frame(spark):
    return from_numpy(
        spark,
        {"x": np.array([-5, 0, 7, 2**31 - 1], np.int32), "y": np.array([3, 0, -2, 33], np.int32), "f": np.array([4.0, 0.25, 0.0, -1.0]), "u": np.array([1, 2**63, 2**64 - 1, 0], np.uint64), "p": np.array([True, False, True, False])},
    )


def values(frame, e, **inputs):
    return [r[0] for r in cw.query(v=e).run(frame, **inputs).vectors.collect()]


def test_reciprocals(frame):
    got = values(frame, cw.rsqrt(col("f")))
    assert got[:3] == [0.5, 2.0, float("inf")] and got[3] != got[3]
    assert values(frame, cw.rcp(col("f"))) == [0.25, 4.0, float("inf"), -1.0]
    assert dict(cw.query(v=cw.sqrt(col("f").cast("f32"))).plan(frame).vectors.dtypes) == {"v": "float"}


def test_generic_forms(frame):
    x, y = col("x"), col("y")
    assert values(frame, call("cmp", x, y, kind="lt")) == values(frame, x < y)
    assert values(frame, call("cmp", x, y, kind="lt", unsigned=True)) == [False, False, True, False]
    assert values(frame, call("uge", x, y)) == [True, True, False, True]
    assert values(frame, call("float_cast", x, to=cw.F64, is_unsigned=True))[0] == 2**32 - 5
    assert values(frame, call("int_cast", x, kind="trunc", to=cw.I8)) == [-5, 0, 7, -1]
    assert values(frame, cw.andnot(col("p"), x > 0)) == [False, False, False, True] and values(frame, cw.not_(col("p"))) == [False, True, False, True]
    assert values(frame, cw.xnor(x, y)) == [~(a ^ b) for a, b in ((-5, 3), (0, 0), (7, -2), (2**31 - 1, 33))]
    assert values(frame, cw.uleast(x, y)) == [3, 0, 7, 33] and values(frame, cw.ugreatest(x, y)) == [-5, 0, -2, 2**31 - 1]
    assert values(frame, cw.copysign_no_zero(x, y)) == [-5, 0, -7, 2**31 - 1]
    assert values(frame, col("p").ifelse(x, y)) == [-5, 0, 7, 33]


@pytest.mark.parametrize("op,bad", [("sll", True), ("srl", True), ("sra", True), ("rotl", True), ("rotr", True), ("udiv", True), ("umod", True), ("div", True), ("mod", True)])
def test_checked_pairs(frame, op, bad):
    program = cw.query(v=call(op + "_checked", col("x"), col("y")))
    assert program.plan(frame).flag.first()[0] is bad
    fine = frame.where("y = 3")
    assert program.run(fine).vectors.count() == 1


def test_checked_needs_width(frame):
    with pytest.raises(cw.TypeMismatch):
        cw.query(v=call("div_checked", col("x").cast("i8"), col("y").cast("i8"))).plan(frame)


def test_checked_unsigned(frame):
    u = col("u", "u64")
    assert cw.query(v=call("add_checked", u, lit(1, cw.U64))).plan(frame).flag.first()[0] is True
    assert cw.query(v=call("mul_checked", u, lit(2, cw.U64))).plan(frame.where("u < 5")).flag.first()[0] is False
    assert cw.query(v=call("sub_checked", col("x").cast("u8"), lit(200, cw.U8))).plan(frame).flag.first()[0] is True


def test_unsigned_aggregates(frame):
    u = col("u", "u64")
    got = cw.query(lo=u.min(), hi=u.max(), s=u.sum(), ulo=col("x").umin(), uhi=col("x").umax()).run(frame).scalars.first()
    assert (got["lo"], got["hi"], got["s"]) == (0, 2**64 - 1, (1 + 2**63 + 2**64 - 1) % 2**64)
    assert (got["ulo"], got["uhi"]) == (0, -5)
    grouped = cw.query(m=u.max(group_idx=col("p").cast("i32"), table="t")).run(frame, tables={"t": cw.Target(2, 0)})
    assert grouped["m"] == [2**63, 2**64 - 1]


def test_aggregates_of_predicates(frame):
    p = col("p")
    got = cw.query(a=cw.and_agg(p), o=cw.or_agg(p), x=cw.xor_agg(p), n=cw.andnot_agg(p), i=aggregate("and_agg", p, col("x") < 0)).run(frame).scalars.first()
    assert tuple(got) == (False, True, False, False, True)


@pytest.mark.parametrize("unit,size", [("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)])
def test_units(spark, unit, size):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 58),), (dt.datetime(2000, 2, 29, 12, 30, 15),)], "ts timestamp_ntz")
    ts = col("ts", cw.timestamp(unit))
    assert values(df, ts.cast("i64")) == [-2 * size, 951827415 * size]
    got = cw.query({p: call(p, ts) for p in ("year", "month", "day", "hour", "minute", "second", "day_of_week")}).run(df).vectors.collect()
    assert [tuple(r) for r in got] == [(1969, 12, 31, 23, 59, 58, 2), (2000, 2, 29, 12, 30, 15, 1)]
    back = values(df, ts + lit(size, cw.I64))
    assert back == ([-size, 951827416 * size] if unit == "ns" else [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2000, 2, 29, 12, 30, 16)])
    assert values(df, call("max", ts, moment("1999-01-01T00:00:00", unit)).cast("i64"))[0] == 915148800 * size


def test_zoned(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-05-06 07:08:09Z' AS ts")
    assert cw.query(h=call("hour", col("ts")), later=col("ts") > moment("2024-05-06T07:00:00Z")).run(df).vectors.first().asDict() == {"h": 7, "later": True}
    with pytest.raises(cw.TypeMismatch):
        cw.query(v=col("ts") > moment("2024-05-06T07:00:00")).plan(df)


def test_query_shaped_expressions(spark):
    """Filters and totals of the kind that decision-support queries evaluate on joined rows."""
    rng = np.random.default_rng(9)
    n = 2000
    d = {"moy": rng.integers(1, 13, n, dtype=np.int8), "year": rng.integers(1998, 2003, n).astype(np.int16), "county": rng.integers(0, 40, n, dtype=np.int32), "sk": rng.integers(0, 1000, n, dtype=np.int32), "qty": rng.integers(1, 100, n, dtype=np.int64), "list": rng.integers(100, 30000, n, dtype=np.int64)}
    df = from_numpy(spark, d)
    moy, year, county, sk, qty, price = (col(k) for k in d)
    season = (moy >= 1) & (moy <= 4) & (year == 2002)
    placed = (county == 3) | (county == 7) | (county == 11)
    big = (price > 500) & (~placed | (sk % 7 == 0))
    monthly = {f"m{m}": (qty * price).sum((moy == m) & (year == 2001)) for m in range(1, 13)}
    got = cw.query(n=aggregate("count_if", season & placed), revenue=(qty * price).sum(season | big), large=(qty * price).sum(big), **monthly).run(df).scalars.first()
    s = (d["moy"] >= 1) & (d["moy"] <= 4) & (d["year"] == 2002)
    pl = np.isin(d["county"], [3, 7, 11])
    b = (d["list"] > 500) & (~pl | (d["sk"] % 7 == 0))
    total = d["qty"] * d["list"]
    assert got["n"] == (s & pl).sum() and got["revenue"] == total[s | b].sum() and got["large"] == total[b].sum()
    for m in range(1, 13):
        assert got[f"m{m}"] == total[(d["moy"] == m) & (d["year"] == 2001)].sum()
