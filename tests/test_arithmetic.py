"""Fixed-width semantics against NumPy and Python integers, on edge values."""

import math

import numpy as np
import pytest

import colweave as cw
from colweave import call, col, lit
from colweave.sources.columns import from_numpy
from colweave.types import BY_NAME

SIGNED, UNSIGNED = ("i8", "i16", "i32", "i64"), ("u8", "u16", "u32", "u64")
WIDTH = {t: int(t[1:]) for t in SIGNED + UNSIGNED}


def low(t):
    return 0 if t[0] == "u" else -(1 << WIDTH[t] - 1)


def high(t):
    return (1 << WIDTH[t]) - 1 if t[0] == "u" else (1 << WIDTH[t] - 1) - 1


def edges(t, n=40):
    rng = np.random.default_rng(WIDTH[t])
    w = WIDTH[t]
    some = [low(t), high(t), 0, 1, 2, 3, high(t) - 1, 1 << w // 2, 10, 100]
    some += [-1, -2, low(t) + 1] if t[0] == "i" else []
    some += [int(rng.integers(low(t), high(t), endpoint=True, dtype=np.dtype(("int" if t[0] == "i" else "uint") + str(w)))) for _ in range(n - len(some))]
    return some


def wrap(x, t):
    x &= (1 << WIDTH[t]) - 1
    return x - (1 << WIDTH[t]) if t[0] == "i" and x > high(t) else x


def bits(x, t):
    return x & ((1 << WIDTH[t]) - 1)


@pytest.fixture(scope="module")
def frames(spark):
    out = {}
    for t in SIGNED + UNSIGNED:
        x = edges(t)
        y = list(reversed(x))
        kind = np.dtype(("int" if t[0] == "i" else "uint") + str(WIDTH[t]))
        out[t] = (from_numpy(spark, {"x": np.array(x, kind), "y": np.array(y, kind)}), x, y)
    return out


def rows(frame, **outputs):
    found = cw.query(**outputs).run(frame).vectors.collect()
    return {n: [r[n] for r in found] for n in outputs}


def trunc_div(a, b):
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


@pytest.mark.parametrize("t", SIGNED + UNSIGNED)
def test_binary(frames, t):
    frame, xs, ys = frames[t]
    x, y = col("x", t), col("y", t)
    w = WIDTH[t]
    got = rows(
        frame, add=x + y, sub=x - y, mul=x * y, div=x / y, mod=x % y, lo=call("min", x, y), hi=call("max", x, y),
        a=x.bit_and(y), o=x.bit_or(y), r=x.bit_xor(y), an=x.bit_andnot(y), xn=x.bit_xnor(y),
        sll=x.sll(y), srl=x.srl(y), sra=x.sra(y), rl=x.rotl(y), rr=x.rotr(y), neg=-x, inv=call("not", x),
        lt=x < y, ge=x >= y, eq=call("eq", x, y), ult=call("ult", x, y), udiv=call("udiv", x, y), umod=call("umod", x, y), umax=call("umax", x, y),
    )
    for k, (a, b) in enumerate(zip(xs, ys, strict=True)):
        bad = b == 0 or (t[0] == "i" and a == low(t) and b == -1)
        ub = bits(b, t) or 1
        s = bits(b, t) % w
        expected = {
            "add": wrap(a + b, t), "sub": wrap(a - b, t), "mul": wrap(a * b, t), "div": a if bad else trunc_div(a, b), "mod": 0 if bad else int(math.fmod(a, b)) if w < 53 else a - b * trunc_div(a, b),
            "lo": min(a, b), "hi": max(a, b), "a": wrap(a & b, t), "o": wrap(a | b, t), "r": wrap(a ^ b, t), "an": wrap(~a & b, t), "xn": wrap(~(a ^ b), t),
            "sll": wrap(a << s, t), "srl": wrap(bits(a, t) >> s, t), "sra": wrap((bits(a, t) - ((1 << w) if bits(a, t) >> (w - 1) else 0)) >> s, t),
            "rl": wrap(bits(a, t) << s | bits(a, t) >> (w - s) % (w or 1) if s else a, t), "rr": wrap(bits(a, t) >> s | bits(a, t) << (w - s) if s else a, t),
            "neg": wrap(-a, t), "inv": wrap(~a, t), "lt": a < b, "ge": a >= b, "eq": a == b, "ult": bits(a, t) < bits(b, t),
            "udiv": wrap(bits(a, t) // ub, t), "umod": 0 if b == 0 else wrap(bits(a, t) % ub, t), "umax": wrap(max(bits(a, t), bits(b, t)), t),
        }
        for n, v in expected.items():
            assert got[n][k] == v, (t, n, a, b)


@pytest.mark.parametrize("t", SIGNED + UNSIGNED)
def test_unary(frames, t):
    frame, xs, _ = frames[t]
    x, w = col("x", t), WIDTH[t]
    got = rows(frame, pop=x.popcnt(), lz=x.lzcnt(), tz=x.tzcnt(), lg=x.log2(), fl=x.bit_floor(), ce=x.bit_ceil(), one=x.has_single_bit(), rev=call("permute", x.zeronull(), idxs=list(range(w - 1, -1, -1)), is_bit=True))
    for k, a in enumerate(xs):
        u = bits(a, t)
        expected = {
            "pop": u.bit_count(), "lz": w - u.bit_length(), "tz": w if u == 0 else (u & -u).bit_length() - 1, "lg": max(0, u.bit_length() - 1),
            "fl": wrap(1 << u.bit_length() - 1, t) if u else 0, "ce": 1 if u <= 1 else wrap(1 << (u - 1).bit_length() % w, t), "one": u & (u - 1) == 0,
            "rev": wrap(int(f"{u:0{w}b}"[::-1], 2), t),
        }
        for n, v in expected.items():
            assert got[n][k] == v, (t, n, a)


@pytest.mark.parametrize("t", ["i16", "i32", "i64", "u32", "u64"])
def test_byteswap(frames, t):
    frame, xs, _ = frames[t]
    got = rows(frame, v=col("x", t).byteswap())["v"]
    for g, a in zip(got, xs, strict=True):
        assert g == wrap(int.from_bytes(bits(a, t).to_bytes(WIDTH[t] // 8, "little"), "big"), t)


@pytest.mark.parametrize("t", SIGNED + UNSIGNED)
def test_casts(frames, t):
    frame, xs, _ = frames[t]
    x = col("x", t)
    got = rows(frame, **{to: x.cast(to) for to in SIGNED + UNSIGNED if to != t}, f64=x.cast("f64"))
    for k, a in enumerate(xs):
        for to in SIGNED + UNSIGNED:
            if to == t:
                continue
            # Widening goes by the target's signedness.
            value = a
            if WIDTH[to] > WIDTH[t]:
                value = bits(a, t) if to[0] == "u" else bits(a, t) - ((1 << WIDTH[t]) if bits(a, t) >> (WIDTH[t] - 1) else 0)
            assert got[to][k] == wrap(value, to), (t, to, a)
        assert got["f64"][k] == float(a), (t, a)


def test_named_casts(spark):
    frame = from_numpy(spark, {"x": np.array([-1, 127, -128], np.int8), "f": np.array([2.9, -2.9, 300.7])})
    x, f = col("x"), col("f")
    got = rows(
        frame, z=call("zext", x, to=cw.I32), s=call("sext", x, to=cw.I32), t=call("trunc", x.cast("i64"), to=cw.I8), i=f.cast("i32"), b=f.cast("i8"),
        u=call("unsigned_cast", x, to=cw.F64), p=call("signed_cast", x, to=cw.F64), n=call("int_cast", x, kind="zext", to=cw.I16),
    )
    assert got["z"] == [255, 127, 128] and got["s"] == [-1, 127, -128] and got["t"] == [-1, 127, -128]
    assert got["i"] == [2, -2, 300] and got["b"] == [2, -2, 44] and got["u"] == [255, 127, 128] and got["p"] == [-1, 127, -128] and got["n"] == [255, 127, 128]


def test_bitcast(spark):
    values = np.array([0.0, -0.0, 1.5, np.inf, -np.inf, 1e-310])
    frame = from_numpy(spark, {"d": values, "f": values.astype(np.float32), "i": values.view(np.int64)})
    got = cw.query(i=call("bitcast", col("d"), to=cw.I64), j=call("bitcast", col("f"), to=cw.I32), d=call("bitcast", col("i"), to=cw.F64))
    got.schema = cw.Table({"d": "f64", "f": "f32", "i": "i64"})
    found = got.run(frame).vectors.collect()
    assert [r["i"] for r in found] == values.view(np.int64).tolist()
    assert [r["j"] for r in found] == values.astype(np.float32).view(np.int32).tolist()
    assert [math.copysign(1, r["d"]) for r in found] == [math.copysign(1, v) for v in values] and [r["d"] for r in found] == values.tolist()


FLOATS = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 3.5, 0.5, -0.5, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan, 4503599627370497.5]


def alike(a, b):
    return a == b and math.copysign(1, a) == math.copysign(1, b) or a != a and b != b


@pytest.mark.parametrize("t", ["f32", "f64"])
def test_floats(spark, t):
    kind = np.float32 if t == "f32" else np.float64
    with np.errstate(all="ignore"):
        pairs = np.array([(a, b) for a in FLOATS for b in FLOATS]).astype(kind)
        x, y = pairs.T
        frame = from_numpy(spark, {"x": x, "y": y})
        a, b = col("x"), col("y")
        got = rows(
            frame, add=a + b, div=a / b, rint=a.round_(), fl=a.floor(), ce=a.ceil(), tr=a.round2zero(), sq=a.sqrt(), rcp=a.rcp(), lo=call("min", a, b), hi=call("max", a, b),
            lt=a < b, ge=a >= b, eq=call("eq", a, b), ne=call("ne", a, b), nan=a.isnan(), inf=a.isinf(), fin=a.isfinite(), norm=a.isnormal(),
        )
        expected = {
            "add": x + y, "div": x / y, "rint": np.rint(x), "fl": np.floor(x), "ce": np.ceil(x), "tr": np.trunc(x), "sq": np.sqrt(x), "rcp": (kind(1) / x),
            "lt": x < y, "ge": x >= y, "eq": x == y, "ne": x != y, "nan": np.isnan(x), "inf": np.isinf(x), "fin": np.isfinite(x),
            "norm": np.isfinite(x) & (np.abs(x) >= np.finfo(kind).tiny),
        }
        for n, v in expected.items():
            for g, e, p, q in zip(got[n], v.tolist(), x.tolist(), y.tolist(), strict=True):
                assert (g == e) if isinstance(e, bool) else alike(g, e), (n, p, q, g, e)
        for n, f in (("lo", np.fmin), ("hi", np.fmax)):
            for g, e in zip(got[n], f(x, y).tolist(), strict=True):
                assert g == e or g != g and e != e, n


def test_null_on_invalid_division(spark):
    frame = from_numpy(spark, {"x": np.array([7, 7, -(2**31)], np.int32), "y": np.array([2, 0, -1], np.int32)})
    got = rows(frame, v=call("div", col("x"), col("y"), null_on_invalid_division=True), w=col("x") / col("y"))
    assert got["v"] == [3, None, None] and got["w"] == [3, 7, -(2**31)]


def test_mul64(spark):
    frame = from_numpy(spark, {"x": np.array([-1, 2**32 + 3], np.int64)})
    got = rows(frame, s=call("mul64se", col("x"), lit(2, cw.I64)), z=call("mul64ze", col("x"), lit(2, cw.I64)))
    assert got["s"] == [-2, 6] and got["z"] == [(2**32 - 1) * 2, 6]


def test_types_by_name():
    assert BY_NAME["i1"] is cw.BOOL and cw.U8.most == 255 and cw.I8.least == -128
