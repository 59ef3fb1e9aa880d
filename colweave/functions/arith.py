"""Integer and float arithmetic: wrapping, IEEE, safe division, minima and maxima, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BY_NAME, U64, DType
from . import time
from .registry import Value, any_null, fit, guard, need, one, operator, reinterpret, same

MIN64 = -(1 << 63)
INF, NAN = float("inf"), float("nan")


def flipped(column: Column) -> Column:
    """u64 bits in an order that signed comparison gets right."""
    return column.bitwiseXOR(F.lit(MIN64).cast("bigint"))


def _binary(name: str, apply):
    @operator(name)
    def run(ctx, args, want, params):
        moved = time.shifted(ctx, name, args) if name in ("add", "sub") else None
        if moved:
            return moved
        values = same(ctx, args, want)
        if values is None:
            return None
        need(values[0].dtype.numeric, f"{name} needs numbers, not {values[0].dtype}")
        a, b = values
        out = apply(a.column, b.column)
        return Value(a.dtype, fit(out, a.dtype) if a.dtype.integer else out.cast(a.dtype.carrier), any_null(values))


_binary("add", lambda a, b: a + b)
_binary("sub", lambda a, b: a - b)
_binary("mul", lambda a, b: a * b)


def mul64(ctx, args, want, params, name):
    """64-bit product of the low 32 bits, sign or zero extended."""
    values = same(ctx, args, want)
    if values is None:
        return None
    need(values[0].dtype.integer and values[0].dtype.width == 64, f"{name} needs 64-bit integers")
    if name == "mul64se":
        low = [v.column.cast("int").cast("bigint") for v in values]
    else:
        low = [v.column.bitwiseAND(F.lit(0xFFFFFFFF)) for v in values]
    return Value(values[0].dtype, low[0] * low[1], any_null(values))


def _named(name: str):
    def f(ctx, args, want, params):
        return mul64(ctx, args, want, params, name)

    operator(name)(f)


_named("mul64se")
_named("mul64ze")


def invalid_division(a: Value, b: Value) -> Column:
    """Where an integer division has no result: by zero, or the least value by -1."""
    bad = b.column == 0
    if a.dtype.kind == "int":
        bad = bad | (a.column == F.lit(a.dtype.least).cast(a.dtype.carrier)) & (b.column == -1)
    return bad


def unsigned_quotient(a: Column, b: Column) -> Column:
    """u64 quotient of raw bits, by halving the dividend."""
    half = F.call_function("div", F.call_function("shiftrightunsigned", a, F.lit(1)), b)
    near = F.call_function("shiftleft", half, F.lit(1))
    rest = a - near * b
    plain = F.when(a >= 0, F.call_function("div", a, b)).otherwise(near + F.when(flipped(rest) >= flipped(b), 1).otherwise(0))
    return F.when(b < 0, F.when(flipped(a) >= flipped(b), 1).otherwise(0)).otherwise(plain).cast("bigint")


def quotient(a: Value, divisor: Column) -> Column:
    if a.dtype == U64:
        return unsigned_quotient(a.column, divisor)
    return fit(F.call_function("div", a.column, divisor), a.dtype)


def remainder(a: Value, divisor: Column) -> Column:
    if a.dtype == U64:
        return a.column - unsigned_quotient(a.column, divisor) * divisor
    return fit(a.column % divisor, a.dtype)


def ieee_division(a: Column, b: Column, carrier: str) -> Column:
    """Spark gives null for division by zero; IEEE gives an infinity or NaN."""
    minus = F.when(b == 0, F.startswith(b.cast("string"), F.lit("-"))).otherwise(False)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a < 0) == minus, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNotNull() & (b == 0), by_zero).otherwise(a / b).cast(carrier)


def _division(name: str, integer):
    @operator(name)
    def run(ctx, args, want, params):
        values = same(ctx, args, want)
        return None if values is None else divide(values, params, integer, name)

    @operator("u" + name)
    def unsigned(ctx, args, want, params):
        values = same(ctx, args, want)
        if values is None:
            return None
        need(values[0].dtype.integer, f"u{name} needs integers")
        kind = values[0].dtype
        raw = [reinterpret(v, _unsigned(kind)) for v in values]
        return reinterpret(divide(raw, params, integer, name), kind)


def _unsigned(t: DType) -> DType:
    return BY_NAME[f"u{t.width}"]


def divide(values: list[Value], params, integer, name: str) -> Value:
    """A bad divisor counts as 1 (so x/0 = x and x%0 = 0), or gives null with null_on_invalid_division."""
    a, b = values
    need(a.dtype.numeric, f"{name} needs numbers, not {a.dtype}")
    if a.dtype.kind == "float":
        need(name == "div", "mod needs integers")
        return Value(a.dtype, ieee_division(a.column, b.column, a.dtype.carrier), any_null(values))
    bad = invalid_division(a, b)
    out = integer(a, F.when(bad, F.lit(1).cast(a.dtype.carrier)).otherwise(b.column))
    if params.get("null_on_invalid_division"):
        return Value(a.dtype, F.when(~bad, out), True)
    return Value(a.dtype, guard([b], out), any_null(values))


_division("div", quotient)
_division("mod", remainder)


def extreme(values: list[Value], largest: bool) -> Column:
    """Least or greatest; null if any is null; a NaN loses to a number."""
    pick, kind = F.greatest if largest else F.least, values[0].dtype
    columns = [v.column for v in values]
    if kind == U64:
        return guard(values, flipped(pick(*map(flipped, columns))))
    if kind.kind == "float" and largest:
        most = pick(*[F.when(~F.isnan(c), c) for c in columns])
        return guard(values, F.coalesce(most, F.lit(NAN)).cast(kind.carrier))
    return guard(values, pick(*columns))


def _extreme(name: str, largest: bool, unsigned: bool):
    @operator(name)
    def run(ctx, args, want, params):
        need(len(args) >= 1, f"{name} needs arguments")
        values = same(ctx, args, want)
        if values is None:
            return None
        kind = values[0].dtype
        need(kind.numeric or kind.kind == "time" and not unsigned, f"{name} needs numbers or timestamps, not {kind}")
        if len(values) == 1:
            return values[0]
        if not unsigned:
            return Value(kind, extreme(values, largest), any_null(values))
        need(kind.integer, f"{name} needs integers")
        raw = [reinterpret(v, _unsigned(kind)) for v in values]
        return reinterpret(Value(_unsigned(kind), extreme(raw, largest), any_null(values)), kind)


for _name, _largest in (("min", False), ("least", False), ("max", True), ("greatest", True)):
    _extreme(_name, _largest, False)
for _name, _largest in (("umin", False), ("uleast", False), ("umax", True), ("ugreatest", True)):
    _extreme(_name, _largest, True)


def _unary(name: str, apply, kinds=("int", "float")):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        if v is None:
            return None
        need(v.dtype.kind in kinds, f"{name} does not take {v.dtype}")
        out = apply(v)
        return v.but(fit(out, v.dtype) if v.dtype.integer else out.cast(v.dtype.carrier))


def _whole(c: Column, rounded: Column) -> Column:
    """A rounded double that stays one: large values are whole already, and zero keeps the sign of what it was."""
    near = F.when(rounded == 0, c * F.lit(0.0)).otherwise(rounded.cast("double"))
    return F.when(F.abs(c) < 2.0**52, near).otherwise(c)


def _floor(c: Column) -> Column:
    return _whole(c, F.floor(c))


def _ceil(c: Column) -> Column:
    return _whole(c, F.ceil(c))


_unary("negate", lambda v: -v.column, ("int", "uint", "float"))
_unary("abs", lambda v: F.abs(v.column))
for _name in ("round_nearest_even", "round_"):
    _unary(_name, lambda v: F.rint(v.column), ("float",))
for _name in ("round_down", "floor"):
    _unary(_name, lambda v: _floor(v.column), ("float",))
for _name in ("round_up", "ceil"):
    _unary(_name, lambda v: _ceil(v.column), ("float",))
for _name in ("round_toward_zero", "round2zero"):
    _unary(_name, lambda v: F.when(v.column < 0, _ceil(v.column)).otherwise(_floor(v.column)), ("float",))
_unary("sqrt", lambda v: F.sqrt(v.column), ("float",))
_unary("rcp", lambda v: ieee_division(F.lit(1.0), v.column, "double"), ("float",))
_unary("rsqrt", lambda v: ieee_division(F.lit(1.0), F.sqrt(v.column), "double"), ("float",))


def _sign(name: str, zero: int):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        if v is None:
            return None
        need(v.dtype.kind in ("int", "float"), f"{name} does not take {v.dtype}")
        out = F.when(v.column < 0, -1).when(v.column > 0, 1).when(v.column.isNotNull(), zero)
        return v.but(out.cast(v.dtype.carrier))


_sign("sign_no_zero", 1)
_sign("sign", 0)


def _copysign(name: str, zero: bool):
    @operator(name)
    def run(ctx, args, want, params):
        """The argument, negated where the sign is below 0; copysign also gives 0 where the sign is 0."""
        values = same(ctx, args, want)
        if values is None:
            return None
        a, s = values
        need(a.dtype.kind in ("int", "float"), f"{name} does not take {a.dtype}")
        out = F.when(s.column < 0, -a.column)
        if zero:
            out = out.when(s.column == 0, F.lit(0).cast(a.dtype.carrier))
        return Value(a.dtype, guard(values, out.otherwise(a.column)).cast(a.dtype.carrier), any_null(values))


_copysign("copysign_no_zero", False)
_copysign("copysign", True)
