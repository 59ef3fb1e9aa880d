"""Comparisons, predicate logic that is null where any side is, selection, and float classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, BY_NAME, U64, DType
from .arith import flipped
from .registry import Value, any_null, guard, need, one, operator, predicate, promote, reinterpret, same, widen

# The comparisons.
COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}
LEAST_NORMAL = {32: 2.0**-126, 64: 2.0**-1022}


def compared(name: str, values: list[Value]) -> Value:
    """Comparison in the operands' own order; with NaN every one but ne is false."""
    a, b = values
    left, right = a.column, b.column
    if a.dtype == U64 and name not in ("eq", "ne"):
        left, right = flipped(left), flipped(right)
    out = COMPARE[name](left, right)
    if a.dtype.kind == "float":
        nan = F.isnan(left) | F.isnan(right)
        # isnan is false for null, so a null operand still gives null.
        out = (out | nan) if name == "ne" else (out & ~nan)
    return Value(BOOL, guard(values, out) if a.dtype.kind == "float" else out, any_null(values))


def _compare(name: str):
    @operator(name, "cmp_" + name)
    def run(ctx, args, want, params):
        values = same(ctx, args, None)
        need(values is not None, f"{name}: a literal needs a typed operand")
        kind = values[0].dtype
        need(kind != BOOL or name in ("eq", "ne"), f"predicates have no order for {name}")
        if params.get("unsigned"):
            return ctx.apply("u" + name, args, want, {})
        return compared(name, values)

    @operator("u" + name, "cmp_u" + name)
    def unsigned(ctx, args, want, params):
        values = same(ctx, args, None)
        need(values is not None, f"u{name}: a literal needs a typed operand")
        need(values[0].dtype.integer, f"u{name} needs integers, not {values[0].dtype}")
        return compared(name, [reinterpret(v, BY_NAME[f"u{v.dtype.width}"]) for v in values])


for _name in COMPARE:
    _compare(_name)


@operator("cmp")
def cmp(ctx, args, want, params):
    return ctx.apply(("u" if params.get("unsigned") else "") + params["kind"], args, want, {})


def _strict(name: str, apply):
    @operator("p_" + name)
    def run(ctx, args, want, params):
        values = [predicate(ctx, a) for a in args]
        return Value(BOOL, guard(values, apply(*[v.column for v in values])), any_null(values))


_strict("and", lambda a, b: a & b)
_strict("or", lambda a, b: a | b)
_strict("xor", lambda a, b: a != b)
_strict("andnot", lambda a, b: ~a & b)
_strict("xnor", lambda a, b: a == b)
_strict("not", lambda a: ~a)


def _test(name: str, zero: bool):
    @operator(name)
    def run(ctx, args, want, params):
        values = same(ctx, args, None)
        need(values is not None and values[0].dtype.integer, f"{name} needs integers")
        both = values[0].column.bitwiseAND(values[1].column)
        return Value(BOOL, both == 0 if zero else both != 0, any_null(values))


_test("bit_test", False)
_test("bit_testn", True)


def _against_zero(name: str, apply):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        need(v is not None and v.dtype.numeric, f"{name} needs a number")
        return v.but(apply(v.column), BOOL)


_against_zero("is_positive", lambda c: c > 0)
_against_zero("is_negative", lambda c: c < 0)
_against_zero("bool2bit", lambda c: c != 0)


@operator("bit2bool")
def bit2bool(ctx, args, want, params):
    """A predicate as an i8 of 0 or 1."""
    v = predicate(ctx, args[0])
    return v.but(v.column.cast("tinyint"), BY_NAME["i8"])


def classes(v: Value, flags: set[str]) -> Column:
    c, least = v.column, F.lit(LEAST_NORMAL[v.dtype.width])
    size = F.abs(c)
    tests = {
        "nan": F.isnan(c),
        "inf": size == F.lit(float("inf")),
        "zero": c == 0,
        "subnormal": (size > 0) & (size < least) & ~F.isnan(c),
        "normal": (size >= least) & (size < F.lit(float("inf"))) & ~F.isnan(c),
    }
    need(flags <= set(tests), f"unknown float class in {sorted(flags)}")
    return reduce(lambda a, b: a | b, [tests[f] for f in tests if f in flags], F.lit(False))


def _class(name: str, flags: set[str]):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        need(v is not None and v.dtype.kind == "float", f"{name} needs a float")
        return v.but(guard([v], classes(v, flags)), BOOL)


_class("isnan", {"nan"})
_class("isinf", {"inf"})
_class("isfinite", {"zero", "subnormal", "normal"})
_class("isnormal", {"normal"})


@operator("fpclass")
def fpclass(ctx, args, want, params):
    v = one(ctx, args[0], want)
    need(v is not None and v.dtype.kind == "float" and not v.nullable, "fpclass needs a float that is not nullable")
    return v.but(classes(v, set(params["flags"])), BOOL)


def _branches(ctx, exprs, want) -> list[Value] | None:
    values = [ctx.value(e) for e in exprs]
    known = [v.dtype for v in values if v]
    common: DType | None = reduce(promote, known) if known else want
    if common is None:
        return None
    return [widen(v or ctx.value(e, common), common) for e, v in zip(exprs, values, strict=True)]


@operator("select", "ifelse", "if_else")
def select(ctx, args, want, params):
    """The second argument where the first is true, else the third; a null condition counts as false."""
    c = predicate(ctx, args[0])
    values = _branches(ctx, args[1:], want)
    if values is None:
        return None
    yes, no = values
    return Value(yes.dtype, F.when(c.column, yes.column).otherwise(no.column), any_null(values))


@operator("zero_select")
def zero_select(ctx, args, want, params):
    """The value where the predicate is true, else zero."""
    c, v = predicate(ctx, args[0]), one(ctx, args[1], want)
    if v is None:
        return None
    zero = F.lit(False) if v.dtype == BOOL else F.lit(0).cast(v.dtype.carrier)
    return v.but(F.when(c.column, v.column).otherwise(zero))


@operator("if_else_null")
def if_else_null(ctx, args, want, params):
    c, v = predicate(ctx, args[0]), one(ctx, args[1], want)
    return None if v is None else v.but(F.when(c.column, v.column), nullable=True)


@operator("case_when")
def case_when(ctx, args, want, params):
    pairs = args[:-1] if params.get("default") else args
    conditions = [predicate(ctx, c) for c in pairs[::2]]
    results = [*pairs[1::2], *([args[-1]] if params.get("default") else [])]
    values = _branches(ctx, results, want)
    if values is None:
        return None
    out = F.when(conditions[0].column, values[0].column)
    for c, v in zip(conditions[1:], values[1:], strict=False):
        out = out.when(c.column, v.column)
    if params.get("default"):
        return Value(values[0].dtype, out.otherwise(values[-1].column), any_null(values))
    return Value(values[0].dtype, out, True)


@operator("cond_store")
def cond_store(ctx, args, want, params):
    values = _branches(ctx, [args[0], args[2]], want)
    if values is None:
        return None
    c = predicate(ctx, args[1])
    return Value(values[0].dtype, F.when(c.column, values[0].column).otherwise(values[1].column), any_null(values))
