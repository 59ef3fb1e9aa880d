"""Aggregates of a whole column or a group: nulls are skipped, no rows give the identity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arith import extreme, flipped
from ..functions.registry import AGGREGATES, Value, fit, need, predicate, reinterpret
from ..types import BOOL, BY_NAME, I64, I128, U64, DType


@dataclass(frozen=True)
class Agg:
    """An aggregate column that may be null for no rows, what stands for none, and how two results combine.

    wrapping marks an integer product, which Spark has no aggregate for: column is then
    the factor of each row, and operators/products.py multiplies.
    """

    dtype: DType
    column: Column
    identity: Column
    combine: Callable[[Column, Column], Column]
    wrapping: bool = False

    def value(self) -> Column:
        return F.coalesce(self.column, self.identity)


def aggregate(*names: str):
    def add(f):
        for n in names:
            AGGREGATES[n] = f
        return f

    return add


LIMB = 22


def sum128(x: Column) -> Column:
    """The exact sum of a bigint as decimal(38,0), null for no rows: three sums of 22 bits each, which stay bigints for 2^41 rows.

    Sums of decimals make an object a row; these are compiled to plain additions and meet in a decimal once a group.
    """
    mask, step = F.lit((1 << LIMB) - 1).cast("bigint"), F.lit(1 << LIMB).cast("decimal(8,0)")
    limbs = [F.shiftright(x, 2 * LIMB), F.shiftright(x, LIMB).bitwiseAND(mask), x.bitwiseAND(mask)]
    high, middle, low = (F.sum(limb).cast("decimal(20,0)") for limb in limbs)
    return ((high * step + middle) * step + low).cast("decimal(38,0)")


def _where(v: Value, where: Column | None) -> Column:
    return v.column if where is None else F.when(where, v.column)


def _literal(x, t: DType) -> Column:
    if t == U64 and isinstance(x, int) and x >= 1 << 63:
        x -= 1 << 64
    return F.lit(x).cast(t.carrier)


@aggregate("sum")
def sum_(ctx, args, where):
    """In the argument's own type: integers wrap."""
    v = ctx.value(args[0])
    need(v is not None and v.dtype.numeric, "sum needs numbers")
    total = F.sum(_where(v, where))
    column = fit(total, v.dtype) if v.dtype.integer else total.cast(v.dtype.carrier)
    combine = lambda a, b: fit(a + b, v.dtype) if v.dtype.integer else (a + b).cast(v.dtype.carrier)
    return Agg(v.dtype, column, _literal(0, v.dtype), combine)


@aggregate("sum_wide")
def sum_wide(ctx, args, where):
    """Sum of i64 in 128 bits, as decimal(38,0)."""
    v = ctx.value(args[0])
    need(v is not None and v.dtype.kind == "int", "sum_wide needs signed integers")
    return Agg(I128, sum128(_where(v, where).cast("bigint")), F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"))


@aggregate("product")
def product(ctx, args, where):
    v = ctx.value(args[0])
    need(v is not None and v.dtype.numeric, "product needs numbers")
    if v.dtype.kind == "float":
        return Agg(v.dtype, F.product(_where(v, where)).cast(v.dtype.carrier), _literal(1.0, v.dtype), lambda a, b: (a * b).cast(v.dtype.carrier))
    return Agg(v.dtype, _where(v, where).cast("bigint"), _literal(1, v.dtype), lambda a, b: fit(a * b, v.dtype), wrapping=True)


def _bounds(t: DType, largest: bool) -> Column:
    if t.kind == "float":
        return _literal(float("-inf") if largest else float("inf"), t)
    if t.kind == "time":
        t = I64
    return _literal(t.least if largest else t.most, t)


def _extreme(name: str, largest: bool, unsigned: bool):
    @aggregate(name)
    def run(ctx, args, where):
        v = ctx.value(args[0])
        need(v is not None and (v.dtype.integer if unsigned else v.dtype.numeric or v.dtype.kind == "time"), f"{name} does not take {v and v.dtype}")
        kind = v.dtype
        if unsigned:
            v = reinterpret(v, BY_NAME[f"u{kind.width}"])
        pick = F.max if largest else F.min
        x = _where(v, where)
        if v.dtype == U64:
            out = flipped(pick(flipped(x)))
        elif v.dtype.kind == "float":
            out = pick(F.when(~F.isnan(x), x))
        else:
            out = pick(x)

        def back(c: Column) -> Column:
            return reinterpret(Value(v.dtype, c), kind).column if unsigned else c

        def combine(a: Column, b: Column) -> Column:
            both = [reinterpret(Value(kind, c), v.dtype) if unsigned else Value(kind, c) for c in (a, b)]
            return back(extreme(both, largest))

        return Agg(kind, back(out), back(_bounds(v.dtype, largest)), combine)


_extreme("min_agg", False, False)
_extreme("max_agg", True, False)
_extreme("umin_agg", False, True)
_extreme("umax_agg", True, True)


def _fold(name: str, bits, flags, combine_bits, combine_flags, full: bool):
    """Bitwise over integers, logical over predicates; full: the identity is all ones, or true."""

    @aggregate(name)
    def run(ctx, args, where):
        v = ctx.value(args[0])
        need(v is not None and (v.dtype.integer or v.dtype == BOOL), f"{name} needs integers or predicates")
        x = _where(v, where)
        if v.dtype == BOOL:
            known = F.coalesce(v.column, F.lit(False))
            return Agg(BOOL, flags(known if where is None else F.when(where, known)), F.lit(full), combine_flags)
        return Agg(v.dtype, fit(bits(x), v.dtype), fit(F.lit(-1 if full else 0).cast("bigint"), v.dtype), lambda a, b: fit(combine_bits(a, b), v.dtype))


_fold("and_agg", F.bit_and, F.bool_and, lambda a, b: a.bitwiseAND(b), lambda a, b: a & b, True)
_fold("or_agg", F.bit_or, F.bool_or, lambda a, b: a.bitwiseOR(b), lambda a, b: a | b, False)
_fold("xor_agg", F.bit_xor, lambda p: F.count_if(p) % 2 == 1, lambda a, b: a.bitwiseXOR(b), lambda a, b: a != b, False)
# The accumulator starts full and loses every bit that is set in any argument.
_fold("andnot_agg", lambda x: F.bitwise_not(F.bit_or(x)), lambda p: ~F.bool_or(p), lambda a, b: a.bitwiseAND(b), lambda a, b: a & b, True)


def _count(name: str, test):
    @aggregate(name)
    def run(ctx, args, where):
        counted = test(ctx, args[0])
        if where is not None:
            counted = counted & where
        return Agg(I64, F.count_if(counted), F.lit(0).cast("bigint"), lambda a, b: a + b)


_count("count_if", lambda ctx, e: predicate(ctx, e).column)
_count("countif", lambda ctx, e: predicate(ctx, e).column)
_count("count_notnull", lambda ctx, e: ctx.value(e).column.isNotNull())


def _quantifier(name: str, test, every: bool):
    @aggregate(name)
    def run(ctx, args, where):
        p = test(ctx, args[0])
        p = p if where is None else F.when(where, p)
        return Agg(BOOL, F.bool_and(p) if every else F.bool_or(p), F.lit(every), (lambda a, b: a & b) if every else (lambda a, b: a | b))


_quantifier("has_nulls", lambda ctx, e: ctx.value(e).column.isNull(), False)
_quantifier("any", lambda ctx, e: F.coalesce(predicate(ctx, e).column, F.lit(False)), False)
_quantifier("all", lambda ctx, e: F.coalesce(predicate(ctx, e).column, F.lit(False)), True)
