"""Null tests, replacement, and comparison that treats nulls as values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..types import BOOL
from .predicates import compared
from .registry import Value, any_null, need, one, operator, predicate, same


@operator("coalesce")
def coalesce(ctx, args, want, params):
    need(len(args) >= 1, "coalesce needs an argument")
    values = same(ctx, args, want)
    if values is None:
        return None
    need(values[0].dtype.numeric, f"coalesce needs numbers, not {values[0].dtype}")
    return Value(values[0].dtype, F.coalesce(*[v.column for v in values]), all(v.nullable for v in values))


@operator("nullif")
def nullif(ctx, args, want, params):
    values = same(ctx, args, want)
    if values is None:
        return None
    need(values[0].dtype.numeric, f"nullif needs numbers, not {values[0].dtype}")
    equal = compared("eq", values).column
    return Value(values[0].dtype, F.when(~F.coalesce(equal, F.lit(False)), values[0].column), True)


def _null_test(name: str, null: bool):
    @operator(name)
    def run(ctx, args, want, params):
        v = one(ctx, args[0], want)
        need(v is not None and v.dtype != BOOL, f"{name} takes a value, not a predicate or bare literal")
        return Value(BOOL, v.column.isNull() if null else v.column.isNotNull())


_null_test("is_null", True)
_null_test("is_not_null", False)


def _truth(name: str, apply):
    @operator(name)
    def run(ctx, args, want, params):
        return Value(BOOL, apply(predicate(ctx, args[0]).column))


_truth("is_true", lambda c: F.coalesce(c, F.lit(False)))
_truth("is_not_true", lambda c: ~F.coalesce(c, F.lit(False)))
_truth("is_false", lambda c: F.coalesce(~c, F.lit(False)))
_truth("is_not_false", lambda c: F.coalesce(c, F.lit(True)))


def _distinct(name: str, distinct: bool):
    @operator(name)
    def run(ctx, args, want, params):
        values = same(ctx, args, None)
        need(values is not None, f"{name}: a literal needs a typed operand")
        a, b = values
        alike = F.when(a.column.isNull() | b.column.isNull(), a.column.isNull() & b.column.isNull()).otherwise(compared("eq", values).column)
        return Value(BOOL, ~alike if distinct else alike)


_distinct("is_distinct", True)
_distinct("is_not_distinct", False)


@operator("true_unless_null")
def true_unless_null(ctx, args, want, params):
    v = one(ctx, args[0], want)
    return Value(BOOL, F.when(v.column.isNotNull(), F.lit(True)), v.nullable)


@operator("zeronull")
def zeronull(ctx, args, want, params):
    """Zero for null."""
    v = one(ctx, args[0], want)
    if v is None:
        return None
    return v.but(F.coalesce(v.column, F.lit(0).cast(v.dtype.carrier)), nullable=False)


@operator("combine_selection")
def combine_selection(ctx, args, want, params):
    """True where any argument is not null."""
    values = [ctx.value(a) for a in args]
    need(all(v is not None for v in values), "combine_selection takes typed values")
    return Value(BOOL, reduce(lambda a, b: a | b, [v.column.isNotNull() for v in values]))
