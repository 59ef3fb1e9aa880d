"""The operator table, and how arguments get their types.

An operator is a function of (context, argument expressions, wanted type,
parameters). It evaluates its arguments to Values (a Spark column with its
logical type and nullability) or, where only untyped literals are below it and
no type is wanted, to None: the caller then asks again with a type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, DType, TypeMismatch, promote


@dataclass(frozen=True, eq=False)
class Value:
    dtype: DType
    column: Column
    nullable: bool = False

    def but(self, column: Column, dtype: DType | None = None, nullable: bool | None = None) -> Value:
        return Value(dtype or self.dtype, column, self.nullable if nullable is None else nullable)


OPERATORS: dict[str, Callable[..., Value | None]] = {}
AGGREGATES: dict[str, Callable[..., Any]] = {}


def operator(*names: str):
    def add(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return add


def literal(value: Any, to: DType) -> Value:
    """A Python literal as a value of a type; what the type cannot hold is an error."""
    if value is None:
        return Value(to, F.lit(None).cast(to.carrier), True)
    if isinstance(value, bool) != (to == BOOL):
        raise TypeMismatch(f"literal {value!r} is no {to}")
    if to.integer or to.kind == "time":
        if isinstance(value, float):
            raise TypeMismatch(f"float literal {value!r} is no {to}")
        if to.integer and not to.least <= value <= to.most:
            raise TypeMismatch(f"literal {value!r} is out of range for {to}")
        if to.width == 64 and value >= 1 << 63:
            value -= 1 << 64
    return Value(to, F.lit(float(value) if to.kind == "float" else value).cast(to.carrier))


def fit(column: Column, to: DType) -> Column:
    """Keep the low bits of an integer column as a value of the type."""
    if to.kind == "uint" and to.width < 64:
        column = column.bitwiseAND(F.lit(to.most))
    return column.cast(to.carrier)


def widen(v: Value, to: DType) -> Value:
    """Promotion to a wider type of the same kind."""
    return v if v.dtype == to else v.but(v.column.cast(to.carrier), to)


def same(ctx, exprs: Iterable, want: DType | None) -> list[Value] | None:
    """All arguments in their common type; literals follow the others or, alone, the wanted type."""
    exprs = list(exprs)
    values = [ctx.value(e) for e in exprs]
    known = [v.dtype for v in values if v]
    common = reduce(promote, known) if known else want
    if common is None:
        return None
    return [widen(v or ctx.value(e, common), common) for e, v in zip(exprs, values, strict=True)]


def one(ctx, expr, want: DType | None) -> Value | None:
    return ctx.value(expr, want)


def predicate(ctx, expr) -> Value:
    v = ctx.value(expr, BOOL)
    if v.dtype != BOOL:
        raise TypeMismatch(f"{v.dtype} is no predicate")
    return v


def need(ok: bool, what: str) -> None:
    if not ok:
        raise TypeMismatch(what)


def any_null(values: Iterable[Value]) -> bool:
    return any(v.nullable for v in values)


def guard(values: Iterable[Value], column: Column) -> Column:
    """Null where any of the values is null."""
    checks = [v.column.isNotNull() for v in values if v.nullable]
    return F.when(reduce(lambda a, b: a & b, checks), column) if checks else column


def reinterpret(v: Value, to: DType) -> Value:
    """The same bits as another integer type of the width."""
    if v.dtype == to:
        return v
    if to.kind == "int" and to.width < 64:
        return v.but(v.column.cast(to.carrier), to)
    return v.but(fit(v.column.cast("bigint"), to), to)


def bits_of(v: Value) -> Column:
    """The value's bits, zero extended in a bigint."""
    wide = v.column.cast("bigint")
    return wide if v.dtype.width == 64 or v.dtype.kind == "uint" else wide.bitwiseAND(F.lit((1 << v.dtype.width) - 1))


def shift(kind: str, column: Column, count: Column) -> Column:
    return F.call_function({"left": "shiftleft", "right": "shiftright", "unsigned": "shiftrightunsigned"}[kind], column, count.cast("int"))
