"""Checked arithmetic: the wrapped value, and a failure noted in the program's one flag.

A null operand never fails, and neither does a row outside the mask given as where.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import U64
from .arith import flipped, invalid_division, unsigned_quotient
from .registry import Value, need, operator, same


def _overflow(name: str, a: Value, b: Value) -> Column:
    tried = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[name]
    kind = a.dtype
    if kind.kind == "int":
        return tried(a.column, b.column).isNull() & a.column.isNotNull() & b.column.isNotNull()
    if kind == U64:
        if name == "add":
            return flipped(a.column + b.column) < flipped(a.column)
        if name == "sub":
            return flipped(a.column) < flipped(b.column)
        divisor = F.when(a.column == 0, F.lit(1).cast("bigint")).otherwise(a.column)
        return (a.column != 0) & (unsigned_quotient(a.column * b.column, divisor) != b.column)
    wide = [v.column.cast("bigint") for v in (a, b)]
    exact = {"add": wide[0] + wide[1], "sub": wide[0] - wide[1], "mul": wide[0] * wide[1]}[name]
    return (exact < 0) | (exact > F.lit(kind.most))


def _arithmetic(name: str):
    @operator(name + "_checked")
    def run(ctx, args, want, params):
        values = same(ctx, args, want)
        if values is None:
            return None
        need(values[0].dtype.integer, f"{name}_checked needs integers, not {values[0].dtype}")
        ctx.fail(_overflow(name, *values), values, params)
        return ctx.apply(name, args, want, {})


for _name in ("add", "sub", "mul"):
    _arithmetic(_name)


def _division(name: str):
    @operator(name + "_checked")
    def run(ctx, args, want, params):
        values = same(ctx, args, want)
        if values is None:
            return None
        kind = values[0].dtype
        need(kind.integer and kind.width >= 32, f"{name}_checked needs 32 or 64 bits, not {kind}")
        ctx.fail(values[1].column == 0 if name[0] == "u" else invalid_division(*values), values, params)
        return ctx.apply(name, args, want, {})


for _name in ("div", "udiv", "mod", "umod"):
    _division(_name)


def _shift(name: str):
    @operator(name + "_checked")
    def run(ctx, args, want, params):
        values = same(ctx, args, want)
        if values is None:
            return None
        count, w = values[1].column, values[0].dtype.width
        ctx.fail((count < 0) | (count > w - 1), values, params)
        return ctx.apply(name, args, want, {})


for _name in ("sll", "srl", "sra", "rotl", "rotr"):
    _shift(_name)


def _unary(name: str):
    @operator(name + "_checked")
    def run(ctx, args, want, params):
        v = ctx.value(args[0], want)
        if v is None:
            return None
        need(v.dtype.kind == "int", f"{name}_checked needs a signed integer")
        ctx.fail(v.column == F.lit(v.dtype.least).cast(v.dtype.carrier), [v], params)
        return ctx.apply(name, args, want, {})


for _name in ("negate", "abs"):
    _unary(_name)


@operator("checked_op")
def checked_op(ctx, args, want, params):
    """The checked form of params['name'] on all arguments but the last, which is the mask of active rows."""
    *operands, mask = args
    return ctx.apply(params["name"] + "_checked", tuple(operands), want, {"where": mask})
