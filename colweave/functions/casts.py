"""Casts between the logical types: truncation, extension, conversion and reinterpretation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, BY_NAME, F32, F64, I32, I64, U64, DType
from .registry import Value, bits_of, fit, literal, need, operator, reinterpret

TWO63 = 2.0**63


def integer_cast(v: Value, to: DType) -> Value:
    """Narrowing keeps low bits; widening extends by the sign of the source type; equal widths keep the bits."""
    if to.width <= v.dtype.width:
        return v.but(fit(v.column.cast("bigint"), to), to)
    return v.but(fit((bits_of(v) if v.dtype.kind == "uint" else v.column.cast("bigint")), to), to)


def extended(v: Value, to: DType, zero: bool) -> Value:
    wide = bits_of(v) if zero else reinterpret(v, BY_NAME[f"i{v.dtype.width}"]).column.cast("bigint")
    return v.but(fit(wide, to), to)


def to_float(v: Value, to: DType) -> Column:
    if v.dtype == U64:
        half = F.call_function("shiftrightunsigned", v.column, F.lit(1)).bitwiseOR(v.column.bitwiseAND(F.lit(1).cast("bigint")))
        return F.when(v.column >= 0, v.column.cast(to.carrier)).otherwise(half.cast(to.carrier) * F.lit(2.0)).cast(to.carrier)
    return v.column.cast(to.carrier)


def from_float(v: Value, to: DType) -> Column:
    """Truncates toward zero."""
    if to == U64:
        above = (v.column.cast("double") - F.lit(TWO63)).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
        return F.when(v.column < TWO63, v.column.cast("bigint")).otherwise(above)
    if to.kind == "uint":
        return fit(v.column.cast("bigint"), to)
    return v.column.cast(to.carrier)


def convert(v: Value, to: DType) -> Value:
    """The generic cast: by the kinds of the two types."""
    have = v.dtype
    if have == to:
        return v
    if "time" in (have.kind, to.kind):
        need({have, to} & {I64} != set(), f"timestamps cast to and from i64 only, not {have} to {to}")
        return v.but(v.column, to)
    if to == BOOL:
        need(have.integer, f"{have} is no integer")
        return v.but(v.column != 0, BOOL)
    if have == BOOL:
        return v.but(v.column.cast("int").cast(to.carrier), to)
    if have.integer and to.integer:
        if to.width > have.width:
            return extended(v, to, to.kind == "uint")
        return integer_cast(v, to)
    if have.integer:
        return v.but(to_float(v, to), to)
    return v.but(from_float(v, to) if to.integer else v.column.cast(to.carrier), to)


def _literal_or(ctx, expr, to: DType) -> Value:
    """A literal under a cast is a literal of that type."""
    if expr.op == "lit" and expr.params["dtype"] is None and to != BOOL:
        value = expr.params["value"]
        if to.integer and isinstance(value, float):
            return convert(literal(value, F64), to)
        return literal(value, to)
    v = ctx.value(expr)
    if v is None:
        v = ctx.value(expr, to)
    return v


@operator("cast")
def cast(ctx, args, want, params):
    return convert(_literal_or(ctx, args[0], params["to"]), params["to"])


def _named(name: str, to: DType):
    @operator(name)
    def run(ctx, args, want, params):
        return convert(_literal_or(ctx, args[0], to), to)


for _name, _type in BY_NAME.items():
    if _name not in ("bool",):
        _named(_name, _type)


@operator("trunc")
def trunc(ctx, args, want, params):
    v, to = ctx.value(args[0]), params["to"]
    need(v is not None and v.dtype.integer and to.integer and to.width <= v.dtype.width, "trunc keeps low bits: it cannot widen")
    return integer_cast(v, to)


@operator("trunc_checked")
def trunc_checked(ctx, args, want, params):
    """Fails where the value is outside the target's range."""
    out = trunc(ctx, args, want, params)
    v = ctx.value(args[0])
    back = extended(out, v.dtype, out.dtype.kind == "uint") if out.dtype.width < v.dtype.width else out
    ctx.fail(back.column != v.column, [v], params)
    return out


@operator("sext")
def sext(ctx, args, want, params):
    v, to = ctx.value(args[0]), params["to"]
    need(v is not None and v.dtype.integer and to.integer and to.width > v.dtype.width, "sext must widen")
    return extended(v, to, False)


@operator("zext")
def zext(ctx, args, want, params):
    v, to = ctx.value(args[0]), params["to"]
    need(v is not None and v.dtype.integer and to.integer and to.width > v.dtype.width, "zext must widen")
    return extended(v, to, True)


def _signedness(name: str, zero: bool):
    @operator(name)
    def run(ctx, args, want, params):
        v, to = ctx.value(args[0]), params["to"]
        need(v is not None and v.dtype.numeric and to.numeric, f"{name} needs numbers")
        if v.dtype.integer and to.integer:
            return extended(v, to, zero) if to.width > v.dtype.width else integer_cast(v, to)
        kind = "u" if zero else "i"
        if v.dtype.integer:
            return convert(reinterpret(v, BY_NAME[f"{kind}{v.dtype.width}"]), to)
        if to.integer:
            return reinterpret(convert(v, BY_NAME[f"{kind}{to.width}"]), to)
        return convert(v, to)


_signedness("signed_cast", False)
_signedness("unsigned_cast", True)


@operator("int_cast")
def int_cast(ctx, args, want, params):
    """kind: trunc, sext or zext; checked for a checked truncation."""
    name = params["kind"] + ("_checked" if params.get("checked") else "")
    return ctx.apply(name, args, want, params)


@operator("float_cast")
def float_cast(ctx, args, want, params):
    name = "unsigned_cast" if params.get("is_unsigned") else "signed_cast"
    return ctx.apply(name, args, want, params)


@operator("bitcast")
def bitcast(ctx, args, want, params):
    """The same bits as f32 and i32, or f64 and i64: an Arrow view of the whole column, nulls kept. Spark has no expression for it."""
    v, to = ctx.value(args[0]), params["to"]
    need(v is not None and (v.dtype, to) in VIEWS, f"no bitcast from {v.dtype if v else 'a literal'} to {to}")
    return v.but(_viewed(to)(v.column), to)


VIEWS = {(F32, I32), (I32, F32), (F64, I64), (I64, F64)}


def _viewed(to: DType):
    name = {"i32": "int32", "i64": "int64", "f32": "float32", "f64": "float64"}[to.name]

    @F.arrow_udf(to.carrier)
    def view(values: pa.Array) -> pa.Array:
        return values.view(pa.type_for_alias(name))

    return view
