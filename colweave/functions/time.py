"""Timestamps as ticks since the epoch: parts, differences and shifts, all flooring before 1970."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import I32, I64, DType, TypeMismatch, timestamp
from .registry import Value, any_null, need, operator

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def literal(value, unit: str = "us", utc: bool | None = None):
    """An ISO string (Z for UTC), a datetime, or ticks, as a timestamp expression."""
    from ..plans.expr import lit

    if isinstance(value, int):
        return lit(value, timestamp(unit, bool(utc)))
    moment = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    aware = moment.tzinfo is not None
    since = (moment if aware else moment.replace(tzinfo=UTC)) - EPOCH
    micros = (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
    kind = timestamp(unit, aware if utc is None else utc)
    ticks, rest = divmod(micros * kind.ticks, 1_000_000)
    if rest:
        raise TypeMismatch(f"{value!r} is no whole number of {unit}")
    return lit(ticks, kind)


def floor_div(a: Column, by: int) -> Column:
    """Quotient rounded down, exact for any bigint."""
    by = F.lit(by).cast("bigint")
    return F.call_function("div", a - F.pmod(a, by), by)


def _part(name: str, apply):
    @operator(name)
    def run(ctx, args, want, params):
        v = ctx.value(args[0])
        need(v is not None and v.dtype.kind == "time", f"{name} needs a timestamp")
        return v.but(apply(v.column, v.dtype.ticks).cast("int"), I32)


def _date(ticks: Column, per_second: int) -> Column:
    return F.date_from_unix_date(floor_div(ticks, 86_400 * per_second).cast("int"))


def _clock(ticks: Column, per_second: int, size: int, of: int) -> Column:
    return F.pmod(floor_div(ticks, size * per_second), F.lit(of).cast("bigint"))


_part("year", lambda t, s: F.year(_date(t, s)))
_part("month", lambda t, s: F.month(_date(t, s)))
_part("day", lambda t, s: F.dayofmonth(_date(t, s)))
_part("hour", lambda t, s: _clock(t, s, 3600, 24))
_part("minute", lambda t, s: _clock(t, s, 60, 60))
_part("second", lambda t, s: _clock(t, s, 1, 60))
# The epoch was a Thursday; Monday is 0.
_part("day_of_week", lambda t, s: F.pmod(floor_div(t, 86_400 * s) + 3, F.lit(7).cast("bigint")))


def shifted(ctx, name: str, args) -> Value | None:
    """add and sub with timestamps: ts - ts gives ticks, ts +- i64 and i64 + ts a timestamp; None without timestamps."""
    values = [ctx.value(a) for a in args]
    times = [v is not None and v.dtype.kind == "time" for v in values]
    if not any(times):
        return None
    a, b = (v or ctx.value(e, I64) for e, v in zip(args, values, strict=True))
    if all(times):
        need(name == "sub", "timestamps cannot be added")
        need(a.dtype == b.dtype, f"{a.dtype} and {b.dtype} differ in unit or zone")
        return Value(I64, a.column - b.column, any_null([a, b]))
    need(times[0] or name == "add", "a timestamp cannot be taken from a number")
    other = b if times[0] else a
    need(other.dtype == I64, f"a timestamp moves by i64 ticks, not {other.dtype}")
    kind: DType = a.dtype if times[0] else b.dtype
    return Value(kind, a.column + b.column if name == "add" else a.column - b.column, any_null([a, b]))


def from_spark(column: Column, kind: DType) -> Column:
    """Ticks of a Spark timestamp column; the session's zone is UTC."""
    micros = F.unix_micros(column.cast("timestamp"))
    if kind.ticks >= 1_000_000:
        return micros * F.lit(kind.ticks // 1_000_000).cast("bigint")
    return floor_div(micros, 1_000_000 // kind.ticks)


def to_spark(column: Column, kind: DType) -> Column:
    """A Spark timestamp; ns stays a bigint of ticks, since Spark keeps microseconds."""
    if kind.unit == "ns":
        return column
    stamp = F.timestamp_micros(column * F.lit(1_000_000 // kind.ticks).cast("bigint"))
    return stamp if kind.utc else stamp.cast("timestamp_ntz")


