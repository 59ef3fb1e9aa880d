"""Expressions as immutable trees, built with Python operators, methods and functions.

A node is an operator name, arguments and parameters. Nothing is typed here:
resolve.py gives types, lowering turns typed trees into Spark columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..types import BOOL, BY_NAME, I64, DType


@dataclass(frozen=True, eq=False)
class Expr:
    op: str
    args: tuple[Expr, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)

    def __add__(self, o):
        return call("add", self, o)

    def __radd__(self, o):
        return call("add", o, self)

    def __sub__(self, o):
        return call("sub", self, o)

    def __rsub__(self, o):
        return call("sub", o, self)

    def __mul__(self, o):
        return call("mul", self, o)

    def __rmul__(self, o):
        return call("mul", o, self)

    def __truediv__(self, o):
        return call("div", self, o)

    def __rtruediv__(self, o):
        return call("div", o, self)

    def __mod__(self, o):
        return call("mod", self, o)

    def __rmod__(self, o):
        return call("mod", o, self)

    def __neg__(self):
        return call("negate", self)

    def __abs__(self):
        return call("abs", self)

    def __lt__(self, o):
        return call("lt", self, o)

    def __le__(self, o):
        return call("le", self, o)

    def __gt__(self, o):
        return call("gt", self, o)

    def __ge__(self, o):
        return call("ge", self, o)

    def __eq__(self, o):
        return call("eq", self, o)

    def __ne__(self, o):
        return call("ne", self, o)

    __hash__ = object.__hash__

    def __and__(self, o):
        return call("p_and", self, o)

    def __rand__(self, o):
        return call("p_and", o, self)

    def __or__(self, o):
        return call("p_or", self, o)

    def __ror__(self, o):
        return call("p_or", o, self)

    def __xor__(self, o):
        return call("p_xor", self, o)

    def __rxor__(self, o):
        return call("p_xor", o, self)

    def __invert__(self):
        return call("p_not", self)

    def __bool__(self):
        raise TypeError("an expression has no truth value; use & | ~ and where()")

    def ifelse(self, yes, no) -> Expr:
        return call("select", self, yes, no)

    def cast(self, to: DType | str) -> Expr:
        return cast(self, to)

    def __getattr__(self, name: str):
        """Operators by name as methods: x.popcnt(), x.sll(2), x.is_null()."""
        from .catalog import AGGREGATES, OPERATORS

        if name in AGGREGATES or name in ALIASES and ALIASES[name] in AGGREGATES:
            return lambda where=None, *, group_idx=None, table=None: aggregate(name, self, where, group_idx=group_idx, table=table)
        if name in OPERATORS:
            return lambda *args, **params: call(name, self, *args, **params)
        raise AttributeError(name)


ALIASES = {"min": "min_agg", "max": "max_agg", "umin": "umin_agg", "umax": "umax_agg", "count": "count_if"}


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if x is None or isinstance(x, bool | int | float):
        return lit(x)
    from datetime import datetime

    if isinstance(x, datetime):
        from ..functions.time import literal

        return literal(x, "us")
    raise TypeError(f"{x!r} is neither an expression nor a literal")


def call(op: str, *args: Any, **params: Any) -> Expr:
    return Expr(op, tuple(map(wrap, args)), params)


def col(name: str, dtype: DType | str | None = None) -> Expr:
    """A column; its type comes from the program's schema or the DataFrame where not given."""
    return Expr("col", (), {"name": name, "dtype": BY_NAME[dtype] if isinstance(dtype, str) else dtype})


def lit(value: Any, dtype: DType | None = None) -> Expr:
    return Expr("lit", (), {"value": value, "dtype": BOOL if dtype is None and isinstance(value, bool) else dtype})


const = lit


def null(dtype: DType) -> Expr:
    return lit(None, dtype)


def splat(name: str, dtype: DType | None = None) -> Expr:
    """A one-row input spread over all rows."""
    return Expr("splat", (), {"name": name, "dtype": dtype})


def gather(index: Expr, table: str) -> Expr:
    """table[index]: a lookup in an input of that name."""
    return Expr("gather", (wrap(index),), {"table": table})


def index(dtype: DType = I64) -> Expr:
    """The row number, 0 to n - 1."""
    return Expr("index", (), {"dtype": dtype})


def cast(x: Any, to: DType | str) -> Expr:
    return call("cast", x, to=BY_NAME[to] if isinstance(to, str) else to)


def aggregate(op: str, x: Any, where: Any = None, *, group_idx: Any = None, table: str | None = None) -> Expr:
    """An aggregate of a whole column, or with group_idx into a dense table."""
    op = ALIASES.get(op, op)
    args = (wrap(x),) + ((wrap(where),) if where is not None else ())
    if (group_idx is None) != (table is None):
        raise TypeError("group_idx and table go together")
    out = Expr("agg", args, {"fn": op})
    return out if group_idx is None else Expr("grouped", (out, wrap(group_idx)), {"table": table})


def pack(x: Any, where: Any, dst_size: str | None = None) -> Expr:
    """The rows where a predicate holds, compacted; also their number."""
    return Expr("pack", (wrap(x), wrap(where)), {"size": dst_size})


def scatter(x: Any, index: Any, where: Any = None) -> Expr:
    """dst[index] = x, where a predicate holds; the last row to write a place wins."""
    return Expr("scatter", (wrap(x), wrap(index)) + ((wrap(where),) if where is not None else ()))


def store(x: Any, where: Any, previous: Any) -> Expr:
    """x where a predicate holds; elsewhere the place keeps what it had."""
    return call("cond_store", x, where, previous)


def case_when(*branches: tuple[Any, Any], default: Any = None) -> Expr:
    """The value of the first condition that is true; null or the default if none is."""
    flat = [x for pair in branches for x in pair]
    return call("case_when", *flat, *([] if default is None else [default]), default=default is not None)


def case_x_when(x: Any, *branches: tuple[Any, Any], default: Any = None) -> Expr:
    return case_when(*[(call("eq", x, a), b) for a, b in branches], default=default)
