"""Columnar expressions and aggregates on Spark, with exact fixed-width semantics."""

from .plans.expr import aggregate, call, case_when, case_x_when, cast, col, const, gather, index, lit, null, pack, scatter, splat, store
from .plans.program import Lookup, Program, Result, SafetyCheckFailed, Table, Target, query, table
from .plans.serial import from_json, to_json
from .plans.sql import LowerError, ParseError, parse
from .session import Prepared, Session, create
from .types import BOOL, F32, F64, I8, I16, I32, I64, I128, U8, U16, U32, U64, TypeMismatch, timestamp

__all__ = [
    "BOOL", "F32", "F64", "I128", "I16", "I32", "I64", "I8", "U16", "U32", "U64", "U8",
    "LowerError", "Lookup", "ParseError", "Prepared", "Program", "Result", "SafetyCheckFailed", "Session", "Table", "Target", "TypeMismatch",
    "aggregate", "call", "case_when", "case_x_when", "cast", "col", "const", "create", "from_json", "gather", "index", "lit", "null", "pack", "parse",
    "query", "scatter", "splat", "store", "table", "timestamp", "to_json",
]


def __getattr__(name: str):
    """Every operator and aggregate as a function of its name: popcnt(x), sum_if(x, p), grouped_max(x, index, table)."""
    from .plans.catalog import AGGREGATES, OPERATORS

    if name in OPERATORS:
        return lambda *args, **params: call(name, *args, **params)
    base = name.removeprefix("grouped_").removesuffix("_if") if name not in AGGREGATES else name
    base = {"min": "min_agg", "max": "max_agg", "umin": "umin_agg", "umax": "umax_agg", "and": "and_agg", "or": "or_agg", "xor": "xor_agg", "andnot": "andnot_agg"}.get(base, base)
    if name == "grouped_count_if":
        base = "count_if"
    if base in AGGREGATES:
        if name.startswith("grouped_"):
            return lambda x, index, table, where=None: aggregate(base, x, where, group_idx=index, table=table)
        return lambda x, where=None: aggregate(base, x, where)
    raise AttributeError(name)
