"""Programs: named outputs over one input, run as few Spark plans.

All row-wise outputs of a program become one select, all aggregates one agg, all
grouped outputs of one table and index one groupBy, so that Spark reads the input
once for each shape of output.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import time
from ..functions.registry import AGGREGATES, OPERATORS, Value, bits_of, fit, literal, predicate
from ..operators.aggregates import Agg
from ..operators.ordering import with_row_number
from ..operators.products import products
from ..types import BY_NAME, U64, DType, TypeMismatch, of_spark
from . import catalog  # noqa: F401  registers all operators
from .expr import Expr, col

ROW = "_row"


class SafetyCheckFailed(ArithmeticError):
    """A checked operation failed on some row."""


def prepare(spark: SparkSession) -> None:
    """Settings that the lowering rests on: wrapping arithmetic and UTC.

    Spark captures them when a plan is analysed, so every run sets them first.
    """
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


class Table:
    """Declared columns: {"x": "i32", "y": "i32?"}; ? marks nullable, timestamps are DType values."""

    def __init__(self, columns: Mapping[str, str | DType]) -> None:
        self.columns: dict[str, tuple[DType, bool]] = {}
        for name, kind in columns.items():
            if isinstance(kind, DType):
                self.columns[name] = (kind, False)
                continue
            base = kind.rstrip("?")
            if base not in BY_NAME:
                raise TypeMismatch(f"unknown type {kind!r}")
            self.columns[name] = (BY_NAME[base], kind.endswith("?"))

    def __getitem__(self, name: str) -> Expr:
        if name not in self.columns:
            raise KeyError(name)
        return col(name, self.columns[name][0])

    def __getattr__(self, name: str) -> Expr:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


table = Table


def ingest(column: Column, kind: DType) -> Column:
    """A Spark column as the carrier of a logical type."""
    if kind.kind == "time":
        return time.from_spark(column, kind)
    if kind == U64:
        exact = column.cast("decimal(20,0)")
        return F.when(exact >= F.lit(Decimal(1 << 63)), (exact - F.lit(Decimal(1 << 64))).cast("bigint")).otherwise(exact.cast("bigint"))
    return column.cast(kind.carrier)


def emit(column: Column, kind: DType) -> Column:
    """The carrier of a logical type as a Spark column that shows its value."""
    if kind.kind == "time":
        return time.to_spark(column, kind)
    if kind == U64:
        exact = column.cast("decimal(20,0)")
        return F.when(column < 0, (exact + F.lit(Decimal(1 << 64))).cast("decimal(20,0)")).otherwise(exact)
    return column


class Context:
    """Evaluates expressions to Spark columns over one DataFrame."""

    def __init__(self, df: DataFrame, schema: Table | None = None, tables: Mapping[str, Any] | None = None, splats: Mapping[str, Any] | None = None) -> None:
        self.df, self.schema = df, schema.columns if schema else {}
        self.tables, self.splats = dict(tables or {}), dict(splats or {})
        self.fields = {f.name: f for f in df.schema.fields}
        self.known: dict[tuple[int, DType | None], tuple[Expr, Value | None]] = {}
        self.failures: list[Column] = []

    def value(self, e: Expr, want: DType | None = None) -> Value | None:
        key = (id(e), want)
        if key not in self.known:
            self.known[key] = (e, self._value(e, want))
        return self.known[key][1]

    def _value(self, e: Expr, want: DType | None) -> Value | None:
        if e.op == "lit":
            kind = e.params["dtype"] or want
            return None if kind is None else literal(e.params["value"], kind)
        special = getattr(self, "_" + e.op, None)
        if special:
            return special(e)
        if e.op in ("agg", "grouped", "pack", "scatter"):
            raise TypeMismatch(f"{e.op} is an output of its own, not an operand")
        return self.apply(e.op, e.args, want, e.params)

    def apply(self, name: str, args, want: DType | None, params) -> Value | None:
        if name not in OPERATORS:
            raise TypeMismatch(f"unknown operator {name!r}")
        return OPERATORS[name](self, args, want, params)

    def fail(self, bad: Column, values: list[Value], params) -> None:
        """Note where a checked operation fails: on rows that are not null and inside the mask."""
        for v in values:
            if v.nullable:
                bad = bad & v.column.isNotNull()
        if params.get("where") is not None:
            bad = bad & predicate(self, params["where"]).column
        self.failures.append(bad)

    def _col(self, e: Expr) -> Value:
        name = e.params["name"]
        if name not in self.fields:
            raise TypeMismatch(f"unknown column {name!r}")
        declared = self.schema.get(name)
        kind = e.params["dtype"] or (declared[0] if declared else of_spark(self.fields[name].dataType))
        nullable = declared[1] if declared else self.fields[name].nullable
        return Value(kind, ingest(F.col(f"`{name}`"), kind), nullable)

    def _splat(self, e: Expr) -> Value:
        source = self.splats[e.params["name"]]
        if isinstance(source, DataFrame):
            kind = e.params["dtype"] or of_spark(source.schema.fields[0].dataType)
            return Value(kind, ingest(source.select(source.columns[0]).scalar(), kind), True)
        if e.params["dtype"] is None:
            raise TypeMismatch(f"splat {e.params['name']!r} needs a type")
        return literal(source, e.params["dtype"])

    def _index(self, e: Expr) -> Value:
        if ROW not in self.fields:
            raise TypeMismatch("index needs order_by")
        return Value(e.params["dtype"], F.col(ROW).cast(e.params["dtype"].carrier))

    def _gather(self, e: Expr) -> Value:
        """A lookup in a list of literals, or a join that plan() put before the select."""
        source = self.tables[e.params["table"]]
        where = self.value(e.args[0])
        if isinstance(source, Lookup):
            place = _place(where).cast("int")
            return Value(source.dtype, F.get(F.array(*[literal(x, source.dtype).column for x in source.values]), place), source.nullable or where.nullable)
        name = self.joined[id(e)]
        kind = of_spark(self.fields[name].dataType)
        return Value(kind, ingest(F.col(name), kind), True)

    joined: Mapping[int, str] = {}

    def aggregate(self, e: Expr) -> Agg:
        fn = e.params["fn"]
        where = None
        if fn.endswith("_if") and fn not in AGGREGATES and fn[:-3] in AGGREGATES:
            fn = fn[:-3]
        if len(e.args) > 1:
            where = F.coalesce(predicate(self, e.args[1]).column, F.lit(False))
        if fn not in AGGREGATES:
            raise TypeMismatch(f"unknown aggregate {fn!r}")
        return AGGREGATES[fn](self, e.args[:1], where)


def _place(v: Value) -> Column:
    """An index as a bigint: 8 and 16 bits count from 0, whatever their sign."""
    return bits_of(v) if v.dtype.width < 32 else v.column.cast("bigint")


@dataclass(frozen=True)
class Lookup:
    """A short table of literals to gather from; longer ones are DataFrames of idx and value (of a repeated idx, the least value)."""

    values: list
    dtype: DType

    @property
    def nullable(self) -> bool:
        return any(v is None for v in self.values)


@dataclass(frozen=True)
class Target:
    """A dense table for grouped and scattered outputs: its size, and what its places hold before."""

    size: int
    initial: Any = 0


@dataclass
class Result:
    """The outputs of a run by shape; collect() brings small ones together."""

    vectors: DataFrame | None = None
    scalars: DataFrame | None = None
    grouped: dict[str, DataFrame] = field(default_factory=dict)
    packed: dict[str, DataFrame] = field(default_factory=dict)
    scattered: dict[str, DataFrame] = field(default_factory=dict)
    flag: DataFrame | None = None
    #: All grouped outputs of a table side by side, by the table's name.
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: The scalars and the flag of one scan, where both are plain aggregates.
    joint: DataFrame | None = None

    def check(self) -> Result:
        """Raise SafetyCheckFailed if a checked operation failed on any row. Scalars are kept from the same scan."""
        if self.joint is not None:
            row = self.joint.first()
            failed, kept = row[-1], self.joint.schema.fields[:-1]
            self.scalars = self.joint.sparkSession.createDataFrame([tuple(row)[:-1]], StructType(kept))
        else:
            failed = self.flag is not None and self.flag.first()[0]
        if failed:
            raise SafetyCheckFailed("a checked operation overflowed")
        return self

    def __getitem__(self, name: str):
        """The values of one output: a list, or one value for an aggregate."""
        for frames in (self.grouped, self.packed, self.scattered):
            if name in frames:
                rows = frames[name].collect()
                return [r[name] for r in sorted(rows, key=lambda r: r["idx"])] if "idx" in frames[name].columns else [r[name] for r in rows]
        if self.vectors is not None and name in self.vectors.columns:
            return [r[0] for r in self.vectors.select(f"`{name}`").collect()]
        if self.scalars is not None and name in self.scalars.columns:
            return self.scalars.select(f"`{name}`").first()[0]
        raise KeyError(name)


class Program:
    """An immutable, ordered map of names to expressions."""

    def __init__(self, outputs: Mapping[str, Expr], schema: Table | None = None) -> None:
        self.outputs, self.schema = dict(outputs), schema

    def of(self, *ops: str) -> dict[str, Expr]:
        return {n: e for n, e in self.outputs.items() if e.op in ops}

    def plan(
        self,
        df: DataFrame,
        *,
        tables: Mapping[str, Any] | None = None,
        splats: Mapping[str, Any] | None = None,
        order_by: list | None = None,
        keep: list[str] | None = None,
    ) -> Result:
        """The outputs as DataFrames, nothing run but what row numbers need. keep: input columns to carry beside vectors."""
        prepare(df.sparkSession)
        tables = dict(tables or {})
        if order_by is not None:
            df = with_row_number(df, order_by, ROW)
        df, joined = self._join_lookups(df, tables, splats)
        ctx = Context(df, self.schema, tables, splats)
        ctx.joined = joined
        out = Result()
        rows = {n: e for n, e in self.outputs.items() if e.op not in ("agg", "grouped", "pack", "scatter")}
        if rows:
            out.vectors = df.select(*[F.col(k) for k in keep or ()], *[self._vector(ctx, n, e) for n, e in rows.items()])
        sized = {e.params["size"] or f"{n}_size": Expr("agg", (e.args[1],), {"fn": "count_if"}) for n, e in self.of("pack").items()}
        totals = self.of("agg") | sized
        aggs = {n: ctx.aggregate(e) for n, e in totals.items()}
        if totals:
            out.scalars = self._scalars(df, aggs, list(totals))
        for name, e in self.of("pack").items():
            kept = df.where(F.coalesce(predicate(ctx, e.args[1]).column, F.lit(False)))
            columns = [F.col(ROW).alias("row")] if order_by is not None else []
            out.packed[name] = kept.select(*columns, self._vector(ctx, name, e.args[0]))
        out.grouped, out.tables = self._grouped(df, ctx, tables)
        for name, e in self.of("scatter").items():
            out.scattered[name] = self._scattered(df, ctx, name, e, tables.get(name))
        if ctx.failures:
            bad = ctx.failures[0]
            for more in ctx.failures[1:]:
                bad = bad | more
            failed = F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed")
            out.flag = df.agg(failed)
            if totals and not any(a.wrapping for a in aggs.values()):
                out.joint = df.agg(*[emit(a.value(), a.dtype).alias(n) for n, a in aggs.items()], failed)
        return out

    def run(self, df: DataFrame, **inputs: Any) -> Result:
        """plan(), after checking that no checked operation fails."""
        return self.plan(df, **inputs).check()

    def inspect(self, df: DataFrame, mode: str = "formatted", **inputs: Any) -> str:
        """Spark's plans of the outputs; mode is one of explain's: simple, extended, codegen, cost, formatted."""
        return "\n".join(_explained(f, mode) for f in self._frames(self.plan(df, **inputs)).values())

    def snapshot(self, df: DataFrame, **inputs: Any) -> dict[str, dict[str, str]]:
        """For debugging, by shape of output: its schema, its logical and physical plans and the code Spark generates for it."""
        frames = self._frames(self.plan(df, **inputs))
        return {n: {"schema": f.schema.simpleString(), "plans": _explained(f, "extended"), "code": _explained(f, "codegen")} for n, f in frames.items()}

    @staticmethod
    def _frames(result: Result) -> dict[str, DataFrame]:
        named = {"vectors": result.vectors, "scalars": result.scalars, **result.grouped, **result.packed, **result.scattered}
        return {n: f for n, f in named.items() if f is not None}

    @staticmethod
    def _vector(ctx: Context, name: str, e: Expr) -> Column:
        v = ctx.value(e)
        if v is None:
            raise TypeMismatch(f"output {name!r} has no type; give its literals one")
        return emit(v.column, v.dtype).alias(name)

    @staticmethod
    def _scalars(df: DataFrame, aggs: dict[str, Agg], order: list[str]) -> DataFrame:
        plain = [emit(a.value(), a.dtype).alias(n) for n, a in aggs.items() if not a.wrapping]
        wrapping = {n: a for n, a in aggs.items() if a.wrapping}
        if not wrapping:
            return df.agg(*plain)
        frame = products(df.select(*[a.column.alias(n) for n, a in wrapping.items()]), list(wrapping))
        frame = frame.select(*[emit(fit(F.coalesce(F.col(f"`{n}`"), F.lit(1)), a.dtype), a.dtype).alias(n) for n, a in wrapping.items()])
        if plain:
            # Both sides are one row by construction.
            frame = frame.crossJoin(F.broadcast(df.agg(*plain)))
        return frame.select(*[f"`{n}`" for n in order])

    def _grouped(self, df: DataFrame, ctx: Context, tables: Mapping[str, Any]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Each output's places and values, and all outputs of a table and index together, made by one groupBy."""
        by_index: dict[tuple[int, str], dict[str, Expr]] = {}
        for name, e in self.of("grouped").items():
            by_index.setdefault((id(e.args[1]), e.params["table"]), {})[name] = e
        out: dict[str, DataFrame] = {}
        whole: dict[str, DataFrame] = {}
        for (_, table_name), members in by_index.items():
            place = ctx.value(next(iter(members.values())).args[1], BY_NAME["i64"])
            if not place.dtype.integer:
                raise TypeMismatch(f"a group index is an integer, not {place.dtype}")
            aggs = {n: ctx.aggregate(e.args[0]) for n, e in members.items()}
            keyed = df.where(place.column.isNotNull())
            key = place.column.cast("bigint").alias("idx")
            plain = {n: a for n, a in aggs.items() if not a.wrapping}
            wrapping = {n: a for n, a in aggs.items() if a.wrapping}
            found = keyed.groupBy(key).agg(*[a.value().alias(n) for n, a in plain.items()]) if plain else None
            if wrapping:
                times = products(keyed.select(key, *[a.column.alias(n) for n, a in wrapping.items()]), list(wrapping), "idx")
                times = times.select("idx", *[fit(F.col(f"`{n}`"), a.dtype).alias(n) for n, a in wrapping.items()])
                found = times if found is None else found.join(times, "idx")
            made = _dense(found, tables.get(table_name), aggs)
            whole[table_name] = made if table_name not in whole else whole[table_name].join(made, "idx", "full")
            out |= {name: made.select("idx", f"`{name}`") for name in aggs}
        return out, whole

    @staticmethod
    def _scattered(df: DataFrame, ctx: Context, name: str, e: Expr, target: Target | None) -> DataFrame:
        """The last row, by row number, to write a place wins."""
        v, place = ctx.value(e.args[0]), ctx.value(e.args[1], BY_NAME["i64"])
        if ROW not in ctx.fields:
            raise TypeMismatch("scatter needs order_by")
        kept = df.where(F.coalesce(predicate(ctx, e.args[2]).column, F.lit(False))) if len(e.args) > 2 else df
        # Wrapped in a struct, so that a null that was written wins as well.
        last = F.max_by(F.struct(v.column.alias("v")), F.col(ROW))["v"]
        found = kept.groupBy(place.column.cast("bigint").alias("idx")).agg(last.alias("_new"), F.lit(True).alias("_set"))
        if target is None:
            return found.select("idx", emit(F.col("_new"), v.dtype).alias(name))
        start = literal(target.initial, v.dtype).column
        dense = df.sparkSession.range(target.size).withColumnRenamed("id", "idx").join(found, "idx", "left")
        return dense.select("idx", emit(F.when(F.col("_set"), F.col("_new")).otherwise(start), v.dtype).alias(name))

    def _join_lookups(self, df: DataFrame, tables: Mapping[str, Any], splats) -> tuple[DataFrame, dict[int, str]]:
        """Join every DataFrame that is gathered from; Spark broadcasts those its statistics show to be small."""
        joined: dict[int, str] = {}
        seen: set[int] = set()

        def visit(e: Expr) -> None:
            nonlocal df
            if id(e) in seen:
                return
            seen.add(id(e))
            for a in e.args:
                visit(a)
            if isinstance(e.params.get("where"), Expr):
                visit(e.params["where"])
            if e.op == "gather" and isinstance(tables[e.params["table"]], DataFrame):
                source = tables[e.params["table"]]
                ctx = Context(df, self.schema, tables, splats)
                ctx.joined = joined
                name, key = f"_g{len(joined)}", f"_i{len(joined)}"
                # Grouped by the key the join is on, so that a repeated key adds no rows and the grouping no shuffle of its own.
                side = source.groupBy(F.col(source.columns[0]).cast("bigint").alias(key)).agg(F.min(F.col(source.columns[1])).alias(name))
                df = df.join(side, _place(ctx.value(e.args[0], BY_NAME["i64"])) == F.col(key), "left").drop(key)
                joined[id(e)] = name

        for e in self.outputs.values():
            visit(e)
        return df, joined


def _dense(found: DataFrame, target: Any, aggs: Mapping[str, Agg]) -> DataFrame:
    """Groups combined into the table's first contents; places without rows keep them. Without a table, the groups alone."""
    if target is None:
        return found.select("idx", *[emit(F.col(f"`{n}`"), a.dtype).alias(n) for n, a in aggs.items()])
    if isinstance(target, DataFrame):
        first = target.select(F.col(target.columns[0]).cast("bigint").alias("idx"), F.col(target.columns[1]).alias("_old"))
    else:
        first = found.sparkSession.range(target.size).withColumnRenamed("id", "idx")
    both = first.join(found, "idx", "left")
    out = []
    for name, agg in aggs.items():
        if isinstance(target, DataFrame):
            old = ingest(F.col("_old"), agg.dtype)
        else:
            old = F.lit(target.initial).cast(agg.dtype.carrier if agg.dtype.width <= 64 else "decimal(38,0)")
        new = F.col(f"`{name}`")
        out.append(emit(F.when(new.isNull(), old).otherwise(agg.combine(old, new)), agg.dtype).alias(name))
    return both.select("idx", *out)


def _explained(df: DataFrame, mode: str) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def query(outputs: Mapping[str, Expr] | list[Expr] | None = None, **named: Expr) -> Program:
    """A program of named outputs; a list gives result_0, result_1, ..."""
    if isinstance(outputs, list):
        outputs = {f"result_{k}": e for k, e in enumerate(outputs)}
    return Program({**(outputs or {}), **named})
