"""The engine's queries over the test tables, each with the same query for DuckDB."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import literal as moment
from .operators.ordering import with_row_number
from .plans import kernels
from .plans.expr import Expr, aggregate, call, case_when, case_x_when, col, gather, index, lit, pack, scatter, splat, store
from .plans.program import Lookup, Table, Target, prepare, query
from .plans.sql import parse
from .programs import COLUMNS, SAMPLES
from .types import BY_NAME, F64, I8, I16, I32, I64, U8, U16, U32, U64, timestamp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns that hold nulls; the others are declared without.
NULLABLE = {"qn", "pn", "dn", "late_n"}
#: Types of the columns, by the type each is cast to.
SPARK_TYPES = {"INT": I32, "BIGINT": I64, "SMALLINT": I16, "TINYINT": I8, "DOUBLE": F64, "FLOAT": BY_NAME["f32"]}
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def lineitem(spark: SparkSession, sf_dir: str, *names: str, keys: bool = False) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.selectExpr(*(KEY if keys else []), *[f"{COLUMNS[n]} AS {n}" for n in names])


def derived(names, extra: str = "") -> str:
    return f"(SELECT {extra}{', '.join(f'{COLUMNS[n]} AS {n}' for n in names)} FROM lineitem) t"


def used(*texts: str) -> list[str]:
    words = set(re.findall(r"\w+", " ".join(texts)))
    return [n for n in COLUMNS if n in words]


def c(name: str) -> Expr:
    """A derived column, typed; its nullability is that of Schema."""
    if name == "returned":
        return col(name, BY_NAME["bool"])
    return col(name, SPARK_TYPES[re.findall(r"CAST\(.* AS (\w+)\)", COLUMNS[name])[-1]] if name not in NULLABLE else I32)


def schema(names) -> Table:
    table = Table({})
    table.columns = {n: (c(n).params["dtype"], n in NULLABLE) for n in names}
    return table


def columns_of(outputs: dict[str, Expr]) -> list[str]:
    found: dict[str, None] = {}

    def visit(e: Expr) -> None:
        if e.op == "col":
            found[e.params["name"]] = None
        for a in e.args:
            visit(a)

    for e in outputs.values():
        visit(e)
    return list(found)


def register(name: str, outputs: dict[str, Expr], oracle: str | None, shape: str = "vectors", **inputs) -> None:
    """A query of one shape of output; oracle is a DuckDB select list over the derived columns, or a whole query."""
    names = columns_of(outputs)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        program = query(outputs)
        program.schema = schema(names)
        ordered = "order_by" in inputs
        made = {k: f(spark, sf_dir) if callable(f) else f for k, f in inputs.items()}
        made = {k: {n: g(spark, sf_dir) if callable(g) else g for n, g in v.items()} if isinstance(v, dict) else v for k, v in made.items()}
        result = program.plan(lineitem(spark, sf_dir, *names, keys=ordered), **made)
        found = getattr(result, shape)
        return next(iter(found.values())) if isinstance(found, dict) else found

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle if oracle.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {oracle} FROM {derived(names)}"


def _samples() -> None:
    for name, sample in SAMPLES.items():
        for shape, select, suffix in (("vectors", sample.rows, ""), ("scalars", sample.totals, "_totals" if sample.rows else "")):
            if not select:
                continue

            def run(spark: SparkSession, sf_dir: str, text=sample.text, shape=shape) -> DataFrame:
                program = parse(text)
                return getattr(program.plan(lineitem(spark, sf_dir, *program.schema.columns)), shape)

            QUERIES[f"sql_{name}{suffix}"] = run
            ORACLE_SQL[f"sql_{name}{suffix}"] = f"SELECT {select} FROM {derived(used(sample.text, select))}"


_samples()

# Projections, predicates, selection.
scale = lit(10_000, I64)
disc64, tax64 = c("disc").cast(I64), c("tax").cast(I64)
revenue = c("price") * (scale - disc64) / scale
charged = revenue * (scale + tax64) / scale
REVENUE, CHARGED = "price * (10000 - disc) // 10000", "(price * (10000 - disc) // 10000) * (10000 + tax) // 10000"
register("proj_revenue", {"revenue": revenue}, f"{REVENUE} AS revenue")
register("proj_charge", {"revenue": revenue, "charge": charged}, f"{REVENUE} AS revenue, {CHARGED} AS charge")
register(
    "proj_multi_type",
    {
        "lane": c("line8").sll(1).bit_and(lit(127, I8)),
        "wide": c("qty16").cast(I32) * c("qty"),
        "high": call("max", c("qty16"), 30),
        "back": call("sext", c("qty16"), to=I64) % lit(7, I64),
    },
    "CAST((line8 * 2) & 127 AS TINYINT) AS lane, qty16 * qty AS wide, GREATEST(qty16, 30)::SMALLINT AS high, CAST(qty16 AS BIGINT) % 7 AS back",
)
big, lately = c("qty") >= 25, c("delay") > 30
register(
    "pred_and_or_xor",
    {"a": big & lately, "o": big | lately, "x": big ^ lately, "n": ~big, "an": call("p_andnot", big, lately), "xn": call("p_xnor", big, lately)},
    "qty >= 25 AND delay > 30 AS a, qty >= 25 OR delay > 30 AS o, (qty >= 25) <> (delay > 30) AS x, NOT qty >= 25 AS n, NOT qty >= 25 AND delay > 30 AS an, (qty >= 25) = (delay > 30) AS xn",
)
some, other = c("qn") > 25, c("late_n") > 30
register(
    "pred_null_strict",
    {"a": some & other, "o": some | other, "x": some ^ other},
    "CASE WHEN qn IS NULL OR late_n IS NULL THEN NULL ELSE qn > 25 AND late_n > 30 END AS a, CASE WHEN qn IS NULL OR late_n IS NULL THEN NULL ELSE qn > 25 OR late_n > 30 END AS o, "
    "(qn > 25) <> (late_n > 30) AS x",
)
register(
    "pred_compare",
    {k: call(k, c("qty"), c("delay")) for k in ("eq", "ne", "gt", "ge", "lt", "le")},
    "qty = delay AS eq, qty <> delay AS ne, qty > delay AS gt, qty >= delay AS ge, qty < delay AS lt, qty <= delay AS le",
)
register(
    "pred_tests",
    {
        "bt": call("bit_test", c("qty"), c("delay")),
        "btn": call("bit_testn", c("qty"), c("delay")),
        "pos": (c("qty") - 25).is_positive(),
        "neg": (c("qty") - 25).is_negative(),
        "b": (c("qty") - 25).bool2bit(),
        "i": big.bit2bool(),
    },
    "(qty & delay) <> 0 AS bt, (qty & delay) = 0 AS btn, qty > 25 AS pos, qty < 25 AS neg, qty <> 25 AS b, CAST(qty >= 25 AS TINYINT) AS i",
)
register(
    "select_case",
    {"picked": big.ifelse(c("price"), lit(0, I64)), "zeroed": call("zero_select", big, c("price")), "flag": big.ifelse(lately, ~lately)},
    "CASE WHEN qty >= 25 THEN price ELSE 0 END AS picked, CASE WHEN qty >= 25 THEN price ELSE 0 END AS zeroed, CASE WHEN qty >= 25 THEN delay > 30 ELSE NOT delay > 30 END AS flag",
)
register(
    "case_when",
    {"band": case_when((c("qty") < 10, lit(1, I32)), (c("qty") < 30, lit(2, I32)), default=lit(3, I32)), "open": case_when((c("qn") > 40, c("qn")))},
    "CASE WHEN qty < 10 THEN 1 WHEN qty < 30 THEN 2 ELSE 3 END AS band, CASE WHEN qn > 40 THEN qn END AS open",
)
register(
    "case_x_when",
    {"name": case_x_when(c("line"), (1, lit(10, I64)), (2, lit(20, I64)), default=lit(0, I64)), "qn1": case_x_when(c("qn"), (1, lit(1, I8)))},
    "CAST(CASE line WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END AS BIGINT) AS name, CAST(CASE qn WHEN 1 THEN 1 END AS TINYINT) AS qn1",
)
register("if_else_null", {"v": call("if_else_null", some, c("qn"))}, "CASE WHEN qn > 25 THEN qn END AS v")
register("cond_store", {"v": store(c("price"), big, c("ord"))}, "CASE WHEN qty >= 25 THEN price ELSE ord END AS v")

# Whole-column aggregates.
register("agg_sum", {"total": c("price").sum(), "small": c("qty").sum()}, "CAST(SUM(price) AS BIGINT) AS total, CAST(SUM(qty) AS INT) AS small", "scalars")
register("agg_sum_if", {"total": c("price").sum(big & lately)}, "CAST(SUM(price) FILTER (WHERE qty >= 25 AND delay > 30) AS BIGINT) AS total", "scalars")
register(
    "agg_min_max",
    {"low": c("price").min(), "high": c("price").max(big), "ulow": c("qty").umin(), "uhigh": (c("qty") - 25).umax()},
    "MIN(price) AS low, MAX(price) FILTER (WHERE qty >= 25) AS high, MIN(qty) AS ulow, CASE WHEN MIN(qty) < 25 THEN -1 ELSE MAX(qty) - 25 END AS uhigh",
    "scalars",
)
register(
    "agg_count_if", {"n": aggregate("count_if", big), "both": big.count(lately)}, "COUNT(*) FILTER (WHERE qty >= 25) AS n, COUNT(*) FILTER (WHERE qty >= 25 AND delay > 30) AS both", "scalars"
)
never = c("qty") < 0
register(
    "agg_empty_identity",
    {"s": c("qty").sum(never), "p": c("qty").product(never), "low": c("qty").min(never), "high": c("qty").max(never), "ones": c("qty").and_agg(never), "zeros": c("qty").or_agg(never)},
    "COALESCE(CAST(SUM(qty) FILTER (WHERE qty < 0) AS INT), 0) AS s, 1 AS p, COALESCE(MIN(qty) FILTER (WHERE qty < 0), 2147483647) AS low, "
    "COALESCE(MAX(qty) FILTER (WHERE qty < 0), -2147483648) AS high, COALESCE(BIT_AND(qty) FILTER (WHERE qty < 0), -1) AS ones, COALESCE(BIT_OR(qty) FILTER (WHERE qty < 0), 0) AS zeros",
    "scalars",
)
register(
    "agg_bits",
    {"a": c("ord").and_agg(), "o": c("ord").or_agg(big), "x": c("price").xor_agg(), "an": c("ord").andnot_agg()},
    "BIT_AND(ord) AS a, BIT_OR(ord) FILTER (WHERE qty >= 25) AS o, BIT_XOR(price) AS x, ~BIT_OR(ord) AS an",
    "scalars",
)
register(
    "agg_bool",
    {"a": aggregate("and_agg", big), "o": aggregate("or_agg", big), "an": aggregate("andnot_agg", never), "al": aggregate("all", some), "an_y": aggregate("any", some)},
    "BOOL_AND(qty >= 25) AS a, BOOL_OR(qty >= 25) AS o, NOT BOOL_OR(qty < 0) AS an, BOOL_AND(COALESCE(qn > 25, false)) AS al, BOOL_OR(COALESCE(qn > 25, false)) AS an_y",
    "scalars",
)
register("agg_xor_bool", {"odd": aggregate("xor_agg", big)}, "COUNT(*) FILTER (WHERE qty >= 25) % 2 = 1 AS odd", "scalars")
register("agg_product", {"p": c("three").product(), "f": c("fl").product(c("ord") < 3)}, "CAST(PRODUCT(three) AS BIGINT) AS p, PRODUCT(fl) FILTER (WHERE ord < 3) AS f", "scalars")
register("agg_sum_i128", {"wide": c("price").sum_wide()}, "CAST(SUM(price) AS DECIMAL(38,0)) AS wide", "scalars")
register(
    "agg_null_counts",
    {"n": c("qn").count_notnull(), "some": c("qn").has_nulls(), "none": c("qty").has_nulls(), "total": c("qn").sum(other)},
    "COUNT(qn) AS n, BOOL_OR(qn IS NULL) AS some, BOOL_OR(qty IS NULL) AS none, CAST(SUM(qn) FILTER (WHERE late_n > 30) AS INT) AS total",
    "scalars",
)

# Row numbers, packing, lookups, scattering, one-row inputs.
NUMBERED = f"(SELECT row_number() OVER (ORDER BY {', '.join(KEY)}) - 1 AS row, * FROM lineitem)"
register("index_rows", {"row": index(I64), "qty": c("qty")}, f"SELECT row, {COLUMNS['qty']} AS qty FROM {NUMBERED}", order_by=KEY)
register("pack_filter", {"kept": pack(c("price"), big)}, f"SELECT row, {COLUMNS['price']} AS kept FROM {NUMBERED} WHERE l_quantity >= 25", "packed", order_by=KEY)
register("pack_size", {"kept": pack(c("price"), big)}, "COUNT(*) FILTER (WHERE qty >= 25) AS kept_size", "scalars")
register("find_true_indices", {"at": pack(index(I64), big)}, f"SELECT row, row AS at FROM {NUMBERED} WHERE l_quantity >= 25", "packed", order_by=KEY)
register("find_null_indices", {"at": pack(index(I64), c("qn").is_null())}, f"SELECT row, row AS at FROM {NUMBERED} WHERE l_orderkey % 7 = 0", "packed", order_by=KEY)
register("find_notnull_indices", {"at": pack(index(I64), c("qn").is_not_null())}, f"SELECT row, row AS at FROM {NUMBERED} WHERE l_orderkey % 7 <> 0", "packed", order_by=KEY)
register(
    "scatter_last",
    {"last": scatter(c("price"), c("prt"))},
    f"SELECT l_partkey AS idx, ARG_MAX({COLUMNS['price']}, row) AS last FROM {NUMBERED} GROUP BY l_partkey",
    "scattered",
    order_by=KEY,
)
register(
    "cond_scatter",
    {"last": scatter(c("price"), c("line"), big)},
    f"SELECT i AS idx, COALESCE(last, -1) AS last FROM range(10) r(i) LEFT JOIN (SELECT l_linenumber AS k, ARG_MAX({COLUMNS['price']}, row) AS last FROM {NUMBERED} WHERE l_quantity >= 25 GROUP BY 1) ON i = k",
    "scattered",
    order_by=KEY,
    tables={"last": Target(10, -1)},
)
register(
    "gather_literal",
    {"v": gather(c("line") - 1, "squares")},
    "CAST([1, 4, 9, 16, 25, 36, 49, 64][line] AS BIGINT) AS v",
    tables={"squares": Lookup([k * k for k in range(1, 9)], I64)},
)
register(
    "splat_scale",
    {"share": c("qty64") * 100 / splat("most", I64), "moved": c("price") + splat("step", I64)},
    "qty64 * 100 // (SELECT MAX(CAST(l_quantity AS BIGINT)) FROM lineitem) AS share, price + 7 AS moved",
    splats={"most": lambda spark, sf: spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.max(F.col("l_quantity").cast("bigint"))), "step": 7},
)


def gather_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return query(region=gather(col("c_nationkey"), "nation")).plan(customer, tables={"nation": nation}, keep=["c_custkey"]).vectors


QUERIES["gather_nation"] = gather_nation
ORACLE_SQL["gather_nation"] = "SELECT c_custkey, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"

# Groups by a dense index.
place = c("line") - 1
GROUPED = "SELECT CAST(line - 1 AS BIGINT) AS idx, {} FROM " + derived(["line", "price", "qty", "qn", "ord", "three", "returned"]) + " GROUP BY 1"


def group(name: str, e: Expr, oracle: str, table=None) -> None:
    register(name, {"v": Expr("grouped", (e, place), {"table": "t"})}, GROUPED.format(oracle + " AS v") if table is None else oracle, "grouped", **({"tables": {"t": table}} if table else {}))


group("group_sum", c("price").sum(), "CAST(SUM(price) AS BIGINT)")
group("group_sum_if", c("price").sum(big), "COALESCE(CAST(SUM(price) FILTER (WHERE qty >= 25) AS BIGINT), 0)")
group("group_product", c("three").product(), "CAST(PRODUCT(three) AS BIGINT)")
group("group_min", c("price").min(), "MIN(price)")
group("group_max", c("price").max(c("returned")), "COALESCE(MAX(price) FILTER (WHERE returned), -9223372036854775808)")
group("group_umin", c("qty").umin(), "MIN(qty)")
group("group_umax", c("qty").umax(), "MAX(qty)")
group("group_and", c("ord").and_agg(), "BIT_AND(ord)")
group("group_or", c("ord").or_agg(), "BIT_OR(ord)")
group("group_xor", c("ord").xor_agg(), "BIT_XOR(ord)")
group("group_andnot", c("ord").andnot_agg(), "~BIT_OR(ord)")
group("group_count_if", aggregate("count_if", big), "COUNT(*) FILTER (WHERE qty >= 25)")
group("group_nulls", c("qn").sum(), "COALESCE(CAST(SUM(qn) AS INT), 0)")
group(
    "group_dense",
    c("price").sum(),
    f"SELECT i AS idx, CAST(5 + COALESCE(s, 0) AS BIGINT) AS v FROM range(10) r(i) LEFT JOIN (SELECT line - 1 AS k, SUM(price) AS s FROM {derived(['line', 'price'])} GROUP BY 1) ON i = k",
    Target(10, 5),
)

# Nulls.
register("null_coalesce", {"v": call("coalesce", c("qn"), c("late_n"), 0), "z": c("qn").zeronull()}, "COALESCE(qn, late_n, 0) AS v, COALESCE(qn, 0) AS z")
register("null_nullif", {"v": call("nullif", c("pn"), 0)}, "NULLIF(pn, 0) AS v")
register(
    "null_tests",
    {
        "n": c("qn").is_null(), "nn": c("qn").is_not_null(), "t": some.is_true(), "nt": some.is_not_true(), "f": some.is_false(), "nf": some.is_not_false(),
        "tu": c("qn").true_unless_null(), "cs": call("combine_selection", c("qn"), c("late_n")),
    },
    "qn IS NULL AS n, qn IS NOT NULL AS nn, COALESCE(qn > 25, false) AS t, NOT COALESCE(qn > 25, false) AS nt, COALESCE(NOT qn > 25, false) AS f, COALESCE(qn > 25, true) AS nf, "
    "CASE WHEN qn IS NOT NULL THEN true END AS tu, qn IS NOT NULL OR late_n IS NOT NULL AS cs",
)
register(
    "distinct_from",
    {"d": call("is_distinct", c("qn"), c("late_n")), "s": call("is_not_distinct", c("qn"), c("late_n"))},
    "qn IS DISTINCT FROM late_n AS d, qn IS NOT DISTINCT FROM late_n AS s",
)
register(
    "null_arith",
    {"a": c("qn") + c("pn"), "m": call("least", c("qn"), c("late_n")), "g": call("greatest", c("qn"), c("late_n"), c("dn")), "d": call("div", c("pn"), c("qn"), null_on_invalid_division=True)},
    "qn + pn AS a, CASE WHEN qn IS NOT NULL AND late_n IS NOT NULL THEN LEAST(qn, late_n) END AS m, "
    "CASE WHEN qn IS NOT NULL AND late_n IS NOT NULL AND dn IS NOT NULL THEN GREATEST(qn, late_n, dn) END AS g, CASE WHEN qn <> 0 THEN pn // qn END AS d",
)
register(
    "safe_division",
    {"q": c("prt32") / c("disc"), "r": c("prt32") % c("disc")},
    "CASE WHEN disc = 0 THEN prt32 ELSE prt32 // disc END AS q, CASE WHEN disc = 0 THEN 0 ELSE prt32 % disc END AS r",
)

# Bits.
register("bits_popcnt", {"v": c("price").popcnt(), "w": c("ord32").popcnt()}, "CAST(bit_count(price) AS BIGINT) AS v, CAST(bit_count(ord32) AS INT) AS w")
register("bits_lzcnt", {"v": c("ord").lzcnt(), "w": c("line16").lzcnt()}, "CAST(CASE WHEN ord = 0 THEN 64 ELSE 64 - length(bin(ord)) END AS BIGINT) AS v, CAST(16 - length(bin(line16)) AS SMALLINT) AS w")
register("bits_tzcnt", {"v": c("ord").tzcnt()}, "CAST(bit_count((ord & -ord) - 1) AS BIGINT) AS v")
register("bits_log2", {"v": c("ord").log2(), "n": (c("ord") + 1).log2_no_zero()}, "CAST(length(bin(ord)) - 1 AS BIGINT) AS v, CAST(length(bin(ord + 1)) - 1 AS BIGINT) AS n")
register(
    "bits_floor_ceil",
    {"f": c("ord").bit_floor(), "u": c("ord").bit_ceil(), "one": c("ord").has_single_bit()},
    "CASE WHEN ord = 0 THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(ord)) - 1) END AS f, CASE WHEN ord <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(ord - 1)) END AS u, (ord & (ord - 1)) = 0 AS one",
)
register(
    "bits_byteswap",
    {"v": c("line16").byteswap(), "w": call("zext", c("prt16"), to=I32).byteswap().srl(16)},
    "CAST(line16 * 256 AS SMALLINT) AS v, CAST(CAST(prt16 & 255 AS INT) * 256 + (prt16 >> 8) AS INT) AS w",
)
register(
    "bits_rot",
    {"l": c("ord").rotl(5), "r": c("ord").sll(5).rotr(5), "q": c("qty16").cast(I32).rotl(c("line"))},
    "ord * 32 AS l, ord AS r, CAST(qty16 * (1 << line) AS INT) AS q",
)
register(
    "bits_shift",
    {"l": c("qty").sll(3), "s": (c("qty") - 25).sra(1), "u": c("qty").srl(1), "m": c("qty").sll(33)},
    "qty * 8 AS l, CAST(floor((qty - 25) / 2.0) AS INT) AS s, qty >> 1 AS u, qty * 2 AS m",
)
register(
    "bits_logic",
    {"a": c("qty").bit_and(c("delay")), "o": c("qty").bit_or(c("delay")), "x": c("qty").bit_xor(c("delay")), "an": c("qty").bit_andnot(c("delay")), "xn": c("qty").bit_xnor(c("delay")), "n": call("not", c("qty"))},
    "qty & delay AS a, qty | delay AS o, xor(qty, delay) AS x, ~qty & delay AS an, ~xor(qty, delay) AS xn, ~qty AS n",
)
register(
    "bits_permute",
    {"swap": c("price").permute_i64_i32(idxs=[1, 0]).srl(32), "low": call("permute", call("zext", c("prt16"), to=I32), idxs=[1, 0, 2, 3])},
    "price & 4294967295 AS swap, CAST(CAST(prt16 & 255 AS INT) * 256 + (prt16 >> 8) AS INT) AS low",
)
register("bits_sign", {"s": (c("qty") - 25).sign(), "z": (c("qty") - 25).sign_no_zero(), "cp": call("copysign", c("delay"), c("qty") - 25)},
         "CASE WHEN qty < 25 THEN -1 WHEN qty = 25 THEN 0 ELSE 1 END AS s, CASE WHEN qty < 25 THEN -1 ELSE 1 END AS z, CASE WHEN qty < 25 THEN -delay WHEN qty = 25 THEN 0 ELSE delay END AS cp")

# Casts and unsigned numbers.
register(
    "cast_trunc_sext_zext",
    {"t": call("trunc", c("price"), to=I8), "s": call("sext", c("qty16"), to=I64), "z": call("zext", c("qty16") - 25, to=I32), "u": c("qty").cast(U8).cast(I32)},
    "CAST(CASE WHEN price % 256 > 127 THEN price % 256 - 256 ELSE price % 256 END AS TINYINT) AS t, CAST(qty16 AS BIGINT) AS s, CAST((qty16 - 25) & 65535 AS INT) AS z, qty & 255 AS u",
)
register(
    "cast_float",
    {"f": c("price").cast(F64), "i": (c("fp") * 1.5).cast(I64), "n": call("negate", c("fh")).cast(I32), "g": c("gq").cast(F64)},
    "CAST(price AS DOUBLE) AS f, CAST(trunc(fp * 1.5::DOUBLE) AS BIGINT) AS i, CAST(trunc(-fh) AS INT) AS n, CAST(gq AS DOUBLE) AS g",
)
wrapped = (c("qty64") - 25).cast(U64)
register(
    "unsigned_cmp_div",
    {"gt": wrapped > lit(10, U64), "q": wrapped / lit(3, U64), "r": wrapped % lit(7, U64), "v": wrapped, "b": (c("qty") - 25).cast(U32).cast(U64), "w": (c("qty16") + 300).cast(U16)},
    "CAST((qty64 - 25 + CASE WHEN qty64 < 25 THEN 18446744073709551616 ELSE 0 END) AS HUGEINT) > 10 AS gt, "
    "CAST(CAST((qty64 - 25 + CASE WHEN qty64 < 25 THEN 18446744073709551616 ELSE 0 END) AS HUGEINT) // 3 AS DECIMAL(20,0)) AS q, "
    "CAST(CAST((qty64 - 25 + CASE WHEN qty64 < 25 THEN 18446744073709551616 ELSE 0 END) AS HUGEINT) % 7 AS DECIMAL(20,0)) AS r, "
    "CAST((qty64 - 25 + CASE WHEN qty64 < 25 THEN 18446744073709551616 ELSE 0 END) AS DECIMAL(20,0)) AS v, "
    "CAST(qty - 25 + CASE WHEN qty < 25 THEN 4294967296 ELSE 0 END AS DECIMAL(20,0)) AS b, CAST(qty16 + 300 AS INT) AS w",
)

# Floats.
register(
    "float_round",
    {"e": (c("fh") * 2.0).round_(), "d": c("fh").floor(), "u": c("fh").ceil(), "t": call("negate", c("fh")).round2zero(), "r": (c("fq") * c("fq")).sqrt()},
    "ROUND_EVEN(fh * 2, 0) AS e, FLOOR(fh) AS d, CEIL(fh) AS u, TRUNC(-fh) AS t, SQRT(fq * fq) AS r",
)
register(
    "float_class",
    {"n": c("fh").isnan(), "i": c("fh").isinf(), "f": c("fh").isfinite(), "m": (c("fl") - 3.0).isnormal(), "z": call("fpclass", c("fl") - 3.0, flags=["zero"])},
    "isnan(fh) AS n, isinf(fh) AS i, isfinite(fh) AS f, fl <> 3 AS m, fl = 3 AS z",
)
register("float_div_ieee", {"v": c("fp") / c("fl"), "inf": (c("fp") / (c("fl") - c("fl"))).isinf()}, "fp / fl AS v, true AS inf")

# Checked arithmetic: the flag of a program whose operation overflows on some rows, and of one that does not.
register("checked_add_flag", {"v": call("add_checked", c("price32"), lit(2_147_483_000, I32))}, "BOOL_OR(CAST(price32 AS BIGINT) + 2147483000 > 2147483647) AS failed", "flag")
register("checked_mul_flag", {"v": call("mul_checked", c("qty"), c("line"))}, "BOOL_OR(CAST(qty AS BIGINT) * line > 2147483647) AS failed", "flag")
register("checked_div_flag", {"v": call("div_checked", c("prt32"), c("disc"))}, "BOOL_OR(disc = 0) AS failed", "flag")


# Timestamps.
def _events(name: str, outputs: dict[str, Expr], oracle: str, shape: str = "vectors", table: str = "events") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return getattr(query(outputs).plan(spark.read.parquet(f"{sf_dir}/{table}.parquet")), shape)

    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT {oracle} FROM {table}"


PARTS = ("year", "month", "day", "hour", "minute", "second")
ts, day = col("ts", timestamp("us")), col("o_orderdate", timestamp("us"))
for _name, _col, _table in (("ts_extract_events", ts, "events"), ("ts_extract_orders", day, "orders")):
    _raw = _col.params["name"]
    _events(
        _name,
        {p: call(p, _col) for p in PARTS} | {"dow": call("day_of_week", _col)},
        ", ".join(f"CAST({p}({_raw}) AS INT) AS {p}" for p in PARTS) + f", CAST(isodow({_raw}) - 1 AS INT) AS dow",
        table=_table,
    )
mark = moment("2024-01-01T00:00:00", "us")
_events("ts_diff", {"ticks": ts - mark, "later": ts > mark}, "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS ticks, ts > TIMESTAMP '2024-01-01' AS later")
_events("ts_shift", {"next": ts + lit(3_600_000_000, I64), "last": ts - lit(1_000_000, I64)}, "ts + INTERVAL 1 HOUR AS next, ts - INTERVAL 1 SECOND AS last")
_events("ts_minmax", {"first": ts.min(), "last": ts.max()}, "MIN(ts) AS first, MAX(ts) AS last", "scalars")
_events("ts_bounds", {"held": call("min", call("max", ts, mark), ts)}, "LEAST(GREATEST(ts, TIMESTAMP '2024-01-01'), ts) AS held")


# Fragments.
def _fragment(name: str, aggregate_of, names: list[str], oracle: str, where: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir, *names)
        made = aggregate_of(*[F.col(n) for n in names])
        out = df.agg(made.alias("r"))
        return out.select("r.*") if dict(out.dtypes)["r"].startswith("struct") else out

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {oracle} FROM {derived(names)}{where}"


WIDE = "CAST(SUM({}) {} AS DECIMAL(38,0))"
_fragment("sum_add", kernels.sum_add, ["ord", "prt"], WIDE.format("ord + prt", "") + " AS r")
_fragment("sum_net", lambda p, d: kernels.sum_net(p, d.cast("bigint")), ["price", "disc"], WIDE.format("price * (10000 - disc) // 10000", "") + " AS r")
_fragment("ship_filter", lambda s, q: kernels.count_ship_filter(s - 19_970_000 + 9_000, q), ["shipped", "qty"], "COUNT(*) FILTER (WHERE shipped - 19970000 + 9000 <= 10592 AND qty < 24) AS r")
_fragment(
    "q1_multi",
    lambda p, d, t: kernels.q1_multi(p, d.cast("bigint"), t.cast("bigint")),
    ["price", "disc", "tax"],
    f"{WIDE.format('price * (10000 - disc) // 10000', '')} AS sum_net, {WIDE.format('CAST(price AS HUGEINT) * (10000 - disc) * (10000 + tax) // 100000000', '')} AS sum_charge, COUNT(*) AS row_count",
)
_fragment(
    "q19_mask",
    lambda line, prt, qty, price, disc: kernels.q19(line * 11 + 1, prt % 12 + 1, qty, prt % 20 + 1, price, disc.cast("bigint")),
    ["line", "prt", "qty", "price", "disc"],
    f"COUNT(*) AS row_count, {WIDE.format('price * (10000 - disc) // 10000', '')} AS revenue",
    " WHERE (line * 11 + 1 = 12 AND prt % 12 + 1 BETWEEN 1 AND 4 AND qty BETWEEN 1 AND 11 AND prt % 20 + 1 BETWEEN 1 AND 5) "
    "OR (line * 11 + 1 = 23 AND prt % 12 + 1 BETWEEN 5 AND 8 AND qty BETWEEN 10 AND 20 AND prt % 20 + 1 BETWEEN 1 AND 10) "
    "OR (line * 11 + 1 = 34 AND prt % 12 + 1 BETWEEN 9 AND 12 AND qty BETWEEN 20 AND 30 AND prt % 20 + 1 BETWEEN 1 AND 15)",
)
_NET = "COALESCE(qn, 0) * CAST(NULLIF(pn, 0) AS BIGINT) * (10000 - COALESCE(dn, 0)) // 10000"
_fragment(
    "nullable_revenue",
    lambda q, p, d, w: kernels.nullable_revenue(q.cast("bigint"), p.cast("bigint"), d.cast("bigint"), w),
    ["qn", "pn", "dn", "delay"],
    f"{WIDE.format(_NET, 'FILTER (WHERE COALESCE(qn, 0) > 0)')} AS sum_valid_net, {WIDE.format(_NET, 'FILTER (WHERE COALESCE(qn, 0) > 0 AND delay > 30)')} AS sum_delay_net, "
    "COUNT(*) FILTER (WHERE NULLIF(pn, 0) IS NOT NULL AND COALESCE(qn, 0) > 0) AS count_valid",
)
def _sales(wide: bool, nullable: bool, constant: bool, coding: str) -> None:
    """One cell of the sales factorial: layout, nulls in the price, a constant discount, and how categories are coded."""
    q, p = "qty64" if wide else "qty16", "pn" if nullable else "price"
    columns = [q, p, "disc", "flag8", "status8"]
    coded = {"plain": lambda x: x, "gather": kernels.dict_gather, "spec": kernels.dict_spec}[coding]

    def made(quantity, price, discount, flag, status):
        return kernels.sales(quantity, price, F.lit(500) if constant else discount, coded(flag), coded(status))

    value = f"CAST({q} AS BIGINT) * {p} * (10000 - {'500' if constant else 'disc'}) // 10000"
    moved = f"CASE WHEN flag8 = 1 THEN -({value}) ELSE {value} END"
    _fragment(
        f"sales_{'wide' if wide else 'narrow'}_{'null' if nullable else 'nn'}_{'const' if constant else 'col'}_{coding}",
        made,
        columns,
        f"{WIDE.format(moved, '')} AS sum_revenue, {WIDE.format(moved, 'FILTER (WHERE status8 = 2)')} AS channel2_revenue, COUNT(*) FILTER (WHERE {q} >= 10) AS bulk_count",
    )


for _cell in itertools.product((True, False), (False, True), (False, True), ("plain", "gather", "spec")):
    _sales(*_cell)

# Workloads.
margin = charged - c("ord")
MARGIN = f"({CHARGED}) - ord"
adjusted = c("price") * c("qty").cast(I64) * (scale - disc64) / scale - c("prt")
ADJUSTED = "(price * qty * (10000 - disc) // 10000 - prt)"
register(
    "w_bounded_score",
    {"held": call("min", call("max", adjusted, lit(100_000, I64)), lit(9_000_000, I64)), "off": abs(adjusted - c("ord"))},
    f"LEAST(GREATEST({ADJUSTED}, 100000), 9000000) AS held, ABS({ADJUSTED} - ord) AS off",
)
cheap = (c("shipped") >= 19940101) & (c("shipped") <= 19961231) & (c("disc") >= 500) & (c("disc") <= 700) & (c("qty") < 24) & (margin > lit(5_000, I64))
CHEAP = f"shipped >= 19940101 AND shipped <= 19961231 AND disc >= 500 AND disc <= 700 AND qty < 24 AND {MARGIN} > 5000"
register("q6_revenue", {"revenue": revenue.sum(cheap)}, f"CAST(SUM({REVENUE}) FILTER (WHERE {CHEAP}) AS BIGINT) AS revenue", "scalars")
register(
    "w_conditional_pricing",
    {"moved": (c("qty") >= 25).ifelse(margin * 110 / 100, margin * 90 / 100), "above": call("max", margin, 0), "capped": call("min", charged, c("price")), "size": abs(margin)},
    f"CASE WHEN qty >= 25 THEN ({MARGIN}) * 110 // 100 ELSE ({MARGIN}) * 90 // 100 END AS moved, GREATEST({MARGIN}, 0) AS above, LEAST({CHARGED}, price) AS capped, ABS({MARGIN}) AS size",
)
low_end, high_end = call("min", c("ord"), c("prt")), call("max", c("ord"), c("prt"))
register(
    "w_range_projection",
    {"low": low_end, "high": high_end, "span": high_end - low_end, "body": call("min", abs(c("ord") - c("prt")), c("sup"))},
    "LEAST(ord, prt) AS low, GREATEST(ord, prt) AS high, GREATEST(ord, prt) - LEAST(ord, prt) AS span, LEAST(ABS(ord - prt), sup) AS body",
)
register("w_revenue_selection", {"at": pack(index(I64), (c("disc") >= 500) & (c("qty") < 24))}, f"SELECT row, row AS at FROM {NUMBERED} WHERE ROUND(l_discount * 10000) >= 500 AND l_quantity < 24", "packed", order_by=KEY)
register(
    "w_pricing_summary",
    {"q": c("qty").cast(I64).sum(), "p": c("price").sum(), "r": revenue.sum(), "s": charged.sum(), "low": charged.min(), "high": charged.max()},
    f"CAST(SUM(qty) AS BIGINT) AS q, CAST(SUM(price) AS BIGINT) AS p, CAST(SUM({REVENUE}) AS BIGINT) AS r, CAST(SUM({CHARGED}) AS BIGINT) AS s, MIN({CHARGED}) AS low, MAX({CHARGED}) AS high",
    "scalars",
)
total = c("qty").cast(I64) * c("price") * (scale - disc64) / scale * (scale + tax64) / scale
TOTAL = "(qty * price * (10000 - disc) // 10000) * (10000 + tax) // 10000"
register(
    "w_segmented_totals",
    {"late": total.sum(lately), "large": total.sum(big), "dear": total.sum(total > lit(1_000_000, I64)), "low": total.min(), "high": total.max()},
    f"CAST(SUM({TOTAL}) FILTER (WHERE delay > 30) AS BIGINT) AS late, CAST(SUM({TOTAL}) FILTER (WHERE qty >= 25) AS BIGINT) AS large, "
    f"CAST(SUM({TOTAL}) FILTER (WHERE {TOTAL} > 1000000) AS BIGINT) AS dear, MIN({TOTAL}) AS low, MAX({TOTAL}) AS high",
    "scalars",
)
dx, dy = c("qty64") - 48, c("prt") - 32
register(
    "w_moments",
    {"sx": dx.sum(), "sy": dy.sum(), "sxx": (dx * dx).sum(), "sxy": (dx * dy).sum(), "syy": (dy * dy).sum(), "low": (dx * dy).min(), "high": (dx * dy).max()},
    "CAST(SUM(qty64 - 48) AS BIGINT) AS sx, CAST(SUM(prt - 32) AS BIGINT) AS sy, CAST(SUM((qty64 - 48) * (qty64 - 48)) AS BIGINT) AS sxx, "
    "CAST(SUM((qty64 - 48) * (prt - 32)) AS BIGINT) AS sxy, CAST(SUM((prt - 32) * (prt - 32)) AS BIGINT) AS syy, MIN((qty64 - 48) * (prt - 32)) AS low, MAX((qty64 - 48) * (prt - 32)) AS high",
    "scalars",
)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by time with dense row numbers."""
    prepare(spark)
    return with_row_number(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), ["ts", "event_id"]).select("row", "event_id")


QUERIES["index_events"] = numbered
ORACLE_SQL["index_events"] = "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row, event_id FROM events"

from . import operator_queries  # noqa: E402,F401  registers the queries of the remaining operators
