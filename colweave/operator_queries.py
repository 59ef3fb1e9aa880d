"""Queries for the operators that the programs and workloads do not reach, each with the same query for DuckDB.

Inputs that are arrays in the driver (NumPy, Arrow) are made from nation, a table of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import literal as moment
from .operators.ordering import append_indices
from .plans.expr import Expr, aggregate, call, col, gather, index, lit, pack, scatter
from .plans.program import Lookup, SafetyCheckFailed, Target, prepare, query
from .plans.serial import from_json, to_json
from .plans.sql import LowerError, ParseError, parse
from .queries import COLUMNS, KEY, NUMBERED, ORACLE_SQL, QUERIES, c, columns_of, derived, lineitem, register, schema
from .session import Session
from .sources import columns as sources
from .types import F32, F64, I8, I16, I32, I64, U32, timestamp

low, high = c("qty") - 25, c("line")
RAISED = "(qty - 25 + CASE WHEN qty < 25 THEN 4294967296 ELSE 0 END)"
SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}

# Comparison and logic by other names.
register("cmp_unsigned", {k: call("u" + k, low, high) for k in SIGNS}, ", ".join(f"{RAISED} {s} line AS {k}" for k, s in SIGNS.items()))
register(
    "cmp_generic",
    {f"s_{k}": call("cmp", low, high, kind=k) for k in SIGNS} | {f"u_{k}": call("cmp", low, high, kind=k, unsigned=True) for k in SIGNS},
    ", ".join(f"qty - 25 {s} line AS s_{k}, {RAISED} {s} line AS u_{k}" for k, s in SIGNS.items()),
)
big, late = c("qty") >= 25, c("delay") > 30
register(
    "logic_by_type",
    {"pa": call("and", big, late), "po": call("or", big, late), "px": call("xor", big, late), "pan": call("andnot", big, late), "pn": call("not", big),
     "ba": call("and", c("qty"), c("delay")), "bo": call("or", c("qty"), c("delay")), "bx": call("xor", c("qty"), c("delay")), "ban": call("andnot", c("qty"), c("delay")), "bn": call("not", c("qty"))},
    "qty >= 25 AND delay > 30 AS pa, qty >= 25 OR delay > 30 AS po, (qty >= 25) <> (delay > 30) AS px, NOT qty >= 25 AND delay > 30 AS pan, NOT qty >= 25 AS pn, "
    "qty & delay AS ba, qty | delay AS bo, xor(qty, delay) AS bx, ~qty & delay AS ban, ~qty AS bn",
)

# Arithmetic.
register(
    "mul_low_halves",
    {"se": call("mul64se", c("price") * 1000, c("ord") - 50), "ze": call("mul64ze", c("price") * 1000, c("ord"))},
    "((price * 1000 + 2147483648) % 4294967296 - 2147483648) * (ord - 50) AS se, (price * 1000 % 4294967296) * ord AS ze",
)
register(
    "div_null_on_invalid",
    {f"{k}": call(k, c("prt32"), c("disc"), null_on_invalid_division=True) for k in ("div", "mod", "udiv", "umod")} | {"dn": call("div", c("pn"), c("dn"), null_on_invalid_division=True), "mn": call("mod", c("pn"), c("dn"), null_on_invalid_division=True)},
    "CASE WHEN disc <> 0 THEN prt32 // disc END AS div, CASE WHEN disc <> 0 THEN prt32 % disc END AS mod, CASE WHEN disc <> 0 THEN prt32 // disc END AS udiv, "
    "CASE WHEN disc <> 0 THEN prt32 % disc END AS umod, CASE WHEN dn <> 0 THEN pn // dn END AS dn, CASE WHEN dn <> 0 THEN pn % dn END AS mn",
)
register(
    "extremes_unsigned",
    {"low": call("umin", low, high), "high": call("umax", low, high), "ul": call("uleast", low, high, c("delay")), "ug": call("ugreatest", low, high, c("delay"))},
    "CASE WHEN qty < 25 THEN line ELSE LEAST(qty - 25, line) END AS low, CASE WHEN qty < 25 THEN qty - 25 ELSE GREATEST(qty - 25, line) END AS high, "
    "CASE WHEN qty < 25 THEN LEAST(line, delay) ELSE LEAST(qty - 25, line, delay) END AS ul, CASE WHEN qty < 25 THEN qty - 25 ELSE GREATEST(qty - 25, line, delay) END AS ug",
)
register("float_reciprocals", {"r": c("fq").rcp(), "rs": c("fq").rsqrt()}, "1.0::DOUBLE / fq AS r, 1.0::DOUBLE / SQRT(fq) AS rs")
register("copysign_without_zero", {"v": call("copysign_no_zero", c("delay"), low)}, "CASE WHEN qty < 25 THEN -delay ELSE delay END AS v")
register(
    "product_wraps",
    {"p": c("qty").product(c("ord") < 40), "q": (c("line") * 2 + 1).product(c("ord") < 3)},
    f"""SELECT CAST(p AS INT) AS p, CAST(q AS INT) AS q FROM (SELECT
        list_reduce(list_prepend(CAST(1 AS HUGEINT), list(CAST(qty AS HUGEINT)) FILTER (WHERE ord < 40)), lambda a, b: (a * b + 2147483648) % 4294967296 - 2147483648
          + CASE WHEN (a * b + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END) AS p,
        list_reduce(list_prepend(CAST(1 AS HUGEINT), list(CAST(line * 2 + 1 AS HUGEINT)) FILTER (WHERE ord < 3)), lambda a, b: (a * b + 2147483648) % 4294967296 - 2147483648
          + CASE WHEN (a * b + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END) AS q FROM {derived(["qty", "ord", "line"])})""",
    "scalars",
)

# Checked operations: their values where nothing fails, and their flags.
register(
    "checked_values",
    {"a": call("add_checked", c("qty"), c("line")), "s": call("sub_checked", low, high), "m": call("mul_checked", c("qty"), c("line")), "d": call("div_checked", c("prt32"), c("line")),
     "r": call("mod_checked", c("prt32"), c("line")), "ud": call("udiv_checked", c("prt32"), c("line")), "um": call("umod_checked", c("prt32"), c("line")), "l": call("sll_checked", c("qty"), c("line")),
     "u": call("srl_checked", c("qty"), c("line")), "h": call("sra_checked", low, high), "rl": call("rotl_checked", c("qty"), c("line")), "n": call("negate_checked", c("qty")),
     "ab": call("abs_checked", low), "t": call("trunc_checked", c("qty64"), to=I8)},
    "qty + line AS a, qty - 25 - line AS s, qty * line AS m, prt32 // line AS d, prt32 % line AS r, prt32 // line AS ud, prt32 % line AS um, CAST(qty * (1 << line) AS INT) AS l, qty >> line AS u, "
    "CAST(floor((qty - 25) / CAST(1 << line AS DOUBLE)) AS INT) AS h, CAST(qty * (1 << line) AS INT) AS rl, -qty AS n, ABS(qty - 25) AS ab, CAST(qty64 AS TINYINT) AS t",
)

LEAST32 = lit(-(1 << 31), I32)
mostly = (c("qty") > 3).ifelse(c("qty"), LEAST32)
FLAGS: dict[str, tuple[Expr, str]] = {
    "sub": (call("sub_checked", low * 50_000_000, lit(1_000_000_000, I32)), "(qty - 25) * 50000000::BIGINT - 1000000000 < -2147483648"),
    "sub_fits": (call("sub_checked", low, high), "false"),
    "udiv": (call("udiv_checked", c("prt32"), c("disc")), "disc = 0"),
    "mod": (call("mod_checked", c("prt32"), c("disc")), "disc = 0"),
    "umod": (call("umod_checked", c("prt32"), c("line")), "line = 0"),
    "div_least": (call("div_checked", mostly, lit(-1, I32)), "qty <= 3"),
    "sll": (call("sll_checked", c("line"), c("qty")), "qty > 31"),
    "srl": (call("srl_checked", c("line"), c("line")), "line > 31"),
    "sra": (call("sra_checked", c("line"), low), "qty < 25"),
    "rotl": (call("rotl_checked", c("line"), c("qty")), "qty > 31"),
    "rotr": (call("rotr_checked", c("line"), c("line")), "line > 31"),
    "negate": (call("negate_checked", mostly), "qty <= 3"),
    "abs": (call("abs_checked", mostly), "qty <= 3"),
    "abs_fits": (call("abs_checked", low), "false"),
    "trunc": (call("trunc_checked", c("price"), to=I16), "price > 32767"),
    "trunc_fits": (call("trunc_checked", c("qty64"), to=I8), "qty64 > 127"),
    "masked": (call("checked_op", c("prt32"), c("disc"), c("disc") > 0, name="div"), "disc = 0 AND disc > 0"),
    "masked_fails": (call("checked_op", c("prt32"), c("disc"), c("qty") > 3, name="mod"), "disc = 0 AND qty > 3"),
    "int_cast": (call("int_cast", c("price"), to=I16, kind="trunc", checked=True), "price > 32767"),
    "null_add": (call("add_checked", c("qn") * 40_000_000, lit(1_000_000_000, I32)), "qn * 40000000::BIGINT + 1000000000 > 2147483647"),
    "null_rows": (call("add_checked", c("qn").is_null().ifelse(c("qn"), lit(1, I32)), lit(2_147_483_646, I32)), "false"),
}


def _flag(e: Expr, spark: SparkSession, sf_dir: str):
    names = columns_of({"v": e})
    program = query(v=e)
    program.schema = schema(names)
    return program, lineitem(spark, sf_dir, *names)


def checked_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (e, _) in FLAGS.items():
        program, df = _flag(e, spark, sf_dir)
        row = program.plan(df).flag.select(F.lit(name).alias("op"), "failed")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES["checked_flags"] = checked_flags
_named = [n for n in COLUMNS if n in ("qty", "qty64", "line", "prt32", "disc", "price", "qn")]
ORACLE_SQL["checked_flags"] = " UNION ALL ".join(f"SELECT '{n}' AS op, COALESCE(BOOL_OR({when}), false) AS failed FROM {derived(_named)}" for n, (_, when) in FLAGS.items())


def checked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run of each program raises."""
    rows = []
    for name in ("sub", "sub_fits", "udiv", "masked", "masked_fails"):
        program, df = _flag(FLAGS[name][0], spark, sf_dir)
        try:
            program.run(df)
            rows.append((name, False))
        except SafetyCheckFailed:
            rows.append((name, True))
    return spark.createDataFrame(rows, "op string, raised boolean")


QUERIES["checked_run"] = checked_run
ORACLE_SQL["checked_run"] = " UNION ALL ".join(
    f"SELECT '{n}' AS op, COALESCE(BOOL_OR({FLAGS[n][1]}), false) AS raised FROM {derived(_named)}" for n in ("sub", "sub_fits", "udiv", "masked", "masked_fails")
)


def checked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a checked program: value and flag in one scan."""
    names = ["price", "qty"]
    program = query(total=call("add_checked", c("price"), c("qty").cast(I64)).sum(), most=c("price").max())
    program.schema = schema(names)
    return program.run(lineitem(spark, sf_dir, *names)).scalars


QUERIES["checked_totals"] = checked_totals
ORACLE_SQL["checked_totals"] = f"SELECT CAST(SUM(price + qty) AS BIGINT) AS total, MAX(price) AS most FROM {derived(['price', 'qty'])}"

# Casts.
near = c("qty16") - 25
register(
    "cast_by_sign",
    {"s": call("signed_cast", near, to=I32), "u": call("unsigned_cast", near, to=I32), "sf": call("signed_cast", near, to=F64), "uf": call("unsigned_cast", near, to=F64),
     "ff": call("float_cast", near, to=F64), "fu": call("float_cast", near, to=F64, is_unsigned=True), "it": call("int_cast", c("price"), to=I8, kind="trunc"),
     "is_": call("int_cast", near, to=I64, kind="sext"), "iz": call("int_cast", near, to=I64, kind="zext")},
    "CAST(qty16 - 25 AS INT) AS s, CAST((qty16 - 25) & 65535 AS INT) AS u, CAST(qty16 - 25 AS DOUBLE) AS sf, CAST((qty16 - 25) & 65535 AS DOUBLE) AS uf, CAST(qty16 - 25 AS DOUBLE) AS ff, "
    "CAST((qty16 - 25) & 65535 AS DOUBLE) AS fu, CAST(CASE WHEN price % 256 > 127 THEN price % 256 - 256 ELSE price % 256 END AS TINYINT) AS it, CAST(qty16 - 25 AS BIGINT) AS is_, "
    "CAST((qty16 - 25) & 65535 AS BIGINT) AS iz",
)
# The IEEE bits of 1 to 7.
DOUBLE_BITS = [0x3FF0, 0x4000, 0x4008, 0x4010, 0x4014, 0x4018, 0x401C]
SINGLE_BITS = [0x3F80, 0x4000, 0x4040, 0x4080, 0x40A0, 0x40C0, 0x40E0]
register(
    "bitcast",
    {"d": call("bitcast", c("fl"), to=I64), "s": call("bitcast", c("gl"), to=I32), "back": call("bitcast", call("bitcast", c("fp"), to=I64), to=F64),
     "n": call("bitcast", call("bitcast", c("qn").cast(F32), to=I32), to=F32)},
    f"CASE line {' '.join(f'WHEN {k + 1} THEN {b << 48}' for k, b in enumerate(DOUBLE_BITS))} END AS d, CAST(CASE line {' '.join(f'WHEN {k + 1} THEN {b << 16}' for k, b in enumerate(SINGLE_BITS))} END AS INT) AS s, "
    "fp AS back, CAST(qn AS FLOAT) AS n",
)
ORACLE_SQL["bitcast"] = ORACLE_SQL["bitcast"].rsplit(" FROM (SELECT", 1)[0] + f" FROM {derived(['line', 'fp', 'qn'])}"

# Lanes and bits.
register(
    "bits_permute_lanes",
    {"b64": c("price").permute_i64_i8(idxs=[1, 0, 2, 3, 4, 5, 6, 7]), "h64": c("price").permute_i64_i16(idxs=[1, 0, 2, 3]), "b32": c("price32").permute_i32_i8(idxs=[1, 0, 2, 3]),
     "h32": c("line").permute_i32_i16(idxs=[1, 0]), "b16": c("line16").permute_i16_i8(idxs=[1, 0]), "bit": call("permute", c("line8"), idxs=[1, 0, 2, 3, 4, 5, 6, 7], is_bit=True)},
    "(price & ~65535) | ((price & 255) * 256) | ((price >> 8) & 255) AS b64, (price & ~4294967295) | ((price & 65535) * 65536) | ((price >> 16) & 65535) AS h64, "
    "CAST((price32 & ~65535) | ((price32 & 255) * 256) | ((price32 >> 8) & 255) AS INT) AS b32, line * 65536 AS h32, CAST(line16 * 256 AS SMALLINT) AS b16, "
    "CAST((line8 & 4) | ((line8 & 1) * 2) | ((line8 & 2) // 2) AS TINYINT) AS bit",
)
register(
    "bits_within_bytes",
    {"p": call("permute_i8_bits", c("line8"), idxs=[2, 1, 0, 3, 4, 5, 6, 7]), "r": call("reverse_bits_i8", c("line8")), "f": call("reverse_bits_full", c("line16")), "i": call("replicate_ith_bit_i8", c("line8"), bit=1)},
    "CAST((line8 & 1) * 4 + (line8 & 2) + (line8 & 4) // 4 AS TINYINT) AS p, CAST((line8 & 1) * -128 + (line8 & 2) * 32 + (line8 & 4) * 8 AS TINYINT) AS r, "
    "CAST((line16 & 1) * -32768 + (line16 & 2) * 8192 + (line16 & 4) * 2048 AS SMALLINT) AS f, CAST(CASE WHEN line8 & 2 <> 0 THEN -1 ELSE 0 END AS TINYINT) AS i",
)
ORACLE_SQL["bits_within_bytes"] = ORACLE_SQL["bits_within_bytes"].replace("line8 & 2 <> 0", "(line8 & 2) <> 0")

# Aggregates given by name.
register(
    "agg_by_name",
    {"s": aggregate("sum", c("price")), "lo": aggregate("min_agg", c("price"), big), "hi": aggregate("max_agg", c("price")), "o": aggregate("or_agg", c("qty")), "pa": aggregate("and_agg", big), "po": aggregate("or_agg", late)},
    "CAST(SUM(price) AS BIGINT) AS s, MIN(price) FILTER (WHERE qty >= 25) AS lo, MAX(price) AS hi, BIT_OR(qty) AS o, BOOL_AND(qty >= 25) AS pa, BOOL_OR(delay > 30) AS po",
    "scalars",
)

# Lookups and scatters with nulls and narrow indices.
register(
    "gather_nullable",
    {"v": gather(c("qn").bit_and(lit(7, I32)), "squares"), "w": gather(c("line"), "gaps")},
    "CASE WHEN qn IS NOT NULL THEN CAST([0, 1, 4, 9, 16, 25, 36, 49][(qn & 7) + 1] AS BIGINT) END AS v, CAST([10, NULL, 30, NULL, 50, NULL, 70, NULL][line + 1] AS INT) AS w",
    tables={"squares": Lookup([k * k for k in range(8)], I64), "gaps": Lookup([None if k % 2 else (k + 1) * 10 for k in range(8)], I32)},
)
register(
    "gather_narrow",
    {"v": gather(c("line8") - 4, "places"), "w": gather(c("line16") - 4, "wide")},
    "CAST(CASE WHEN line8 < 4 THEN 2000 + 252 + line8 ELSE 2000 + line8 - 4 END AS BIGINT) AS v, CASE WHEN line16 < 4 THEN (65532 + line16) * 3 ELSE (line16 - 4) * 3 END AS w",
    tables={
        "places": Lookup([2000 + k for k in range(256)], I64),
        "wide": lambda spark, sf: spark.range(1 << 16).select("id", (F.col("id") * 3).alias("v")).unionByName(spark.range(3).select("id", (F.col("id") * 3 + 9).alias("v"))),
    },
)
register(
    "scatter_nullable",
    {"last": scatter(c("qn"), c("line"))},
    f"SELECT i AS idx, CASE WHEN k IS NULL THEN -1 ELSE last END AS last FROM range(10) r(i) LEFT JOIN (SELECT l_linenumber AS k, {COLUMNS['qn']} AS last FROM {NUMBERED} "
    "QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY row DESC) = 1) ON i = k",
    "scattered",
    order_by=KEY,
    tables={"last": Target(10, -1)},
)


def append_true_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection vector of the rows with one predicate, then those with another appended."""
    names = ["qty", "disc"]

    def chosen(where: Expr) -> DataFrame:
        program = query(at=pack(index(I64), where))
        program.schema = schema(names)
        return program.plan(lineitem(spark, sf_dir, *names, keys=True), order_by=KEY).packed["at"]

    return append_indices(chosen(c("qty") > 48), chosen(c("disc") <= 0))


QUERIES["append_true_indices"] = append_true_indices
ORACLE_SQL["append_true_indices"] = f"""
SELECT row_number() OVER (ORDER BY side, row) - 1 AS place, row AS at FROM (
  SELECT 0 AS side, row FROM {NUMBERED} WHERE l_quantity > 48 UNION ALL SELECT 1, row FROM {NUMBERED} WHERE ROUND(l_discount * 10000) <= 0)
"""


def grouped_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grouped outputs of a table from one groupBy."""
    names = ["price", "qty", "three", "line"]
    place = c("line") - 1
    program = query({n: Expr("grouped", (e, place), {"table": "t"}) for n, e in (("s", c("price").sum()), ("hi", c("qty").max()), ("p", c("three").product()))})
    program.schema = schema(names)
    return program.plan(lineitem(spark, sf_dir, *names)).tables["t"]


QUERIES["grouped_together"] = grouped_together
ORACLE_SQL["grouped_together"] = (
    f"SELECT CAST(line - 1 AS BIGINT) AS idx, CAST(SUM(price) AS BIGINT) AS s, MAX(qty) AS hi, CAST(PRODUCT(three) AS BIGINT) AS p FROM {derived(['price', 'qty', 'three', 'line'])} GROUP BY 1"
)


# Timestamps in all units, with nulls, and as numbers.
def _moments(name: str, outputs, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return query(outputs).plan(events.withColumn("tn", F.when(F.col("event_id") % 5 != 0, F.col("ts")))).vectors

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {oracle} FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN ts END AS tn FROM events)"


PARTS = ("year", "month", "day", "hour", "minute", "second")
null_ts = col("tn", timestamp("us"))
_moments(
    "ts_extract_nulls",
    {p: call(p, null_ts) for p in PARTS} | {"dow": call("day_of_week", null_ts)},
    ", ".join(f"CAST({p}(tn) AS INT) AS {p}" for p in PARTS) + ", CAST(isodow(tn) - 1 AS INT) AS dow",
)
_moments(
    "ts_cast",
    {u: col("ts", timestamp(u)).cast(I64) for u in ("s", "ms", "us", "ns")} | {"back": col("ts", timestamp("us")).cast(I64).cast(timestamp("us")), "hours": col("ts", timestamp("s")).cast(I64) / 3600},
    "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns, ts AS back, epoch_us(ts) // 3600000000 AS hours",
)
_moments(
    "ts_units",
    {u: call("hour", col("ts", timestamp(u))) for u in ("s", "ms", "us", "ns")} | {f"after_{u}": col("ts", timestamp(u)) > moment("2024-01-15T12:00:00", u) for u in ("s", "ms", "us", "ns")},
    ", ".join(f"CAST(hour(ts) AS INT) AS {u}" for u in ("s", "ms", "us", "ns"))
    + ", "
    + ", ".join(f"date_trunc('{d}', ts) > TIMESTAMP '2024-01-15 12:00:00' AS after_{u}" for u, d in (("s", "second"), ("ms", "millisecond"), ("us", "microsecond"), ("ns", "microsecond"))),
)


# Sources and sinks: arrays with the nulls written in every way, and back.
def _nation(spark: SparkSession, sf_dir: str) -> pa.Table:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").toArrow()


def load_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as bytes and as bits, of both polarities, and a sentinel."""
    prepare(spark)
    data = _nation(spark, sf_dir)
    key, region = (data[n].to_numpy().astype(np.int32) for n in ("n_nationkey", "n_regionkey"))
    null = key % 3 == 0
    columns = {"k": key, "a": region, "b": region, "s": np.where(null, -1, region).astype(np.int32)}
    masks = {"a": null, "b": np.packbits(null, bitorder="little")}
    df = sources.from_numpy(spark, columns, masks)
    valid = sources.from_numpy(spark, {"k": key, "va": region, "vb": region}, {"va": ~null, "vb": np.packbits(~null, bitorder="little")}, true_means_null=False)
    df = df.join(valid, "k").withColumn("s", sources.with_sentinel(F.col("s"), -1)).withColumn("m", sources.with_mask(F.col("k"), F.col("k") % 3 == 0))
    bits = F.lit(np.packbits(null, bitorder="little").tobytes())
    df = df.withColumn("bits", sources.with_bitmap(F.col("k"), bits, F.col("k"), true_means_null=True))
    return query({"k": col("k")} | {n: col(n) * 2 for n in ("a", "b", "va", "vb", "s", "m", "bits")}).plan(df).vectors


_null_region = "CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey * 2 END"
_null_key = "CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 2 END"
QUERIES["load_nulls"] = load_nulls
ORACLE_SQL["load_nulls"] = f"SELECT n_nationkey AS k, {', '.join(f'{_null_region} AS {n}' for n in ('a', 'b', 'va', 'vb', 's'))}, {_null_key} AS m, {_null_key} AS bits FROM nation"


def store_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nullable output as a value with a sentinel and as masks of both polarities."""
    names = ["qn", "line"]
    program = query(v=c("qn") + c("line"))
    program.schema = schema(names)
    v = F.col("v")
    return program.plan(lineitem(spark, sf_dir, *names)).vectors.select(
        sources.to_sentinel(v, -7).alias("held"), sources.to_mask(v).alias("is_null"), sources.to_mask(v, true_means_null=False).alias("is_valid")
    )


QUERIES["store_nulls"] = store_nulls
ORACLE_SQL["store_nulls"] = f"SELECT COALESCE(qn + line, -7) AS held, qn IS NULL AS is_null, qn IS NOT NULL AS is_valid FROM {derived(['qn', 'line'])}"


def arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow in, in two chunks, and out and in again; an unsigned column widens."""
    prepare(spark)
    data = _nation(spark, sf_dir)
    key = pa.chunked_array([data["n_nationkey"].combine_chunks()[:7], data["n_nationkey"].combine_chunks()[7:]])
    table = pa.table({"k": key, "u": key.cast(pa.uint8()), "r": pa.array([None if k % 4 == 0 else k for k in key.to_pylist()], pa.int64())})
    out = query(k=col("k"), u=col("u") + 200, r=col("r") - 1).plan(sources.from_arrow(spark, table)).vectors
    return sources.from_arrow(spark, sources.to_arrow(out))


QUERIES["arrow_round_trip"] = arrow_round_trip
ORACLE_SQL["arrow_round_trip"] = "SELECT n_nationkey AS k, CAST(n_nationkey + 200 AS SMALLINT) AS u, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey - 1 AS BIGINT) END AS r FROM nation"


def run_into_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs written into the caller's arrays, which become columns again."""
    prepare(spark)
    key = _nation(spark, sf_dir)["n_nationkey"].to_numpy().astype(np.int64)
    k = col("k", I64)
    result = query(twice=k * 2, total=k.sum(), s=Expr("grouped", (k.sum(), k % 3), {"table": "t"})).run(sources.from_numpy(spark, {"k": key}), tables={"t": Target(3)})
    buffers = {"total": np.zeros(1, np.int64), "s": np.zeros(3, np.int64)}
    sources.run_into(result, buffers)
    return sources.from_numpy(spark, {"s": buffers["s"], "total": np.repeat(buffers["total"], 3), "n": np.repeat(np.int64(len(sources.to_numpy(result.vectors)["twice"])), 3)})


QUERIES["run_into_buffers"] = run_into_buffers
ORACLE_SQL["run_into_buffers"] = "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS s, (SELECT CAST(SUM(n_nationkey) AS BIGINT) FROM nation) AS total, (SELECT COUNT(*) FROM nation) AS n FROM nation GROUP BY n_nationkey % 3"


# Programs as text and as data.
ERRORS = {
    "no select": "INPUT (qty i32)",
    "bad token": "INPUT (qty i32) SELECT qty ? 1",
    "open parenthesis": "INPUT (qty i32) SELECT (qty + 1",
    "unknown name": "INPUT (qty i32) SELECT size",
    "unknown function": "INPUT (qty i32) SELECT squash(qty)",
    "unknown type": "INPUT (qty text) SELECT qty",
    "repeated output": "INPUT (qty i32) SELECT qty AS a, qty + 1 AS a",
    "repeated binding": "INPUT (qty i32) WITH qty = 1 SELECT qty",
    "wrong arguments": "INPUT (qty i32) SELECT nullif(qty)",
    "filter without aggregate": "INPUT (qty i32) SELECT abs(qty) FILTER (WHERE qty > 1)",
}
PARSE = ("no select", "bad token", "open parenthesis")


def sql_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name, text in ERRORS.items():
        try:
            parse(text)
            rows.append((name, "none"))
        except (ParseError, LowerError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "text string, error string")


QUERIES["sql_errors"] = sql_errors
ORACLE_SQL["sql_errors"] = " UNION ALL ".join(f"SELECT '{n}' AS text, '{'ParseError' if n in PARSE else 'LowerError'}' AS error" for n in ERRORS)


def _program(names: list[str]):
    program = query(
        banded=case_of(c("qty")), net=c("price") * (lit(10_000, I64) - c("disc").cast(I64)) / 10_000, filled=call("coalesce", c("qn"), 0), part=call("trunc", c("price"), to=I16), raised=low.cast(U32)
    )
    program.schema = schema(names)
    return program


def case_of(x: Expr) -> Expr:
    return (x < 10).ifelse(lit(1, I32), (x < 30).ifelse(lit(2, I32), lit(3, I32)))


_SERIAL = ["qty", "price", "disc", "qn"]
QUERIES["serialised_plan"] = lambda spark, sf_dir: from_json(to_json(_program(_SERIAL))).plan(lineitem(spark, sf_dir, *_SERIAL)).vectors
ORACLE_SQL["serialised_plan"] = (
    "SELECT CASE WHEN qty < 10 THEN 1 WHEN qty < 30 THEN 2 ELSE 3 END AS banded, price * (10000 - disc) // 10000 AS net, COALESCE(qn, 0) AS filled, "
    "CAST((price + 32768) % 65536 - 32768 AS SMALLINT) AS part, "
    f"CAST({RAISED} AS BIGINT) AS raised FROM {derived(_SERIAL)}"
)


def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared program run twice, on its input and on another, and what the session counts."""
    session = Session(spark)
    text = "INPUT (qty i32, line i32) SELECT sum(qty) AS total, max(line) AS high"
    df = lineitem(spark, sf_dir, "qty", "line")
    prepared = session.prepare(text, df)
    first, second = prepared.run().scalars, prepared.run(df.where("line > 2")).scalars
    session.run(text, df)
    counts = session.statistics()
    session.release(prepared)
    left = session.statistics()["prepared"]
    session.clear()
    counted = [F.lit(v).cast("int").alias(k) for k, v in (*counts.items(), ("left_over", left), ("texts", len(session.parsed)))]
    return first.unionByName(second).select("total", "high", *counted)


QUERIES["session_runs"] = session_runs
ORACLE_SQL["session_runs"] = " UNION ALL ".join(
    f"SELECT CAST(SUM(qty) AS INT) AS total, MAX(line) AS high, 1 AS parsed, 1 AS reused, 1 AS runs, 1 AS prepared, 2 AS prepared_runs, 0 AS left_over, 0 AS texts FROM {derived(['qty', 'line'])} WHERE {w}"
    for w in ("true", "line > 2")
)


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection shows of a program: its scan reads only its columns, nothing runs in Python; the report has no data."""
    names = ["price", "disc"]
    program = query(net=c("price") * (lit(10_000, I64) - c("disc").cast(I64)) / 10_000, total=c("price").sum())
    program.schema = schema(names)
    df = lineitem(spark, sf_dir, *names)
    plan = program.inspect(df)
    report = Session(spark).bug_report(program, df)
    reads = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    facts = {
        "scans": len(reads),
        "columns": max(line.count(":") - 1 for line in reads),
        "python": sum("Python" in line or "Arrow" in line for line in plan.splitlines()),
        "report": sum(bool(v) for v in report.values()),
        "outputs": len(from_json(report["program"]).outputs),
    }
    return spark.createDataFrame(list(facts.items()), "fact string, n int")


QUERIES["inspected"] = inspected
ORACLE_SQL["inspected"] = "SELECT * FROM (VALUES ('scans', 2), ('columns', 2), ('python', 0), ('report', 6), ('outputs', 2)) t(fact, n)"

