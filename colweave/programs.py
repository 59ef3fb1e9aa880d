"""Acceptance programs in the expression dialect, over columns derived from lineitem.

COLUMNS are SQL expressions that Spark and DuckDB read alike. Floats are whole
numbers or binary fractions, so that sums do not depend on their order. Each
program has the DuckDB text of its row outputs, its totals, or both.
"""

from __future__ import annotations

from dataclasses import dataclass

COLUMNS = {
    "qty": "CAST(l_quantity AS INT)",
    "qty64": "CAST(l_quantity AS BIGINT)",
    "qty16": "CAST(l_quantity AS SMALLINT)",
    "line": "CAST(l_linenumber AS INT)",
    "line16": "CAST(l_linenumber AS SMALLINT)",
    "line8": "CAST(l_linenumber AS TINYINT)",
    "ord": "CAST(l_orderkey AS BIGINT)",
    "ord32": "CAST(l_orderkey AS INT)",
    "prt": "CAST(l_partkey AS BIGINT)",
    "prt32": "CAST(l_partkey AS INT)",
    "prt16": "CAST(l_partkey % 1000 AS SMALLINT)",
    "sup": "CAST(l_suppkey AS BIGINT)",
    "price": "CAST(ROUND(l_extendedprice * 100) AS BIGINT)",
    "price32": "CAST(ROUND(l_extendedprice) AS INT)",
    "disc": "CAST(ROUND(l_discount * 10000) AS INT)",
    "tax": "CAST(ROUND(l_tax * 10000) AS INT)",
    "shipped": "CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INT)",
    "delay": "CAST(l_orderkey % 60 AS INT)",
    "flag8": "CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS TINYINT)",
    "status8": "CAST(CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS TINYINT)",
    "returned": "(l_returnflag = 'R')",
    "three": "CAST(CASE WHEN l_orderkey < 4 THEN 3 ELSE 1 END AS BIGINT)",
    "two": "CAST(CASE WHEN l_orderkey < 4 THEN 2 ELSE 1 END AS BIGINT)",
    "qn": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END",
    "pn": "CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 0 ELSE CAST(ROUND(l_extendedprice) AS INT) END",
    "dn": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(ROUND(l_discount * 10000) AS INT) END",
    "late_n": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_orderkey % 60 AS INT) END",
    "fp": "CAST(ROUND(l_extendedprice) AS DOUBLE)",
    "fd": "CAST(ROUND(l_discount * 100) / 128 AS DOUBLE)",
    "ft": "CAST(ROUND(l_tax * 100) / 128 AS DOUBLE)",
    "fq": "CAST(l_quantity AS DOUBLE)",
    "fl": "CAST(l_linenumber AS DOUBLE)",
    "fs": "CAST(l_suppkey AS DOUBLE)",
    "fh": "CAST(l_linenumber / CAST(4 AS DOUBLE) AS DOUBLE)",
    "gl": "CAST(l_linenumber AS FLOAT)",
    "gq": "CAST(l_quantity AS FLOAT)",
    "f15": "CAST(1.5 AS DOUBLE)",
}


@dataclass(frozen=True)
class Sample:
    text: str
    rows: str = ""
    totals: str = ""


#: An order's value with gaps filled, and whether it has a price; the programs on nulls share them.
VALUE = "(CAST(COALESCE(qn, 1) AS BIGINT) * NULLIF(pn, 0) - COALESCE(dn, 250))"
ORDER = """INPUT lineitem (qn i32?, pn i32?, dn i32?, delay i32)
WITH units = coalesce(qn, 1), each = nullif(pn, 0), off = coalesce(dn, 250), value = i64(units) * i64(each) - i64(off), priced = each IS NOT NULL
SELECT """

SAMPLES: dict[str, Sample] = {
    # Whole numbers.
    "pallet_load": Sample("INPUT (qty i32, line i32); SELECT qty * 12 - line AS load, sum(qty - line) AS spare;", "qty * 12 - line AS load", "CAST(SUM(qty - line) AS INT) AS spare"),
    "shipping_class": Sample(
        "INPUT (qty i32, delay i32) WITH heavy = qty >= 40, slow = delay >= 45 SELECT ifelse(heavy, ifelse(slow, i8(3), i8(2)), i8(0)) AS class, heavy OR slow AS watched",
        "CAST(CASE WHEN qty >= 40 THEN CASE WHEN delay >= 45 THEN 3 ELSE 2 END ELSE 0 END AS TINYINT) AS class, (qty >= 40 OR delay >= 45) AS watched",
    ),
    "symbol_words": Sample(
        "INPUT (qty i32, delay i32, disc i32) SELECT qty > 10 && delay < 30 AS both, qty < 5 || disc > 500 AS either, (qty > 45 && delay > 50) || disc <= 0 AS mixed -- words as symbols",
        "(qty > 10 AND delay < 30) AS both, (qty < 5 OR disc > 500) AS either, ((qty > 45 AND delay > 50) OR disc <= 0) AS mixed",
    ),
    "width_ladder": Sample("INPUT (line8 i8, qty16 i16, prt32 i32, ord i64) SELECT i64(line8) + i64(qty16) * i64(prt32) - ord AS rung", "CAST(line8 AS BIGINT) + CAST(qty16 AS BIGINT) * prt32 - ord AS rung"),
    "lane_limits": Sample(
        "INPUT (line8 i8, qty16 i16, price32 i32, sup i64) SELECT line8 | 64 AS tagged, least(qty16 * 3, 90) AS capped, (price32 - 12) >> 3 AS eighth, greatest(sup, -sup) AS size",
        "CAST(line8 | 64 AS TINYINT) AS tagged, CAST(LEAST(qty16 * 3, 90) AS SMALLINT) AS capped, CAST((price32 - 12) >> 3 AS INT) AS eighth, GREATEST(sup, -sup) AS size",
    ),
    "there_and_back": Sample(
        "INPUT (qty16 i16, line8 i8) WITH wide = i64(qty16) * 37, near = i32(wide) + i32(line8) SELECT i16(near) AS home, f64(near) AS far",
        "CAST(qty16 * 37 + line8 AS SMALLINT) AS home, CAST(qty16 * 37 + line8 AS DOUBLE) AS far",
    ),
    "clamped_part": Sample("INPUT (prt32 i32, line i32) SELECT greatest(least(prt32, 400), line * 20) AS held", "GREATEST(LEAST(prt32, 400), line * 20) AS held"),
    "narrow_bounds": Sample("INPUT (qty16 i16, prt16 i16) SELECT greatest(least(qty16 * 5, 120), prt16 >> 4) AS between", "CAST(GREATEST(LEAST(qty16 * 5, 120), prt16 >> 4) AS SMALLINT) AS between"),
    "courier_points": Sample(
        """INPUT (price i64, disc i32, line i32, delay i32)
        WITH points = i64(delay) * 3 + ifelse(disc <= 0, i64(250), i64(40)) - ifelse(line > 4, price / 8000, price / 9000)
        SELECT points AS points, count_if(points < 0) AS owing""",
        "CAST(delay * 3 + CASE WHEN disc <= 0 THEN 250 ELSE 40 END - CASE WHEN line > 4 THEN price // 8000 ELSE price // 9000 END AS BIGINT) AS points",
        "COUNT(*) FILTER (WHERE delay * 3 + CASE WHEN disc <= 0 THEN 250 ELSE 40 END - CASE WHEN line > 4 THEN price // 8000 ELSE price // 9000 END < 0) AS owing",
    ),
    "invoice_pack": Sample(
        """INPUT (qty i32, price i64, disc i32, tax i32)
        WITH listed = price * i64(qty), kept = listed - listed * i64(disc) / 10000, due = kept + kept * i64(tax) / 10000
        SELECT due AS due, sum(due) FILTER (WHERE disc >= 500) AS reduced, min(kept) AS least_kept, max(due) AS most_due""",
        f"{(DUE := '((price * qty - price * qty * disc // 10000) + (price * qty - price * qty * disc // 10000) * tax // 10000)')} AS due",
        f"CAST(SUM({DUE}) FILTER (WHERE disc >= 500) AS BIGINT) AS reduced, MIN(price * qty - price * qty * disc // 10000) AS least_kept, MAX({DUE}) AS most_due",
    ),
    # Totals.
    "ledger_totals": Sample(
        "INPUT (price i64, two i64, returned i1) SELECT count_if(returned) AS n, product(two) AS power, max(price) AS high, sum(price) FILTER (WHERE returned) AS back",
        "",
        "COUNT(*) FILTER (WHERE returned) AS n, CAST(PRODUCT(two) AS BIGINT) AS power, MAX(price) AS high, CAST(SUM(price) FILTER (WHERE returned) AS BIGINT) AS back",
    ),
    "scaled_extremes": Sample(
        "INPUT (ord i64) SELECT min(ord * 5 - 3) AS low, max(srl(ord, 1)) AS high, sum(ord << 3) AS total",
        "",
        "MIN(ord * 5 - 3) AS low, MAX(ord >> 1) AS high, CAST(SUM(ord * 8) AS BIGINT) AS total",
    ),
    "reused_gap": Sample(
        "INPUT (price i64, prt i64, three i64) WITH gap = price - prt * 11 SELECT gap AS gap, sum(gap) AS total, min(gap) AS low, product(three) AS power, count_if(gap > 5000000) AS wide",
        "price - prt * 11 AS gap",
        "CAST(SUM(price - prt * 11) AS BIGINT) AS total, MIN(price - prt * 11) AS low, CAST(PRODUCT(three) AS BIGINT) AS power, COUNT(*) FILTER (WHERE price - prt * 11 > 5000000) AS wide",
    ),
    "four_sums": Sample(
        "INPUT (disc i32, tax i32) SELECT sum(disc) AS whole, sum(disc - tax) AS rest, sum(disc >> 2) AS quarter, sum(tax & 96) AS masked",
        "",
        "CAST(SUM(disc) AS INT) AS whole, CAST(SUM(disc - tax) AS INT) AS rest, CAST(SUM(disc >> 2) AS INT) AS quarter, CAST(SUM(tax & 96) AS INT) AS masked",
    ),
    "filtered_extremes": Sample(
        "INPUT (price i64, ord i64, qty i32, returned i1) SELECT min(price) FILTER (WHERE returned) AS low, max(ord) FILTER (WHERE qty >= 49) AS last, product(ord) FILTER (WHERE qty > 99) AS none",
        "",
        "MIN(price) FILTER (WHERE returned) AS low, MAX(ord) FILTER (WHERE qty >= 49) AS last, CAST(1 AS BIGINT) AS none",
    ),
    # Floats.
    "net_of_rebate": Sample("INPUT (fp f64, fd f64) SELECT fp - fp * fd AS net", "fp - fp * fd AS net"),
    "taxed_outlier": Sample("INPUT (fp f64, fd f64, ft f64) WITH gross = fp + fp * ft SELECT gross >= 20000.0 OR fd > 0.05 AS outlier", "(fp + fp * ft >= 20000 OR fd > 0.05::DOUBLE) AS outlier"),
    "q6_window": Sample(
        "INPUT (fp f64, fd f64, qty i32, shipped i32) WITH wanted = shipped >= 19950301 AND shipped < 19970301 AND fd > 0.015625 AND fd <= 0.0625 AND qty <= 30 SELECT sum(fp * fd) FILTER (WHERE wanted) AS saved",
        "",
        "COALESCE(SUM(fp * fd) FILTER (WHERE shipped >= 19950301 AND shipped < 19970301 AND fd > 0.015625 AND fd <= 0.0625 AND qty <= 30), 0) AS saved",
    ),
    "q1_by_status": Sample(
        """INPUT (fq f64, fp f64, fd f64, ft f64, shipped i32, status8 i8)
        WITH done = shipped <= 19970630 AND status8 = 1, open = shipped <= 19970630 AND status8 = 2, net = fp - fp * fd, gross = net + net * ft
        SELECT sum(fq) FILTER (WHERE done) AS done_qty, sum(net) FILTER (WHERE done) AS done_net, sum(gross) FILTER (WHERE done) AS done_gross, count_if(done) AS done_n,
          sum(fq) FILTER (WHERE open) AS open_qty, sum(net) FILTER (WHERE open) AS open_net, sum(gross) FILTER (WHERE open) AS open_gross, count_if(open) AS open_n""",
        "",
        ", ".join(
            f"COALESCE(SUM({x}) FILTER (WHERE shipped <= 19970630 AND status8 = {k}), 0) AS {n}_{m}"
            for k, n in ((1, "done"), (2, "open"))
            for m, x in (("qty", "fq"), ("net", "fp - fp * fd"), ("gross", "fp - fp * fd + (fp - fp * fd) * ft"))
        )
        + ", COUNT(*) FILTER (WHERE shipped <= 19970630 AND status8 = 1) AS done_n, COUNT(*) FILTER (WHERE shipped <= 19970630 AND status8 = 2) AS open_n",
    ),
    "dot_products": Sample("INPUT (fl f64, fs f64) SELECT sum(fl * fs) AS both, sum(fs * fs) AS own", "", "SUM(fl * fs) AS both, SUM(fs * fs) AS own"),
    "line_fit_f32": Sample(
        "INPUT (gl f32, gq f32) SELECT sum(gl) AS sx, sum(gq) AS sy, sum(gl * gq) AS sxy, sum(gl * gl) AS sxx",
        "",
        ", ".join(f"CAST(SUM(CAST({x} AS DOUBLE)) AS FLOAT) AS {n}" for n, x in (("sx", "gl"), ("sy", "gq"), ("sxy", "gl * gq"), ("sxx", "gl * gl"))),
    ),
    "spread_f64": Sample(
        "INPUT (fs f64, returned bool) SELECT sum(fs) FILTER (WHERE returned) AS s, sum(fs * fs) FILTER (WHERE returned) AS ss, min(fs) FILTER (WHERE returned) AS low, count_if(returned) AS n",
        "",
        "SUM(fs) FILTER (WHERE returned) AS s, SUM(fs * fs) FILTER (WHERE returned) AS ss, MIN(fs) FILTER (WHERE returned) AS low, COUNT(*) FILTER (WHERE returned) AS n",
    ),
    "cross_moments": Sample("INPUT (fs f64, fq f64) SELECT sum(fs) AS a, sum(fq) AS b, sum(fs * fq) AS ab, max(fs * fq) AS most", "", "SUM(fs) AS a, SUM(fq) AS b, SUM(fs * fq) AS ab, MAX(fs * fq) AS most"),
    "box_diagonal": Sample(
        "INPUT (fq f64, fl f64) WITH square = fq * fq + fl * fl SELECT sqrt(square) AS diagonal, max(sqrt(square)) AS longest, sum(square) AS total",
        "SQRT(fq * fq + fl * fl) AS diagonal",
        "MAX(SQRT(fq * fq + fl * fl)) AS longest, SUM(fq * fq + fl * fl) AS total",
    ),
    "second_difference": Sample(
        "INPUT (fl f64, fq f64, fs f64) WITH bend = fl - 2.0 * fq + fs SELECT bend AS bend, sum(bend * bend) AS energy, max(abs(bend)) AS worst",
        "fl - 2.0::DOUBLE * fq + fs AS bend",
        "SUM((fl - 2.0::DOUBLE * fq + fs) * (fl - 2.0::DOUBLE * fq + fs)) AS energy, MAX(ABS(fl - 2.0::DOUBLE * fq + fs)) AS worst",
    ),
    "damped_step": Sample(
        "INPUT (fq f64, fh f64, fl f64, fs f64) WITH speed = fq - fh * fl, place = fs + fh * speed SELECT speed AS speed, place AS place, sum(speed * place) AS work",
        "fq - fh * fl AS speed, fs + fh * (fq - fh * fl) AS place",
        "SUM((fq - fh * fl) * (fs + fh * (fq - fh * fl))) AS work",
    ),
    "horner_cubic": Sample(
        "INPUT (fl f64) WITH y = ((fl * 0.5 + 2.0) * fl - 3.0) * fl + 1.0 SELECT y AS y, sum(y) AS total, min(y) AS low",
        f"{(CUBIC := '((fl * 0.5::DOUBLE + 2.0::DOUBLE) * fl - 3.0::DOUBLE) * fl + 1.0::DOUBLE')} AS y",
        f"SUM({CUBIC}) AS total, MIN({CUBIC}) AS low",
    ),
    "halved_flow": Sample(
        "INPUT (fp f64, f15 f64, fl f64, fq f64) WITH half = fp / (f15 + 0.5), flow = half * fl - fq SELECT half AS half, -flow AS back, sum(flow) AS total",
        "fp / (f15 + 0.5::DOUBLE) AS half, -(fp / (f15 + 0.5::DOUBLE) * fl - fq) AS back",
        "SUM(fp / (f15 + 0.5::DOUBLE) * fl - fq) AS total",
    ),
    # Nulls.
    "null_blend": Sample(
        "INPUT (qn i32?, pn i32?, dn i32?) SELECT qn * 2 - pn AS blend, coalesce(dn, qn, -1) AS known, dn IS NULL AS unknown, pn IS NOT NULL AS priced",
        "qn * 2 - pn AS blend, COALESCE(dn, qn, -1) AS known, dn IS NULL AS unknown, pn IS NOT NULL AS priced",
    ),
    "null_totals": Sample("INPUT (dn i32?) SELECT sum(dn) AS total, count_if(dn >= 400) AS steep", "", "CAST(SUM(dn) AS INT) AS total, COUNT(*) FILTER (WHERE dn >= 400) AS steep"),
    "null_order_value": Sample(
        ORDER + "value AS value, priced AS priced, sum(value) FILTER (WHERE priced) AS total, sum(value) FILTER (WHERE priced AND delay < 20) AS quick",
        f"{VALUE} AS value, NULLIF(pn, 0) IS NOT NULL AS priced",
        f"CAST(SUM({VALUE}) AS BIGINT) AS total, CAST(SUM({VALUE}) FILTER (WHERE delay < 20) AS BIGINT) AS quick",
    ),
    "null_shares": Sample(
        ORDER + "sum(value) FILTER (WHERE priced AND units > 30) AS large, sum(value) FILTER (WHERE priced AND off < 300) AS little_off, count_if(priced AND delay >= 50) AS late",
        "",
        f"CAST(SUM({VALUE}) FILTER (WHERE COALESCE(qn, 1) > 30) AS BIGINT) AS large, CAST(SUM({VALUE}) FILTER (WHERE COALESCE(dn, 250) < 300) AS BIGINT) AS little_off, "
        "COUNT(*) FILTER (WHERE NULLIF(pn, 0) IS NOT NULL AND delay >= 50) AS late",
    ),
    "null_choices": Sample(
        ORDER + "ifelse(priced AND units > 30, coalesce(value, i64(0)), i64(-1)) AS large, ifelse(priced AND delay >= 50, i64(off), i64(0)) AS late_off",
        f"CASE WHEN NULLIF(pn, 0) IS NOT NULL AND COALESCE(qn, 1) > 30 THEN {VALUE} ELSE -1 END AS large, "
        "CAST(CASE WHEN NULLIF(pn, 0) IS NOT NULL AND delay >= 50 THEN COALESCE(dn, 250) ELSE 0 END AS BIGINT) AS late_off",
    ),
    # Bits.
    "nibble_weave": Sample("INPUT (prt16 i16, qty16 i16, line16 i16) SELECT ((prt16 & 15) << 4) | ((qty16 & 15) # line16) AS woven", "CAST(((prt16 & 15) * 16) | xor(qty16 & 15, line16) AS SMALLINT) AS woven"),
    "bit_census": Sample(
        "INPUT (qty i32, prt32 i32, ord32 i32) SELECT popcnt(ord32) * 2 + lzcnt(prt32) - popcnt(qty) AS census",
        "CAST(bit_count(ord32) * 2 + CASE WHEN prt32 = 0 THEN 32 ELSE 32 - length(bin(prt32)) END - bit_count(qty) AS INT) AS census",
    ),
    "fold_slot": Sample(
        "INPUT (ord32 i32, prt32 i32) WITH h = i64(ord32) * 40503 + i64(prt32), g = h # (h >> 7) SELECT i32(g & 1023) AS slot",
        "CAST(xor(CAST(ord32 AS BIGINT) * 40503 + prt32, (CAST(ord32 AS BIGINT) * 40503 + prt32) >> 7) & 1023 AS INT) AS slot",
    ),
    "gray_code": Sample(
        "INPUT (prt32 i32, line i32) WITH gray = prt32 # (prt32 >> 1) SELECT gray AS gray, gray & ~line AS cleared", "xor(prt32, prt32 >> 1) AS gray, xor(prt32, prt32 >> 1) & ~line AS cleared"
    ),
    "byte_lanes": Sample(
        "INPUT (price32 i32) WITH lo = price32 & 255, mid = srl(price32, 8) & 255 SELECT (lo << 8) | mid AS swapped, lo # mid AS differs, lo & mid AS shared, lo + mid AS total",
        "CAST(((price32 & 255) * 256) | ((price32 >> 8) & 255) AS INT) AS swapped, CAST(xor(price32 & 255, (price32 >> 8) & 255) AS INT) AS differs, "
        "CAST((price32 & 255) & ((price32 >> 8) & 255) AS INT) AS shared, CAST((price32 & 255) + ((price32 >> 8) & 255) AS INT) AS total",
    ),
    # What several outputs share.
    "reused_area": Sample(
        "INPUT (qty i32, prt32 i32, line i32) WITH area = qty * prt32 SELECT area - line AS inner, area + line * 2 AS outer, area / 3 AS third",
        "qty * prt32 - line AS inner, qty * prt32 + line * 2 AS outer, qty * prt32 // 3 AS third",
    ),
    "wide_dag": Sample(
        "INPUT (ord i64, prt i64, sup i64) WITH p = ord - sup, q = prt * 2 + sup, r = p * q SELECT r AS r, r + p AS rp, q - r AS qr, r * 3 AS r3",
        "(ord - sup) * (prt * 2 + sup) AS r, (ord - sup) * (prt * 2 + sup) + ord - sup AS rp, prt * 2 + sup - (ord - sup) * (prt * 2 + sup) AS qr, (ord - sup) * (prt * 2 + sup) * 3 AS r3",
    ),
    "operand_orders": Sample(
        """INPUT (qty i32, line i32) SELECT line * qty AS m1, qty * line AS m2, (line - 2) + qty AS s1, line + (qty - 2) AS s2, greatest(line, qty) AS g1, greatest(qty, line) AS g2,
        qty & line AS b1, line & qty AS b2""",
        "line * qty AS m1, qty * line AS m2, line - 2 + qty AS s1, line + qty - 2 AS s2, GREATEST(line, qty) AS g1, GREATEST(qty, line) AS g2, qty & line AS b1, line & qty AS b2",
    ),
    "three_layers": Sample(
        "INPUT (disc i32, tax i32) WITH s = disc + tax, t = disc - tax, u = s * t SELECT u AS u, u + s AS us, least(t, s) AS low, (s # t) & 255 AS mixed, greatest(u, -100) AS floor",
        "(disc + tax) * (disc - tax) AS u, (disc + tax) * (disc - tax) + disc + tax AS us, LEAST(disc - tax, disc + tax) AS low, xor(disc + tax, disc - tax) & 255 AS mixed, "
        "GREATEST((disc + tax) * (disc - tax), -100) AS floor",
    ),
}
