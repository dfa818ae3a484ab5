"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions import dates as DT
from tabulith.functions import decimals as DC
from tabulith.functions import text as TX
from tabulith.queries.registry import OPS, PLACED, money_sql, query, ratio_sql
from tabulith.sources.tables import fact_by_order, placed_orders, scan

SHAPES = """t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) WHEN 1 THEN '-0.00' WHEN 2 THEN '00' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
  WHEN 3 THEN '1e5' WHEN 4 THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || '000' WHEN 5 THEN '-' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) WHEN 6 THEN CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) ELSE '.5' END AS s FROM events)"""


def shapes(spark, folder):
    """Event values as decimal texts of eight shapes, some of them not decimal."""
    k = F.col("event_id") % 8
    v = F.col("value").cast("decimal(12,2)").cast("string")
    s = (
        F.when(k == 0, v).when(k == 1, "-0.00").when(k == 2, F.concat(F.lit("00"), v)).when(k == 3, "1e5").when(k == 4, F.concat(v, F.lit("000")))
        .when(k == 5, F.concat(F.lit("-"), v)).when(k == 6, F.floor("value").cast("long").cast("string")).otherwise(".5")
    )
    return scan(spark, folder, "events").select("event_id", s.alias("s"))


@query(
    "decimal_texts",
    "F1 F2 F3 F4 F6 F12",
    f"""WITH {SHAPES}, c AS (SELECT *, regexp_matches(s, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?$') AS shape FROM t),
 n AS (SELECT *, CASE WHEN shape THEN CASE WHEN CAST(s AS DECIMAL(30,10)) = 0 THEN '0' WHEN contains(s, '.') THEN rtrim(rtrim(s, '0'), '.') ELSE s END END AS norm FROM c)
SELECT event_id, s, shape AND s <> '-0.00' AS is_decimal, shape AND norm = s AS canonical, norm AS normalized, CASE WHEN shape THEN CAST(GREATEST(1, length(ltrim(replace(replace(s, '.', ''), '-', ''), '0'))) AS INTEGER) END AS digits,
 CASE WHEN shape THEN CAST(CASE WHEN contains(s, '.') THEN length(s) - position('.' IN s) ELSE 0 END AS INTEGER) END AS scale, shape AND NOT contains(norm, '.') AS whole,
 CASE WHEN shape THEN ltrim(s, '-') END AS magnitude, shape AND CAST(s AS DECIMAL(30,10)) % 0.05 = 0 AS on_step,
 CASE WHEN shape THEN CASE WHEN contains(s, '.') THEN CASE WHEN length(s) - position('.' IN s) >= 4 THEN s ELSE s || '00' END ELSE s || '.0000' END END AS padded FROM n""".replace("CAST(s AS DECIMAL(30,10)) % 0.05", "TRY_CAST(s AS DECIMAL(30,10)) % 0.05"),
)
def decimal_texts(spark, folder):
    s = F.col("s")
    shape = DC.is_decimal_shape(s)
    t = shapes(spark, folder).withColumn("shape", shape)
    ok = lambda c: F.when(F.col("shape"), c)
    return t.select(
        "event_id", "s", DC.is_decimal(s).alias("is_decimal"), DC.is_canonical(s).alias("canonical"), ok(DC.normalize_decimal(s)).alias("normalized"),
        ok(DC.significant_digits(s)).alias("digits"), ok(DC.fraction_scale(s)).alias("scale"), DC.is_integer(s).alias("whole"),
        ok(DC.abs_decimal(s)).alias("magnitude"), DC.is_multiple_of(s, "0.05").alias("on_step"), ok(DC.format_scale(s, F.lit(4))).alias("padded"),
    )


@query(
    "decimal_order",
    "F3 F21",
    f"""WITH {SHAPES}, p AS (SELECT a.event_id, a.s AS a, b.s AS b FROM t a JOIN t b ON b.event_id = a.event_id + 3 WHERE a.event_id % 8 IN (0, 1, 4, 5, 6) AND b.event_id % 8 IN (0, 1, 4, 5, 6))
SELECT event_id, CAST(SIGN(CAST(a AS DECIMAL(30,10)) - CAST(b AS DECIMAL(30,10))) AS INTEGER) AS ordering, a <> '-0.00' AND b <> '-0.00' AND CAST(a AS DECIMAL(30,10)) = CAST(b AS DECIMAL(30,10)) AS agree FROM p""",
)
def decimal_order(spark, folder):
    t = shapes(spark, folder).filter((F.col("event_id") % 8).isin(0, 1, 4, 5, 6))
    b = t.select((F.col("event_id") - 3).alias("event_id"), F.col("s").alias("b"))
    return t.join(b, "event_id").select(
        "event_id", DC.compare_decimal(F.col("s"), F.col("b")).alias("ordering"), DC.results_agree(F.col("s"), F.col("b")).alias("agree")
    )


@query(
    "exact_arithmetic",
    "F5",
    f"""WITH {OPS}, g AS (SELECT site, CAST(SUM(revenue) AS DECIMAL(18,2)) AS r, CAST(SUM(cost) AS DECIMAL(18,2)) AS c, SUM(downtime) AS d FROM ops GROUP BY 1),
 x AS (SELECT site, CAST(r + c AS DECIMAL(30,4)) AS a, CAST(c - r AS DECIMAL(30,4)) AS s, CAST(r * 100 AS HUGEINT) * CAST(c * 100 AS HUGEINT) AS m FROM g)
SELECT site, rtrim(rtrim(CAST(a AS VARCHAR), '0'), '.') AS added, rtrim(rtrim(CAST(s AS VARCHAR), '0'), '.') AS subtracted, rtrim(rtrim(CAST(m // 10000 AS VARCHAR) || '.' || lpad(CAST(m % 10000 AS VARCHAR), 4, '0'), '0'), '.') AS multiplied FROM x""",
)
def exact_arithmetic(spark, folder):
    from tabulith.sources.tables import money_text

    g = fact_by_order(spark, folder).groupBy("site").agg(money_text(F.sum("revenue")).alias("r"), money_text(F.sum("cost")).alias("c"))
    return g.select("site", DC.dec_add("r", "c").alias("added"), DC.dec_sub("c", "r").alias("subtracted"), DC.dec_mul("r", "c").alias("multiplied"))


@query(
    "wide_exact_sums",
    "A1 F5",
    """WITH t AS (SELECT o_orderstatus, o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 1000000000000000000000 + 123456789 AS VARCHAR) AS big FROM orders)
SELECT o_orderstatus, CAST(SUM(CAST(big AS HUGEINT)) AS VARCHAR) || '.000000000000000000' || lpad(CAST(SUM(o_orderkey % 1000 + 1) AS VARCHAR), 12, '0') AS total_padded FROM t GROUP BY 1""",
)
def wide_exact_sums(spark, folder):
    """Thirty-digit integers with thirty decimals: far beyond one decimal type."""
    o = scan(spark, folder, "orders")
    k = F.col("o_orderkey")
    whole = (k.cast("decimal(38,0)") * F.lit("1000000000000000000000").cast("decimal(22,0)") + 123_456_789).cast("decimal(38,0)").cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((k % 1000 + 1).cast("string"), 30, "0"))
    t = o.select("o_orderstatus", text.alias("t"))
    parts = DC.with_exact_parts(t, F.col("t"), DC.is_decimal(F.col("t")), "p")
    sums = parts.groupBy("o_orderstatus").agg(*DC.limb_aggregates("p", "x"))
    total = sums.select("o_orderstatus", DC.combine_limbs("x").alias("total"))
    return total.select("o_orderstatus", DC.format_scale(F.col("total"), F.lit(30)).alias("total_padded"))


@query(
    "money_rounding",
    "F10",
    """SELECT o_orderkey, CAST(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * -0.1775, 2) AS DECIMAL(38,2)) AS VARCHAR) AS negative,
 CAST(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 1.0825, 1) AS DECIMAL(38,1)) AS VARCHAR) AS positive FROM orders""",
)
def money_rounding(spark, folder):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return scan(spark, folder, "orders").select(
        "o_orderkey",
        DC.quantize_money(price * F.lit("-0.1775").cast("decimal(4,4)"), 2).cast("string").alias("negative"),
        DC.quantize_money(price * F.lit("1.0825").cast("decimal(5,4)"), 1).cast("string").alias("positive"),
    )


@query(
    "date_texts",
    "F7 F8",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2001-02-' || lpad(CAST(20 + o_orderkey % 12 AS VARCHAR), 2, '0') WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%-d')
   WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT') || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':15:60Z' WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') || 'x' ELSE strftime(o_orderdate, '%Y-%m-%dt') || '23:59:07.25+0' || (o_orderkey % 12) || ':30' END AS s FROM orders)
SELECT o_orderkey, s, COALESCE(regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(s AS DATE) IS NOT NULL, FALSE) AS is_date,
 CASE o_orderkey % 6 WHEN 3 THEN o_orderkey % 30 < 24 WHEN 5 THEN o_orderkey % 12 < 10 ELSE FALSE END AS is_datetime FROM t""",
)
def date_texts(spark, folder):
    k = F.col("o_orderkey")
    f = lambda p: F.date_format("o_orderdate", p)
    s = (
        F.when(k % 6 == 0, f("yyyy-MM-dd"))
        .when(k % 6 == 1, F.concat(F.lit("2001-02-"), F.lpad((20 + k % 12).cast("string"), 2, "0")))
        .when(k % 6 == 2, f("yyyy-M-d"))
        .when(k % 6 == 3, F.concat(f("yyyy-MM-dd'T'"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit(":15:60Z")))
        .when(k % 6 == 4, F.concat(f("yyyy-MM-dd"), F.lit("x")))
        .otherwise(F.concat(f("yyyy-MM-dd't'"), F.lit("23:59:07.25+0"), (k % 12).cast("string"), F.lit(":30")))
    )
    t = scan(spark, folder, "orders").select("o_orderkey", s.alias("s"))
    return t.select("o_orderkey", "s", DT.is_valid_date(F.col("s")).alias("is_date"), DT.is_valid_datetime(F.col("s")).alias("is_datetime"))


@query(
    "month_arithmetic",
    "F9",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS day, CAST(CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS previous_start, CAST(CAST(date_trunc('month', d) - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS previous_end,
 strftime(date_trunc('month', d) - INTERVAL 3 MONTH, '%Y-%m') || ',' || strftime(date_trunc('month', d) - INTERVAL 2 MONTH, '%Y-%m') || ',' || strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m') || ',' || strftime(d, '%Y-%m') AS trailing FROM d""",
)
def month_arithmetic(spark, folder):
    d = scan(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    start, end = DT.previous_month(F.col("d"))
    months = F.array_join(F.transform(DT.trailing_months(F.col("d"), 4), DT.month_key), ",")
    return d.select(
        F.col("d").cast("string").alias("day"), start.cast("string").alias("previous_start"), end.cast("string").alias("previous_end"), months.alias("trailing")
    )


@query(
    "identifiers",
    "F14 F16 F17",
    """WITH n AS (SELECT p_partkey, p_partkey % 700 + 1 AS n, p_brand FROM part)
SELECT p_partkey, CASE WHEN n > 26 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letter,
 'S' || (p_partkey % 3) || ':R' || p_partkey AS row_id, p_partkey AS parsed, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 1 END IS NULL AS broken_is_null,
 'analysis-v1.0.0-' || p_brand || '-2001-01-01-all-' || CASE WHEN p_partkey % 2 = 0 THEN 'A+B' ELSE 'all' END AS snapshot_id FROM n WHERE n <= 702""",
)
def identifiers(spark, folder):
    k = F.col("p_partkey")
    sheet = F.concat(F.lit("S"), (k % 3).cast("string"))
    id_ = TX.row_id(sheet, k)
    broken = F.when(k % 2 == 0, F.concat(id_, F.lit("x"))).otherwise(id_)
    regions = F.when(k % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return scan(spark, folder, "part").select(
        "p_partkey", TX.column_letter(k % 700 + 1).alias("letter"), id_.alias("row_id"), TX.parse_row_id(id_).alias("parsed"),
        TX.parse_row_id(broken).isNull().alias("broken_is_null"),
        TX.snapshot_id(F.col("p_brand"), F.lit("2001-01-01"), F.lit(None).cast("string"), regions).alias("snapshot_id"),
    )


@query(
    "canonical_hashes",
    "F18",
    """WITH j AS (SELECT c_custkey, '{"key":"' || c_custkey || '","name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS body FROM customer)
SELECT c_custkey, body, sha256(body) AS digest FROM j""",
)
def canonical_hashes(spark, folder):
    body = TX.canonical_json(
        {
            "segment": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), "name": F.col("c_name"),
            "key": F.col("c_custkey").cast("string"),
        }
    )
    c = scan(spark, folder, "customer").select("c_custkey", body.alias("body"))
    return c.select("c_custkey", "body", TX.sha256_hex(F.col("body")).alias("digest"))


@query(
    "variances",
    "F19",
    f"""WITH {PLACED}, g AS (SELECT site, CAST(SUM(price) * 100 AS BIGINT) AS a, CAST(SUM(price) FILTER (WHERE o_orderstatus = 'F') * 100 AS BIGINT) AS t FROM placed GROUP BY 1)
SELECT site, {money_sql('CAST(a - t AS DECIMAL(30,0)) * 0.01')} AS absolute, CASE WHEN t <> 0 THEN {ratio_sql('(a - t)', 't')} END AS relative, {ratio_sql('(a - t) * 100', 'a')} AS points FROM g""",
)
def variances(spark, folder):
    from tabulith.sources.tables import money_text

    g = placed_orders(spark, folder).groupBy("site").agg(
        F.sum("price").alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("price"))).alias("t")
    )
    d = F.col("a") - F.col("t")
    return g.select(
        "site", money_text(d).alias("absolute"), DC.ratio6(d, F.col("t")).alias("relative"), DC.ratio6(d * 100, F.col("a")).alias("points")
    )
