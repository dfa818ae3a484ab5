"""Totals, derived figures, trends and distributions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.dates import month_key, month_starts, trailing_months, weekday_calendar
from tabulith.functions.decimals import ratio6
from tabulith.operators import metrics, quantiles
from tabulith.operators.scope import Scope, complete_periods, month_region_grid, period_completeness
from tabulith.policy import POLICY
from tabulith.queries.registry import (
    CURRENT,
    IN_CURRENT,
    IN_PREVIOUS,
    OPS,
    PLACED,
    PREVIOUS,
    cents_sql,
    money_sql,
    query,
    ratio_sql,
)
from tabulith.session import cut_lineage
from tabulith.sources.tables import MEASURES, fact_by_order, fact_lines, money_text, placed_orders, scan

NOW, BEFORE = Scope(*CURRENT), Scope(*PREVIOUS)


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """(month, region) sums of every measure, with line counts."""
    return (
        fact_by_order(spark, folder)
        .groupBy(month_key(F.col("date")).alias("month"), "region")
        .agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("rows").alias("rows"))
    )


def region_figures(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.two_periods(fact_by_order(spark, folder, (PREVIOUS[0], CURRENT[1])), "region", NOW, BEFORE, MEASURES, "rows")


@query(
    "month_region_totals",
    "A4 J8 J13 F9",
    f"""WITH {OPS},
 cells AS (SELECT strftime(date, '%Y-%m') AS month, region, SUM(revenue) AS revenue, SUM(target) AS target,
           SUM(cost) AS cost, SUM(orders) AS orders, SUM(downtime) AS downtime, COUNT(*) AS n FROM ops GROUP BY 1, 2),
 grid AS (SELECT m.month, r.region FROM (SELECT DISTINCT month FROM cells) m, (SELECT DISTINCT region FROM cells) r)
SELECT g.month, g.region, {money_sql('COALESCE(revenue, 0)')} AS revenue, {money_sql('COALESCE(target, 0)')} AS target,
       {money_sql('COALESCE(cost, 0)')} AS cost, CAST(COALESCE(orders, 0) AS BIGINT) AS orders,
       CAST(COALESCE(downtime, 0) AS BIGINT) AS downtime, CAST(COALESCE(n, 0) AS BIGINT) AS rows
FROM grid g LEFT JOIN cells c ON c.month = g.month AND c.region = g.region""",
)
def month_region_totals(spark, folder):
    cells = monthly(spark, folder)
    full = month_region_grid(cells, None, [*MEASURES, "rows"])
    cash = [money_text(F.col(m)).alias(m) for m in ("revenue", "target", "cost")]
    return full.select("month", "region", *cash, "orders", "downtime", "rows")


@query(
    "region_rollup",
    "A4 A19",
    f"""WITH {OPS} SELECT COALESCE(region, 'all') AS region, {money_sql('SUM(revenue)')} AS revenue,
 CAST(SUM(downtime) AS BIGINT) AS downtime, COUNT(*) AS rows FROM ops WHERE {IN_CURRENT} GROUP BY ROLLUP(region)""",
)
def region_rollup(spark, folder):
    now = fact_by_order(spark, folder, CURRENT)
    sums = now.rollup("region").agg(
        F.sum("revenue").alias("revenue"), F.sum("downtime").alias("downtime"), F.sum("rows").alias("rows")
    )
    return sums.select(F.coalesce("region", F.lit("all")).alias("region"), money_text(F.col("revenue")).alias("revenue"), "downtime", "rows")


@query(
    "fact_assembly",
    "J13",
    f"""WITH {OPS} SELECT region, site, COUNT(*) AS rows, COUNT(DISTINCT o_orderkey) AS order_count,
 {money_sql('SUM(revenue)')} AS revenue FROM ops GROUP BY 1, 2""",
)
def fact_assembly(spark, folder):
    # One row per order is enough to count distinct orders exactly.
    return fact_by_order(spark, folder).groupBy("region", "site").agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("order_count"),
        money_text(F.sum("revenue")).alias("revenue"),
    )


@query(
    "fact_line_rows",
    "J13",
    f"""WITH {OPS} SELECT region, orders, downtime, COUNT(*) AS n, {money_sql('SUM(cost)')} AS cost FROM ops GROUP BY 1, 2, 3""",
)
def fact_line_rows(spark, folder):
    return fact_lines(spark, folder).groupBy("region", "orders", "downtime").agg(
        F.count(F.lit(1)).alias("n"), money_text(F.sum("cost")).alias("cost")
    )


def _scope_specs(prefix: str) -> list[metrics.SumSpec]:
    asia = Scope(*CURRENT, regions=("ASIA",))
    return [
        metrics.SumSpec(f"{prefix}-asia-current", "amount", asia, ("amount", "score")),
        metrics.SumSpec(f"{prefix}-asia-previous", "amount", Scope(*PREVIOUS, regions=("ASIA",)), ("amount",)),
        metrics.SumSpec(f"{prefix}-two-regions", "amount", Scope(*CURRENT, regions=("ASIA", "EUROPE")), ("amount", "score")),
        metrics.SumSpec(f"{prefix}-current", "amount", NOW, ("amount",)),
        metrics.SumSpec(f"{prefix}-all", "score", Scope(), ("amount", "score")),
    ]


def _text_orders(spark, folder) -> DataFrame:
    """Orders as messy text: amounts of mixed scale, some cells not decimal, some blank."""
    placed = placed_orders(spark, folder)
    amount = (
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("n/a"))
        .when(F.col("o_orderkey") % 13 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderkey") % 3 == 0, F.call_function("div", F.col("price"), F.lit(100).cast("long")).cast("string"))
        .otherwise(money_text(F.col("price")))
    )
    score = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100).cast("string"))
    return placed.select("source_row", "date", "region", "site", amount.alias("amount"), score.alias("score"))


TEXT_ORDERS = f"""{PLACED}, t AS (SELECT source_row, date, region, site,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN CAST(CAST(FLOOR(price) AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 100 AS VARCHAR) END AS score FROM placed),
 u AS (SELECT *, TRY_CAST(amount AS DECIMAL(18,2)) AS a, CAST(score AS BIGINT) AS s,
       CASE WHEN contains(amount, '.') THEN 2 ELSE 0 END AS sc FROM t)"""


def _scoped_sql(id_: str, scope: str, ok: str, value: str, scaled: bool) -> str:
    eligible = f"({scope}) AND {ok}"
    total = f"SUM({value}) FILTER (WHERE {eligible})"
    if scaled:
        text = (
            f"CASE WHEN MAX(sc) FILTER (WHERE {eligible}) = 2 THEN {money_sql(total)}"
            f" ELSE CAST(CAST(COALESCE({total}, 0) AS BIGINT) AS VARCHAR) END"
        )
        scale = f"COALESCE(MAX(sc) FILTER (WHERE {eligible}), 0)"
    else:
        text, scale = f"CAST(CAST(COALESCE({total}, 0) AS BIGINT) AS VARCHAR)", "0"
    return (
        f"SELECT '{id_}' AS metric_id, {text} AS value, COUNT(*) FILTER (WHERE {eligible}) AS eligible_rows, "
        f"COUNT(*) FILTER (WHERE {scope}) AS total_rows, CAST({scale} AS INTEGER) AS scale FROM u"
    )


@query(
    "scoped_sums",
    "P1 P2 P3 A1 A2 F1 F12 E1",
    f"WITH {TEXT_ORDERS} "
    + " UNION ALL ".join(
        [
            _scoped_sql("m-asia-current", f"{IN_CURRENT} AND region = 'ASIA'", "a IS NOT NULL AND s IS NOT NULL", "a", True),
            _scoped_sql("m-asia-previous", f"{IN_PREVIOUS} AND region = 'ASIA'", "a IS NOT NULL", "a", True),
            _scoped_sql("m-two-regions", f"{IN_CURRENT} AND region IN ('ASIA', 'EUROPE')", "a IS NOT NULL AND s IS NOT NULL", "a", True),
            _scoped_sql("m-current", IN_CURRENT, "a IS NOT NULL", "a", True),
            _scoped_sql("m-all", "TRUE", "a IS NOT NULL AND s IS NOT NULL", "s", False),
        ]
    ),
)
def scoped_sums(spark, folder):
    return metrics.scoped_sums(_text_orders(spark, folder), _scope_specs("m"), F.col("date"), F.col("region"))


@query(
    "generic_totals",
    "A3 P19 P4",
    f"WITH {TEXT_ORDERS} " + _scoped_sql("total-amount", IN_CURRENT, "a IS NOT NULL", "a", True),
)
def generic_totals(spark, folder):
    from tabulith.table import ColumnInfo

    columns = [
        ColumnInfo("date", "date", 1, "date", "date", confirmed=True),
        ColumnInfo("region", "region", 2, "text", "dimension", confirmed=True),
        ColumnInfo("amount", "amount", 3, "mixed", "measure", additive=True, confirmed=True),
        ColumnInfo("score", "score", 4, "integer", "measure", additive=False, confirmed=True),
        ColumnInfo("other", "other", 5, "decimal", "measure", additive=True, confirmed=False),
    ]
    return metrics.generic_totals(
        _text_orders(spark, folder), columns, NOW, ["metric.amount", "metric.score"], F.col("date"), F.col("region")
    )


@query(
    "target_gap",
    "A5 A19 J9",
    f"""WITH {OPS}, g AS (SELECT region, SUM(revenue) AS r, SUM(target) AS t, COUNT(*) AS n FROM ops WHERE {IN_CURRENT} GROUP BY 1)
SELECT region, {money_sql('r')} AS revenue, {money_sql('t')} AS target,
 CASE WHEN t > 0 THEN {ratio_sql('(' + cents_sql('r') + ' - ' + cents_sql('t') + ')', cents_sql('t'))} END AS gap,
 CASE WHEN t > 0 THEN NULL ELSE 'metric.targetNonPositive' END AS reason, n AS rows FROM g""",
)
def target_gap(spark, folder):
    now = fact_by_order(spark, folder, CURRENT)
    sums = now.groupBy("region").agg(
        F.sum("revenue").alias("r"), F.sum("target").alias("t"), F.sum("rows").alias("rows")
    )
    gap, reason = metrics.target_gap(F.col("r"), F.col("t"))
    return sums.select(
        "region", money_text(F.col("r")).alias("revenue"), money_text(F.col("t")).alias("target"), gap.alias("gap"),
        reason.alias("reason"), "rows",
    )


TWO = f"""{OPS}, g AS (SELECT region, {', '.join(
    f"CAST(COALESCE(SUM({'CAST(' + m + '*100 AS BIGINT)' if m in ('revenue', 'target', 'cost') else m}) FILTER (WHERE {w}), 0) AS BIGINT) AS {m}_{p}"
    for m in MEASURES for p, w in (('cur', IN_CURRENT), ('prev', IN_PREVIOUS)))},
  COUNT(*) FILTER (WHERE {IN_CURRENT}) AS rows_cur, COUNT(*) FILTER (WHERE {IN_PREVIOUS}) AS rows_prev
  FROM ops WHERE {IN_CURRENT} OR {IN_PREVIOUS} GROUP BY 1)"""


def _change_sql(m: str) -> str:
    return (
        f"SELECT region, '{m}' AS measure, CASE WHEN {m}_prev = 0 THEN 'not_computable' WHEN {m}_prev < 0 THEN 'negative-base' "
        f"ELSE 'defined' END AS status, {ratio_sql(f'({m}_cur - {m}_prev)', f'{m}_prev')} AS change, "
        f"{m}_cur - {m}_prev AS absolute, {m}_cur AS current, {m}_prev AS previous FROM g"
    )


@query("period_change", "A6 J9 F9", f"WITH {TWO} " + " UNION ALL ".join(_change_sql(m) for m in MEASURES))
def period_change(spark, folder):
    figs = region_figures(spark, folder)
    items = []
    for m in MEASURES:
        cur, prev = F.col(f"{m}_cur"), F.col(f"{m}_prev")
        status, ratio, absolute = metrics.relative_change(cur, prev)
        items.append(
            F.struct(
                F.lit(m).alias("measure"), status.alias("status"), ratio.alias("change"), absolute.alias("absolute"),
                cur.alias("current"), prev.alias("previous"),
            )
        )
    return figs.select("region", F.explode(F.array(*items)).alias("x")).select("region", "x.*")


@query(
    "contribution_margin",
    "A7 P2",
    f"""WITH {TWO} SELECT region, {money_sql('(revenue_cur - cost_cur) * 0.01')} AS contribution,
 CASE WHEN revenue_cur > 0 THEN {ratio_sql('(revenue_cur - cost_cur)', 'revenue_cur')} END AS margin,
 CASE WHEN revenue_cur > 0 THEN NULL ELSE 'metric.revenueNonPositive' END AS reason FROM g""",
)
def contribution_margin(spark, folder):
    figs = region_figures(spark, folder)
    ratio, reason = metrics.margin(F.col("revenue_cur"), F.col("cost_cur"))
    return figs.select(
        "region", money_text(F.col("revenue_cur") - F.col("cost_cur")).alias("contribution"), ratio.alias("margin"),
        reason.alias("reason"),
    )


@query(
    "materiality",
    "A13 J11",
    f"""WITH {TWO} SELECT region, downtime_cur - downtime_prev AS change, CAST(SUM(downtime_prev) OVER () AS BIGINT) AS prior_scope,
 ABS(downtime_cur - downtime_prev) * 20 >= SUM(downtime_prev) OVER () AS material FROM g""",
)
def materiality(spark, folder):
    figs = cut_lineage(region_figures(spark, folder).select("region", "downtime_cur", "downtime_prev"))
    prior = figs.agg(F.sum("downtime_prev").alias("p")).scalar()
    change = F.col("downtime_cur") - F.col("downtime_prev")
    threshold = F.lit(POLICY.materiality_share) * F.col("prior_scope")
    return figs.withColumn("prior_scope", prior).select(
        "region", change.alias("change"), "prior_scope", (F.abs(change) >= threshold).alias("material")
    )


MONTHLY = f"""{OPS}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, region,
  SUM(revenue) AS revenue, COUNT(*) AS n FROM ops GROUP BY 1, 2)"""


@query(
    "previous_month_lag",
    "W3 F9 J9",
    f"""WITH {MONTHLY} SELECT strftime(a.month_start, '%Y-%m') AS month, a.region, {money_sql('a.revenue')} AS revenue,
 {money_sql('b.revenue')} AS previous FROM m a LEFT JOIN m b
 ON b.region = a.region AND b.month_start = a.month_start - INTERVAL 1 MONTH""",
)
def previous_month_lag(spark, folder):
    m = _month_starts_frame(spark, folder)
    lagged = metrics.previous_period_value(m, ["region"], "revenue")
    return lagged.select(
        month_key(F.col("month_start")).alias("month"), "region", money_text(F.col("revenue")).alias("revenue"),
        money_text(F.col("previous")).alias("previous"),
    )


def _month_starts_frame(spark, folder) -> DataFrame:
    return fact_by_order(spark, folder).groupBy(F.trunc("date", "month").alias("month_start"), "region").agg(
        F.sum("revenue").alias("revenue"), F.sum("downtime").alias("downtime"), F.sum("rows").alias("rows")
    )


@query(
    "trend_four_months",
    "W4 W3 F9 J7 J8",
    f"""WITH {OPS}, c AS (SELECT UNNEST(['revenue', 'target', 'cost']) AS measure),
 m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, region, measure, COUNT(*) AS n,
   SUM(CASE measure WHEN 'revenue' THEN revenue WHEN 'target' THEN target ELSE cost END) AS value FROM ops, c GROUP BY 1, 2, 3),
 days AS (SELECT DISTINCT month_start, CAST(UNNEST(generate_series(month_start, last_day(month_start), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT month_start FROM m)),
 cal AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY month_start ORDER BY date) AS rn FROM days WHERE isodow(date) < 6),
 whole AS (SELECT month_start FROM cal WHERE rn <= 20 GROUP BY 1 HAVING COUNT(*) FILTER (WHERE date NOT IN (SELECT date FROM ops)) = 0),
 ends AS (SELECT DISTINCT month_start AS end_month FROM m),
 grid AS (SELECT e.end_month, r.region, c.measure, CAST(e.end_month - to_months(k.k) AS DATE) AS month_start
   FROM ends e, (SELECT DISTINCT region FROM m) r, c, (SELECT UNNEST([0, 1, 2, 3]) AS k) k),
 v AS (SELECT g.*, COALESCE(m.value, 0) AS value, CASE WHEN g.month_start IN (SELECT month_start FROM whole) THEN COALESCE(m.n, 0) ELSE 0 END AS n,
   LAG(COALESCE(m.value, 0)) OVER (PARTITION BY g.end_month, g.region, g.measure ORDER BY g.month_start) AS prev
   FROM grid g LEFT JOIN m ON m.region = g.region AND m.month_start = g.month_start AND m.measure = g.measure),
 s AS (SELECT end_month, region, measure, MIN(n) AS least, MIN(SIGN(value - prev)) AS lo, MAX(SIGN(value - prev)) AS hi FROM v GROUP BY 1, 2, 3)
SELECT strftime(end_month, '%Y-%m') AS month, region, measure, CASE WHEN lo > 0 THEN 'up' ELSE 'down' END AS direction
FROM s WHERE least > 0 AND lo = hi AND lo <> 0""",
)
def trend_four_months(spark, folder):
    cash = ("revenue", "target", "cost")
    daily = cut_lineage(fact_by_order(spark, folder).groupBy("date", "region").agg(*[F.sum(c).alias(c) for c in cash], F.sum("rows").alias("rows")))
    m = daily.groupBy(F.trunc("date", "month").alias("month_start"), "region").agg(*[F.sum(c).alias(c) for c in cash], F.sum("rows").alias("rows"))
    months = daily.select(F.trunc("date", "month").alias("month_start")).distinct()
    spans = months.select(month_key(F.col("month_start")).alias("period"), F.col("month_start").alias("start"), F.last_day("month_start").alias("end"))
    complete = complete_periods(daily, weekday_calendar(months), spans).select(F.col("start").alias("month_start"), "complete")
    long = m.join(complete, "month_start").select(
        "month_start", "region", "rows", "complete", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in cash])).alias("_v")
    ).select("month_start", "region", "rows", "complete", "_v.measure", "_v.value")
    # Each month feeds the four windows that end at it or up to three months later.
    spread = long.withColumn("end_month", F.explode(trailing_months(F.add_months("month_start", 3), 4)))
    spread = spread.join(months.withColumnRenamed("month_start", "end_month"), "end_month", "left_semi")
    trends = metrics.monotonic_trend(spread, ["end_month", "region", "measure"], "value", POLICY.trend_periods)
    return trends.select(month_key(F.col("end_month")).alias("month"), "region", "measure", "direction")


def _quantile_sql(source: str, keys: str, value: str, scale: int) -> str:
    """Type-7 quantiles by row number, in exact decimals."""
    wide = f"DECIMAL(38,{scale + 6})"
    return f"""r AS (SELECT {keys}, {value} AS v, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn,
  COUNT(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
 t AS (SELECT DISTINCT {keys}, n, p, (n - 1) * k AS h4 FROM r, (VALUES ('0.25', 1), ('0.5', 2), ('0.75', 3)) q(p, k)),
 u AS (SELECT *, GREATEST(1, LEAST(h4 // 4 + 1, n - 1)) AS j FROM t),
 w AS (SELECT u.*, CAST(CAST((h4 + 4 - 4 * j) AS DECIMAL(10,2)) * 0.25 AS DECIMAL(12,4)) AS g FROM u),
 qs AS (SELECT w.{keys}, w.p, w.n, CAST(CAST(a.v AS {wide}) + CAST(w.g * CAST(b.v - a.v AS DECIMAL(18,{scale})) AS {wide}) AS {wide}) AS q
   FROM w JOIN r a ON a.{keys} = w.{keys} AND a.rn = w.j JOIN r b ON b.{keys} = w.{keys} AND b.rn = LEAST(w.j + 1, w.n))"""


@query(
    "quantiles_type7",
    "A11 W7",
    f"""WITH src AS (SELECT event_type, CAST(value AS DECIMAL(12,2)) AS v0 FROM events), {_quantile_sql('src', 'event_type', 'v0', 2)}
SELECT event_type, p, n, CAST(q AS VARCHAR) AS quantile FROM qs""",
)
def quantiles_type7(spark, folder):
    events = scan(spark, folder, "events").select("event_type", F.col("value").cast("decimal(12,2)").alias("v0"))
    q = quantiles.quantiles(events, ["event_type"], "v0", ("0.25", "0.5", "0.75"))
    return q.select("event_type", "p", "n", F.col("quantile").cast("string").alias("quantile"))


@query(
    "describe_prices",
    "A10 A11 W7",
    f"""WITH {PLACED}, {_quantile_sql('placed', 'region', 'price', 2)}
SELECT region, COUNT(*) AS count, CAST(MIN(price) AS VARCHAR) AS min, CAST(MAX(price) AS VARCHAR) AS max,
 (SELECT CAST(q AS VARCHAR) FROM qs WHERE qs.region = placed.region AND p = '0.25') AS q1,
 (SELECT CAST(q AS VARCHAR) FROM qs WHERE qs.region = placed.region AND p = '0.5') AS median,
 (SELECT CAST(q AS VARCHAR) FROM qs WHERE qs.region = placed.region AND p = '0.75') AS q3
FROM placed GROUP BY region""",
)
def describe_prices(spark, folder):
    prices = placed_orders(spark, folder).select(
        "region", (F.col("price").cast("decimal(16,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)").alias("price")
    )
    d = quantiles.describe(prices, ["region"], "price")
    return d.select("region", "count", *[F.col(c).cast("string").alias(c) for c in ("min", "max", "q1", "median", "q3")])


@query(
    "outlier_scan",
    "A12",
    f"""WITH src AS (SELECT event_id + 2 AS source_row, event_type, CAST(value AS DECIMAL(12,2)) AS v0 FROM events),
 {_quantile_sql('src', 'event_type', 'v0', 2)},
 f AS (SELECT event_type, ANY_VALUE(n) AS n, MAX(q) FILTER (WHERE p = '0.25') AS q1, MAX(q) FILTER (WHERE p = '0.75') AS q3 FROM qs GROUP BY 1)
SELECT source_row, src.event_type, CAST(v0 AS VARCHAR) AS value FROM src JOIN f ON f.event_type = src.event_type
WHERE f.n >= 30 AND q3 > q1 AND (v0 < q1 - 3 * (q3 - q1) OR v0 > q3 + 3 * (q3 - q1))""",
)
def outlier_scan(spark, folder):
    events = scan(spark, folder, "events").select(
        (F.col("event_id") + 2).alias("source_row"), "event_type", F.col("value").cast("decimal(12,2)").alias("v0")
    )
    flagged = quantiles.outliers(
        events, ["event_type"], "v0", "source_row", POLICY.outlier_min_rows, POLICY.iqr_multiplier
    )
    return flagged.select("source_row", "event_type", F.col("v0").cast("string").alias("value"))


@query(
    "chart_domain",
    "A14",
    f"""WITH {OPS}, m AS (SELECT strftime(date, '%Y-%m') AS month, region, SUM(revenue) AS r FROM ops GROUP BY 1, 2),
 x AS (SELECT month, MAX(ABS(r)) AS top, CAST(MAX(ABS(r)) * 1.1 AS DECIMAL(38,3)) AS s FROM m GROUP BY 1),
 y AS (SELECT *, CAST(power(10, length(CAST(CAST(FLOOR(s) AS HUGEINT) AS VARCHAR)) - 2) AS HUGEINT) AS step FROM x)
SELECT month, {money_sql('top')} AS top, CAST(CAST(CEIL(s) AS HUGEINT) // step * step
  + CASE WHEN CAST(CAST(CEIL(s) AS HUGEINT) // step * step AS DECIMAL(38,3)) < s THEN step ELSE 0 END AS VARCHAR) AS ceiling FROM y""",
)
def chart_domain(spark, folder):
    m = monthly(spark, folder).groupBy("month").agg(F.max(F.abs("revenue")).alias("top"))
    top = money_text(F.col("top"))
    return m.select("month", top.alias("top"), metrics.domain_ceiling(top).alias("ceiling"))


@query(
    "coverage_counts",
    "A15",
    f"""WITH {PLACED} SELECT strftime(date, '%Y-%m') AS month, COUNT(*) AS rows, COUNT(DISTINCT source_row) AS ids,
 COUNT(DISTINCT date) AS days, COUNT(DISTINCT region) AS regions, COUNT(DISTINCT site) AS sites FROM placed GROUP BY 1""",
)
def coverage_counts(spark, folder):
    return placed_orders(spark, folder).groupBy(month_key(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("source_row").alias("ids"), F.count_distinct("date").alias("days"),
        F.count_distinct("region").alias("regions"), F.count_distinct("site").alias("sites"),
    )


@query(
    "largest_remainder",
    "A20",
    """WITH w AS (SELECT o_orderkey, o_orderstatus, CAST(FLOOR(o_totalprice) AS BIGINT) % 51 + 75 AS weight FROM orders),
 s AS (SELECT *, 1000003 AS total, SUM(weight) OVER (PARTITION BY o_orderstatus) AS den FROM w),
 b AS (SELECT *, CAST(total * weight // den AS BIGINT) AS base, CAST(total * weight % den AS BIGINT) AS rem FROM s),
 k AS (SELECT *, total - SUM(base) OVER (PARTITION BY o_orderstatus) AS left_over,
   ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY rem DESC, o_orderkey) AS rn FROM b)
SELECT o_orderkey, o_orderstatus, weight, CAST(base + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS BIGINT) AS share FROM k""",
)
def largest_remainder(spark, folder):
    weight = F.floor("o_totalprice").cast("long") % 51 + 75
    rows = scan(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", weight.alias("weight"), F.lit(1_000_003).cast("long").alias("total")
    )
    spread = metrics.largest_remainder(rows, ["o_orderstatus"], "weight", "total", "o_orderkey")
    return spread.select("o_orderkey", "o_orderstatus", "weight", F.col("share").cast("long").alias("share"))


@query(
    "weighted_rate",
    "A21 F19",
    f"""WITH {MONTHLY}, d AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, SUM(downtime) AS num, SUM(orders) AS den FROM ops GROUP BY 1),
 e AS (SELECT *, LAG(num) OVER (ORDER BY month_start) AS pn, LAG(den) OVER (ORDER BY month_start) AS pd FROM d)
SELECT strftime(month_start, '%Y-%m') AS month, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, {ratio_sql('num', 'den')} AS rate,
 CASE WHEN pn IS NOT NULL THEN {ratio_sql('(100 * (num * pd - pn * den))', '(den * pd)')} END AS change_pp FROM e""",
)
def weighted_rate(spark, folder):
    fact = fact_by_order(spark, folder).withColumn("month_start", F.trunc("date", "month"))
    rates = metrics.weighted_rate(fact, ["month_start"], "downtime", "orders")
    before = rates.select(
        F.add_months("month_start", 1).alias("month_start"), F.col("num").alias("pn"), F.col("den").alias("pd")
    )
    j = rates.join(before, "month_start", "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = ((wide("num") * wide("pd") - wide("pn") * wide("den")) * 100).cast("decimal(38,0)")
    change = F.when(F.col("pn").isNotNull(), ratio6(top, (wide("den") * wide("pd")).cast("decimal(38,0)")))
    return j.select(month_key(F.col("month_start")).alias("month"), "num", "den", "rate", change.alias("change_pp"))


@query(
    "calendar_completeness",
    "J7 F24",
    f"""WITH {PLACED}, days AS (SELECT CAST(UNNEST(generate_series(DATE '1995-01-01', DATE '2001-08-31', INTERVAL 1 DAY)) AS DATE) AS date),
 cal AS (SELECT date, strftime(date, '%Y-%m') AS period, ROW_NUMBER() OVER (PARTITION BY strftime(date, '%Y-%m') ORDER BY date) AS rn
   FROM days WHERE isodow(date) < 6),
 gap AS (SELECT period, COUNT(*) AS scheduled, COUNT(*) FILTER (WHERE date NOT IN (SELECT date FROM placed)) AS missing
   FROM cal WHERE rn <= 20 GROUP BY 1)
SELECT period, scheduled, missing, missing = 0 AS complete FROM gap""",
)
def calendar_completeness(spark, folder):
    calendar = weekday_calendar(month_starts(spark, "1995-01-01", "2001-08-01"))
    return period_completeness(placed_orders(spark, folder), calendar)


@query(
    "reporting_calendar",
    "F24 F9",
    """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS ms FROM orders),
 days AS (SELECT ms, CAST(UNNEST(generate_series(ms, CAST(ms + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), INTERVAL 1 DAY)) AS DATE) AS d FROM m),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ms ORDER BY d) AS rn FROM days WHERE isodow(d) < 6)
SELECT CAST(d AS VARCHAR) AS date, strftime(ms, '%Y-%m') AS period FROM r WHERE rn <= 20""",
)
def reporting_calendar(spark, folder):
    months = scan(spark, folder, "orders").select(F.trunc("o_orderdate", "month").alias("month_start")).distinct()
    return weekday_calendar(months).select(F.col("date").cast("string").alias("date"), "period")


@query(
    "duplicate_labels",
    "A18",
    "SELECT p_name AS label, COUNT(*) AS uses FROM part GROUP BY 1 HAVING COUNT(*) > 1",
)
def duplicate_labels(spark, folder):
    parts = scan(spark, folder, "part").groupBy(F.col("p_name").alias("label")).agg(F.count(F.lit(1)).alias("uses"))
    return parts.filter(F.col("uses") > 1)
