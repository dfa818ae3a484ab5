"""Findings, proofs, scenarios and result tables of the regional briefing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.dates import month_starts, weekday_calendar
from tabulith.operators import checks as C
from tabulith.operators import evidence as E
from tabulith.operators import expressions as X
from tabulith.operators import normalize as N
from tabulith.operators import scenario as SC
from tabulith.operators import spans as S
from tabulith.operators.metrics import axis_domain
from tabulith.plans import briefing as B
from tabulith.queries.quality import CLEAN, LEDGER, RESOLVED, resolved
from tabulith.queries.registry import CURRENT, IN_CURRENT, IN_PREVIOUS, OPS, PLACED, PREVIOUS, long_division_sql, money_sql, query, ratio_sql
from tabulith.queries.totals import NOW, BEFORE, TWO
from tabulith.session import cut_lineage, shared_folder
from tabulith.sinks import publish as PU
from tabulith.sinks import tables as K
from tabulith.sources.tables import fact_by_order, money_text, placed_orders, scan


TWO_MONTHS = (PREVIOUS[0], CURRENT[1])


def reporting_days(spark: SparkSession) -> DataFrame:
    """The calendar that both periods have to cover: the first 20 weekdays of each month."""
    return weekday_calendar(month_starts(spark, *TWO_MONTHS))


def figures(spark: SparkSession, folder: str) -> DataFrame:
    return B.figures(fact_by_order(spark, folder, TWO_MONTHS), NOW, BEFORE)


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return B.metric_frame(figures(spark, folder), NOW, BEFORE)


FIGS = f"""{TWO}, names AS (SELECT column_name FROM (DESCRIBE SELECT 1 AS x) LIMIT 0),
 figs AS (SELECT region AS entity, * EXCLUDE (region) FROM g
  UNION ALL BY NAME SELECT 'all' AS entity, CAST(SUM(revenue_cur) AS BIGINT) AS revenue_cur, CAST(SUM(revenue_prev) AS BIGINT) AS revenue_prev,
   CAST(SUM(target_cur) AS BIGINT) AS target_cur, CAST(SUM(target_prev) AS BIGINT) AS target_prev, CAST(SUM(cost_cur) AS BIGINT) AS cost_cur,
   CAST(SUM(cost_prev) AS BIGINT) AS cost_prev, CAST(SUM(orders_cur) AS BIGINT) AS orders_cur, CAST(SUM(orders_prev) AS BIGINT) AS orders_prev,
   CAST(SUM(downtime_cur) AS BIGINT) AS downtime_cur, CAST(SUM(downtime_prev) AS BIGINT) AS downtime_prev,
   CAST(SUM(rows_cur) AS BIGINT) AS rows_cur, CAST(SUM(rows_prev) AS BIGINT) AS rows_prev FROM g),
 f AS (SELECT *, replace(lower(entity), ' ', '-') AS slug FROM figs)""".replace(
    " names AS (SELECT column_name FROM (DESCRIBE SELECT 1 AS x) LIMIT 0),\n", ""
)

SUMS = (
    ("current-revenue", "metric.revenue", "currency", "revenue", "cur"),
    ("current-target", "metric.target", "currency", "target", "cur"),
    ("previous-orders", "metric.orders", "count", "orders", "prev"),
    ("current-orders", "metric.orders", "count", "orders", "cur"),
    ("previous-downtime", "metric.downtime", "minutes", "downtime", "prev"),
    ("current-downtime", "metric.downtime", "minutes", "downtime", "cur"),
    ("current-cost", "metric.cost", "currency", "cost", "cur"),
)
RATIOS = (
    ("target-gap", "metric.targetGap", "(revenue_cur - target_cur)", "target_cur", "target_cur > 0"),
    ("orders-change", "metric.ordersChange", "(orders_cur - orders_prev)", "orders_prev", "orders_prev <> 0"),
    ("downtime-change", "metric.downtimeChange", "(downtime_cur - downtime_prev)", "downtime_prev", "downtime_prev <> 0"),
    ("margin", "metric.margin", "(revenue_cur - cost_cur)", "revenue_cur", "revenue_cur > 0"),
)


def _cash(column: str) -> str:
    return money_sql(f"CAST({column} AS DECIMAL(30,0)) * 0.01")


METRICS = (
    f"{FIGS}, metrics AS ("
    + " UNION ALL ".join(
        [
            f"SELECT entity, slug || '-{s}' AS metric_id, '{label}' AS label, '{unit}' AS unit, "
            + (_cash(f"{m}_{w}") if unit == "currency" else f"CAST({m}_{w} AS VARCHAR)")
            + f" AS value, CAST(NULL AS DOUBLE) AS ratio, 'defined' AS status, rows_{w} AS eligible_rows, "
            f"'{{\"op\":\"sum\",\"selection_id\":\"' || slug || '-{s}-rows\",\"field\":\"{m}\"}}' AS expression FROM f"
            for s, label, unit, m, w in SUMS
        ]
        + [
            f"SELECT entity, slug || '-contribution', 'metric.contribution', 'currency', {_cash('(revenue_cur - cost_cur)')}, NULL, 'defined', rows_cur, "
            "'{\"op\":\"subtract\",\"left\":{\"op\":\"metric\",\"metric_id\":\"' || slug || '-current-revenue\"},\"right\":{\"op\":\"metric\",\"metric_id\":\"' || slug || '-current-cost\"}}' FROM f"
        ]
        + [
            f"SELECT entity, slug || '-{s}', '{label}', 'ratio', NULL, CASE WHEN {ok} THEN {ratio_sql(n, d)} END, "
            f"CASE WHEN {ok} THEN 'defined' ELSE 'undefined' END, rows_cur, NULL FROM f"
            for s, label, n, d, ok in RATIOS
        ]
    )
    + ")"
)


@query(
    "briefing_metrics",
    "E9 A2 A5 A6 A7 V2",
    f"WITH {METRICS} SELECT entity, metric_id, label, unit, value, ratio, status, eligible_rows FROM metrics",
)
def briefing_metrics(spark, folder):
    m = metrics(spark, folder)
    plain = F.when(F.col("unit") != "ratio", F.col("value"))
    return m.select("entity", "metric_id", "label", "unit", plain.alias("value"), "ratio", "status", "eligible_rows")


@query(
    "exact_quotients",
    "F5 A5 A6 A7",
    f"""WITH {FIGS}, nd AS (
  SELECT slug || '-target-gap' AS id, CAST(revenue_cur - target_cur AS HUGEINT) AS n, CAST(target_cur AS HUGEINT) AS d FROM f WHERE target_cur > 0
  UNION ALL SELECT slug || '-orders-change', orders_cur - orders_prev, orders_prev FROM f WHERE orders_prev > 0
  UNION ALL SELECT slug || '-downtime-change', downtime_cur - downtime_prev, downtime_prev FROM f WHERE downtime_prev > 0
  UNION ALL SELECT slug || '-margin', revenue_cur - cost_cur, revenue_cur FROM f WHERE revenue_cur > 0),
 {long_division_sql()} SELECT id AS metric_id, value FROM out""",
)
def exact_quotients(spark, folder):
    return metrics(spark, folder).filter("unit = 'ratio' and status = 'defined'").select("metric_id", "value")


@query(
    "briefing_proofs",
    "E3 E12 E13 K4 F18",
    f"WITH {METRICS} SELECT metric_id || '-proof' AS proof_id, metric_id, expression, value AS result FROM metrics WHERE unit <> 'ratio'",
)
def briefing_proofs(spark, folder):
    m = metrics(spark, folder)
    p = B.proof_frame(m)
    # A proof's owner is the metric that publishes it.
    owned = p.join(m.select("metric_id", "unit", F.col("provenance_id").alias("proof_id")), "proof_id")
    return owned.filter("unit <> 'ratio'").select("proof_id", "metric_id", "expression", "result")


@query(
    "expression_operands",
    "E11 E1 V4",
    f"""WITH {FIGS}, p AS ({' UNION ALL '.join(
        [f"SELECT slug || '-{s}-proof' AS proof_id, 'selection' AS operand, slug || '-{s}-rows' AS value FROM f" for s, *_ in SUMS]
        + [f"SELECT slug || '-{p}-proof', 'metric', slug || '-{v}' FROM f" for p, v in (
            ('target-gap', 'current-revenue'), ('target-gap', 'current-target'), ('orders-change', 'current-orders'),
            ('orders-change', 'previous-orders'), ('downtime-change', 'current-downtime'), ('downtime-change', 'previous-downtime'),
            ('contribution', 'current-revenue'), ('contribution', 'current-cost'), ('margin', 'contribution'), ('margin', 'current-revenue'))]
    )}) SELECT * FROM p""",
)
def expression_operands(spark, folder):
    return X.operands(B.proof_frame(metrics(spark, folder)))


_CALENDARS = {
    "weekdays": "SELECT date FROM (SELECT date, ROW_NUMBER() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS rn FROM days WHERE isodow(date) < 6) WHERE rn <= 20",
    "trading": f"SELECT DISTINCT date FROM ops WHERE {IN_CURRENT} OR {IN_PREVIOUS}",
}


def _findings_sql(*calendars: str) -> str:
    """Findings under each calendar that the two months cover; with one calendar the column that names it is left out."""
    days = " UNION ALL ".join(f"SELECT '{c}' AS calendar, date FROM ({_CALENDARS[c]})" for c in calendars)
    name = ", calendar" if len(calendars) > 1 else ""
    return f"""{FIGS}, days AS (SELECT CAST(UNNEST(generate_series(DATE '{PREVIOUS[0]}', DATE '{CURRENT[1]}', INTERVAL 1 DAY)) AS DATE) AS date),
 cal AS ({days}), whole AS (SELECT calendar, COUNT(*) FILTER (WHERE date NOT IN (SELECT date FROM ops)) = 0 AS ok FROM cal GROUP BY 1),
 x AS (SELECT f.*, whole.calendar, (SELECT downtime_prev FROM figs WHERE entity = 'all') AS prior FROM f, whole WHERE entity <> 'all' AND ok),
 found AS (SELECT 'finding-target-' || slug AS finding_id, 'divergence' AS kind, entity, 1 AS class_priority, ABS({ratio_sql('(revenue_cur - target_cur)', 'target_cur')}) AS magnitude{name} FROM x
   WHERE target_cur > 0 AND orders_prev > 0 AND (revenue_cur - target_cur) * 100 <= -5 * target_cur AND (orders_cur - orders_prev) * 100 >= 5 * orders_prev AND rows_cur >= 20
  UNION ALL SELECT 'finding-downtime-' || slug, 'period-change', entity, 2, {ratio_sql('(downtime_cur - downtime_prev)', 'downtime_prev')}{name} FROM x
   WHERE downtime_prev > 0 AND ABS(downtime_cur - downtime_prev) * 10 >= downtime_prev AND ABS(downtime_cur - downtime_prev) * 20 >= prior AND rows_cur >= 20 AND rows_prev >= 20)"""


FINDINGS = _findings_sql("trading")
BOTH_FINDINGS = _findings_sql("trading", "weekdays")


def trading_days(fact: DataFrame) -> DataFrame:
    """The calendar of a business that reports on the days it trades."""
    return fact.select("date").distinct()


def figures_and_each(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Figures of both periods, and for each calendar the findings that complete periods allow."""
    fact = cut_lineage(fact_by_order(spark, folder, TWO_MONTHS))
    figs = B.figures(fact, NOW, BEFORE)
    calendars = {"trading": trading_days(fact), "weekdays": reporting_days(spark)}
    return figs, [(name, B.entity_findings(figs, B.both_complete(fact, NOW, BEFORE, days))) for name, days in calendars.items()]


def of_each(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One result per calendar, under one another and named."""
    return reduce(DataFrame.unionByName, [part.withColumn("calendar", F.lit(name)) for name, part in parts])


def figures_and_findings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Figures of both periods, and the findings that complete periods allow."""
    fact = cut_lineage(fact_by_order(spark, folder, TWO_MONTHS))
    figs = B.figures(fact, NOW, BEFORE)
    return figs, B.entity_findings(figs, B.both_complete(fact, NOW, BEFORE, trading_days(fact)))


@query("entity_findings", "E6 E7 A13", f"WITH {_findings_sql('trading', 'weekdays')} SELECT * FROM found")
def entity_findings(spark, folder):
    """Under the days of trade the periods are complete; under a calendar of weekdays one day without orders withholds everything."""
    _, each = figures_and_each(spark, folder)
    return of_each([(name, f.select("finding_id", "kind", "entity", "class_priority", "magnitude")) for name, f in each])


@query(
    "findings_ranked",
    "T1 E8 E9 N16",
    f"""WITH {FINDINGS}, {LEDGER}, q AS (SELECT 'finding-quality' AS finding_id, 'quality' AS kind, 'all' AS entity, 3 AS class_priority, CAST(COUNT(*) AS DOUBLE) AS magnitude FROM ledger),
 d AS (SELECT 'finding-descriptive', 'descriptive', 'all', 4, CAST(0 AS DOUBLE)),
 u AS (SELECT * FROM found UNION ALL SELECT * FROM q UNION ALL SELECT * FROM d)
SELECT * FROM u ORDER BY class_priority, magnitude DESC, finding_id LIMIT 3""",
)
def findings_ranked(spark, folder):
    _, done = resolved(spark, folder)
    fact = cut_lineage(fact_by_order(spark, folder, TWO_MONTHS))
    whole = B.brief(fact, NOW, BEFORE, done, trading_days(fact))
    return B.top_findings(whole.findings).select("finding_id", "kind", "entity", "class_priority", "magnitude")


@query(
    "quality_finding",
    "E8 A8",
    f"""WITH {RESOLVED} SELECT 'finding-quality' AS finding_id, CAST(COUNT(*) AS DOUBLE) AS magnitude,
 CASE WHEN bool_or(status = 'proposed') THEN 'finding.quality.body.pending' ELSE 'finding.quality.body' END AS body,
 CASE WHEN bool_or(kind = 'missing') THEN 'limitations.missingRetained' ELSE '' END AS limitations FROM resolved HAVING COUNT(*) > 0""",
)
def quality_finding(spark, folder):
    _, done = resolved(spark, folder)
    return B.quality_findings(done).select(
        "finding_id", "magnitude", F.col("coverage_note").alias("body"), F.array_join("limitations", ",").alias("limitations")
    )


@query(
    "headline_metrics",
    "T4 K5",
    f"""WITH {BOTH_FINDINGS}, {METRICS.split(FIGS + ', ')[1]},
 top AS (SELECT *, replace(lower(entity), ' ', '-') AS s FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY calendar ORDER BY class_priority, magnitude DESC, finding_id) AS k FROM found) WHERE k <= 2),
 claim AS (SELECT calendar, s || '-' || UNNEST(CASE WHEN kind = 'divergence' THEN ['current-revenue', 'current-target', 'target-gap', 'orders-change']
   ELSE ['previous-downtime', 'current-downtime', 'downtime-change'] END) AS metric_id FROM top),
 o AS (SELECT UNNEST(['current-revenue', 'current-target', 'previous-orders', 'current-orders', 'previous-downtime', 'current-downtime', 'current-cost', 'target-gap',
   'orders-change', 'downtime-change', 'contribution', 'margin']) AS suffix, UNNEST(range(1, 13)) AS ordinal),
 lists AS (SELECT n.calendar, m.metric_id, m.entity, ROW_NUMBER() OVER (PARTITION BY n.calendar ORDER BY CASE WHEN c.metric_id IS NULL THEN 1 ELSE 0 END, m.entity, ordinal) AS place
   FROM (SELECT UNNEST(['trading', 'weekdays']) AS calendar) n CROSS JOIN metrics m JOIN o ON m.metric_id = replace(lower(m.entity), ' ', '-') || '-' || suffix
   LEFT JOIN (SELECT DISTINCT calendar, metric_id FROM claim) c ON c.metric_id = m.metric_id AND c.calendar = n.calendar)
SELECT metric_id, entity, calendar FROM lists WHERE place <= 8""",
)
def headline_metrics(spark, folder):
    """The list of each calendar; weekdays without trade withhold the findings that would lead theirs."""
    figs, each = figures_and_each(spark, folder)
    m = B.metric_frame(figs, NOW, BEFORE)
    return of_each([(name, B.headline_metrics(m, found, 8).select("metric_id", "entity")) for name, found in each])


@query(
    "evidence_subject",
    "J1 U2 E13 V4",
    f"""WITH {BOTH_FINDINGS}, {METRICS.split(FIGS + ', ')[1]}, claim AS (SELECT finding_id, calendar, replace(lower(entity), ' ', '-') || '-' || UNNEST(CASE WHEN kind = 'divergence'
   THEN ['current-revenue', 'current-target', 'target-gap', 'orders-change'] ELSE ['previous-downtime', 'current-downtime', 'downtime-change'] END) AS metric_id FROM found)
SELECT c.finding_id, c.metric_id, c.metric_id || '-proof' AS proof_id, m.status, c.calendar FROM claim c JOIN metrics m ON m.metric_id = c.metric_id""",
)
def evidence_subject(spark, folder):
    figs, each = figures_and_each(spark, folder)
    m = B.metric_frame(figs, NOW, BEFORE)
    heads, proofs = m.select("metric_id", "provenance_id", "status"), B.proof_frame(m)
    return of_each([(name, E.resolve_references(claimed, heads, proofs)[0].select("finding_id", "metric_id", "proof_id", "status")) for name, claimed in each])


@query(
    "emphasised_points",
    "T5 K8 A14",
    f"WITH {BOTH_FINDINGS} SELECT 'chart-downtime-' || replace(lower(entity), ' ', '-') AS chart_id, 'current' AS key, calendar FROM found WHERE kind = 'period-change'",
)
def emphasised_points(spark, folder):
    figs, each = figures_and_each(spark, folder)
    points = B.downtime_chart(figs)
    return of_each([(name, B.emphasised_points(points, found)) for name, found in each])


@query(
    "chart_points",
    "K8 J12 V16",
    f"""WITH {FIGS} SELECT 'chart-downtime-' || slug AS chart_id, key, value, slug || '-' || key || '-downtime' AS metric_id FROM (
  SELECT slug, 'previous' AS key, CAST(downtime_prev AS VARCHAR) AS value FROM f WHERE entity <> 'all'
  UNION ALL SELECT slug, 'current', CAST(downtime_cur AS VARCHAR) FROM f WHERE entity <> 'all')""",
)
def chart_points(spark, folder):
    return B.downtime_chart(figures(spark, folder)).select("chart_id", "key", "value", "metric_id")


@query(
    "numeric_parity",
    "V16 J12 F21",
    f"""WITH {FIGS} SELECT 'chart-' || slug AS chart_id, 'both' AS point, 1 AS pos, slug || '-current-downtime' AS metric_id, 'chart.mismatch' AS rule
 FROM f WHERE entity <> 'all' AND length(entity) % 2 = 0 UNION ALL SELECT 'chart-' || slug, 'both', 2, slug || '-nothing', 'chart.no-metric' FROM f WHERE entity <> 'all'""",
)
def numeric_parity(spark, folder):
    figs = figures(spark, folder)
    slug_ = F.regexp_replace(F.lower("entity"), " ", "-")
    off = F.when(F.length("entity") % 2 == 0, 1).otherwise(0)
    points = figs.filter("entity <> 'all'").select(
        F.concat(F.lit("chart-"), slug_).alias("chart_id"), F.lit("both").alias("point"),
        F.array(
            F.concat(F.col("downtime_prev").cast("string"), F.lit(".0")), (F.col("downtime_cur") + off).cast("string"), F.lit("1")
        ).alias("values"),
        F.array(*[F.concat(slug_, F.lit(s)) for s in ("-previous-downtime", "-current-downtime", "-nothing")]).alias("metric_ids"),
    )
    return C.chart_parity(points, B.metric_frame(figs, NOW, BEFORE))


@query(
    "axis_domains",
    "F23 A14",
    f"""WITH {PLACED}, r AS (SELECT region, CAST(MIN(price) AS DOUBLE) AS lo, CAST(MAX(price) AS DOUBLE) AS hi, CAST(COUNT(*) AS DOUBLE) AS n FROM placed GROUP BY 1)
SELECT region, LEAST(0.0, lo) AS bar_min, GREATEST(n, hi) AS bar_max, LEAST(n, lo) AS line_min, GREATEST(n, hi) AS line_max, n - n * CAST(0.1 AS DOUBLE) AS flat_min, n + n * CAST(0.1 AS DOUBLE) AS flat_max FROM r""",
)
def axis_domains(spark, folder):
    p = placed_orders(spark, folder).groupBy("region").agg(
        F.min(money_text(F.col("price")).cast("decimal(18,2)")).cast("double").alias("lo"),
        F.max(money_text(F.col("price")).cast("decimal(18,2)")).cast("double").alias("hi"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    bar = axis_domain(F.lit(True), n, n, lo, hi)
    line = axis_domain(F.lit(False), n, n, lo, hi)
    flat = axis_domain(F.lit(False), n, n, n, n)
    return p.select(
        "region", bar[0].alias("bar_min"), bar[1].alias("bar_max"), line[0].alias("line_min"), line[1].alias("line_max"),
        flat[0].alias("flat_min"), flat[1].alias("flat_max"),
    )


# --- scenarios ----------------------------------------------------------------

CHANGES = ("-0.20", "-0.075", "0", "0.08", "0.155", "0.30")
BASE = f"""{OPS}, b AS (SELECT COALESCE(region, 'all') AS region, CAST(SUM(revenue) * 100 AS BIGINT) AS revenue, CAST(SUM(cost) * 100 AS BIGINT) AS cost
  FROM ops WHERE {IN_CURRENT} GROUP BY ROLLUP(region)),
 c AS (SELECT UNNEST({list(CHANGES)}) AS cost_change),
 s AS (SELECT *, CAST(ROUND(CAST(cost AS DECIMAL(30,0)) * (1 + CAST(cost_change AS DECIMAL(4,3))), 0) AS BIGINT) AS scenario_cost FROM b, c)"""


def _baseline(spark, folder) -> DataFrame:
    now = fact_by_order(spark, folder, CURRENT)
    return now.rollup("region").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost")).withColumn(
        "region", F.coalesce("region", F.lit("all"))
    )


@query(
    "scenario_sweep",
    "C1 C4 F10 F17 J11 U1",
    f"""WITH {BASE} SELECT region, 'scenario-' || lower(region) || '-cost' || replace(replace(cost_change, '-', 'm'), '.', '') AS scenario_id, cost_change,
 {money_sql('CAST(scenario_cost AS DECIMAL(30,0)) * 0.01')} AS scenario_cost, {money_sql('CAST(revenue - scenario_cost AS DECIMAL(30,0)) * 0.01')} AS contribution,
 {ratio_sql('(revenue - scenario_cost)', 'revenue')} AS margin, {ratio_sql('(cost - scenario_cost) * 100', 'revenue')} AS margin_delta_pp, 'defined' AS status FROM s""",
)
def scenario_sweep(spark, folder):
    from tabulith.functions.text import scenario_id

    swept = SC.sweep(_baseline(spark, folder), CHANGES)
    return swept.select(
        "region", scenario_id(F.lower("region"), F.col("cost_change")).alias("scenario_id"), "cost_change",
        money_text(F.col("scenario_cost")).alias("scenario_cost"), money_text(F.col("contribution")).alias("contribution"),
        "margin", "margin_delta_pp", "status",
    )


@query(
    "scenario_chart",
    "C5 A14",
    f"""WITH {BASE}, ok AS (SELECT * FROM s WHERE revenue > cost AND revenue > 0 AND cost >= 0)
SELECT region, cost_change, 'baseline' AS point, {ratio_sql('(revenue - cost)', 'revenue')} AS value, {ratio_sql('(revenue - cost) * 3', '(revenue * 2)')} AS domain_max FROM ok
UNION ALL SELECT region, cost_change, 'scenario', {ratio_sql('(revenue - scenario_cost)', 'revenue')}, {ratio_sql('(revenue - cost) * 3', '(revenue * 2)')} FROM ok""",
)
def scenario_chart(spark, folder):
    return SC.margin_chart(SC.sweep(_baseline(spark, folder), CHANGES), ["region"])


@query(
    "scenario_unavailable",
    "C3",
    f"""WITH n AS (SELECT c_nationkey, CAST(SUM(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE c_mktsegment = 'MACHINERY') AS BIGINT) - 2000000 AS revenue,
  CAST(SUM(CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT)) FILTER (WHERE c_acctbal < 100) AS BIGINT) AS cost FROM customer GROUP BY 1)
SELECT c_nationkey, CASE WHEN revenue <= 0 OR cost < 0 THEN 'unavailable' ELSE 'defined' END AS status,
 CASE WHEN revenue <= 0 THEN 'scenario.zeroRevenue' WHEN cost < 0 THEN 'scenario.negativeCost' END AS reason FROM n""",
)
def scenario_unavailable(spark, folder):
    c = scan(spark, folder, "customer")
    cents = F.round(F.col("c_acctbal").cast("decimal(18,2)") * 100, 0).cast("long")
    base = c.groupBy("c_nationkey").agg(
        (F.sum(F.when(F.col("c_mktsegment") == "MACHINERY", cents)) - 2_000_000).alias("revenue"),
        F.sum(F.when(F.col("c_acctbal") < 100, cents)).alias("cost"),
    )
    return SC.sweep(base, ["0.08"]).select("c_nationkey", "status", "reason")


@query(
    "scenario_inputs",
    "C2 V12 F6",
    """WITH d AS (SELECT DISTINCT CAST(CAST(l_tax * 7 - l_discount * 3 AS DECIMAL(6,3)) AS VARCHAR) || CASE l_linenumber % 3 WHEN 0 THEN '5' WHEN 1 THEN '' ELSE '0' END AS change FROM lineitem
  UNION SELECT DISTINCT event_type FROM events), v AS (SELECT change, TRY_CAST(change AS DECIMAL(10,6)) AS x FROM d)
SELECT change, CASE WHEN x IS NULL OR (starts_with(change, '-') AND x = 0) THEN 'not-a-decimal' WHEN x < -0.20 OR x > 0.30 THEN 'out-of-range' WHEN x * 1000 <> FLOOR(x * 1000) THEN 'off-step' END AS problem FROM v""",
)
def scenario_inputs(spark, folder):
    li, ev = scan(spark, folder, "lineitem"), scan(spark, folder, "events")
    k = F.col("l_linenumber") % 3
    base = (F.col("l_tax") * 7 - F.col("l_discount") * 3).cast("decimal(6,3)").cast("string")
    texts = li.select(F.concat(base, F.when(k == 0, "5").when(k == 1, "").otherwise("0")).alias("change")).distinct()
    texts = texts.union(ev.select("event_type").distinct())
    return texts.select("change", SC.change_problem(F.col("change")).alias("problem"))


@query(
    "baseline_margins",
    "C4",
    f"WITH {FIGS} SELECT entity AS scope_region, slug || '-target-gap' AS metric_id FROM f",
)
def baseline_margins(spark, folder):
    m = metrics(spark, folder)
    scope = figures(spark, folder).select(
        F.lit(CURRENT[0]).alias("scope_start"), F.lit(CURRENT[1]).alias("scope_end"), F.col("entity").alias("scope_region")
    )
    return SC.baseline_margin(m, scope)


# --- result tables -------------------------------------------------------------


@query(
    "clean_table",
    "K1 K7",
    f"""WITH {CLEAN} SELECT day, priority, status, score, amount, 'Operations' AS source_sheet, source_row, 'S0:R' || source_row AS record_id FROM clean""",
)
def clean_table(spark, folder):
    sheet, done = resolved(spark, folder)
    return K.clean_table(N.apply_approvals(sheet, done), sheet.ids, "Operations", guard=True)


@query(
    "published_clean",
    "K1 K9 V11",
    f"""WITH {CLEAN} SELECT source_row, TRY_CAST(CASE WHEN contains(day, '/') THEN NULL ELSE day END AS DATE) AS day, CASE WHEN contains(day, '/') THEN day END AS day__text, priority, status,
 CASE WHEN regexp_matches(score, '^[0-9]+$') THEN CAST(score AS BIGINT) END AS score, CASE WHEN NOT regexp_matches(score, '^[0-9]+$') THEN score END AS score__text,
 CAST(CAST(amount AS DECIMAL(38,1)) AS VARCHAR) AS amount, CAST(NULL AS VARCHAR) AS amount__text, 1 AS versions FROM clean""",
)
def published_clean(spark, folder):
    """Clean rows with typed columns, published once; a bundle whose analysis is of another revision leaves no version."""
    sheet, done = resolved(spark, folder)
    clean = cut_lineage(N.apply_approvals(sheet, done).select("source_row", *sheet.ids))
    types = {"score": "integer", "amount": "decimal"}
    typed = PU.typed_clean(clean, [c.with_(type=types.get(c.id, c.type)) for c in sheet.columns])
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    identity = lambda revision: spark.createDataFrame([("orders", revision)], "table_id string, revision string")
    names = ("table_id", "revision")
    PU.publish({"clean": typed}, path, identity("r1"), identity("r1"), names)
    try:
        PU.publish({"clean": typed.limit(1)}, path, identity("r1"), identity("r0"), names)
    except K.StaleBundle:
        pass
    versions = PU.manifest(spark, path).select("version").distinct().count()
    return PU.read_published(spark, path, "clean").withColumn("amount", F.col("amount").cast("string")).withColumn("versions", F.lit(versions))


@query(
    "ledger_table",
    "K2",
    f"""WITH {RESOLVED} SELECT ROW_NUMBER() OVER (ORDER BY source_row, issue_id) AS issue, kind, source_row, COALESCE(field, '') AS field, COALESCE(original, '') AS original,
 COALESCE(normalized, '') AS normalized, status, action, approval FROM resolved""",
)
def ledger_table(spark, folder):
    _, done = resolved(spark, folder)
    return K.ledger_table(done)


@query(
    "figures_table",
    "K3",
    f"""WITH {METRICS} SELECT metric_id, value, unit, eligible_rows || '/' || eligible_rows AS coverage, CAST(NULL AS VARCHAR) AS exact_note FROM metrics WHERE unit <> 'ratio'""",
)
def figures_table(spark, folder):
    return K.figures_table(metrics(spark, folder)).filter("unit <> 'ratio'")


@query(
    "method_table",
    "K4 F15",
    """WITH p AS (SELECT o_orderpriority AS selection_id, o_orderkey + 2 AS source_row FROM orders),
 i AS (SELECT *, source_row - ROW_NUMBER() OVER (PARTITION BY selection_id ORDER BY source_row) AS g FROM p),
 s AS (SELECT selection_id, MIN(source_row) AS a, MAX(source_row) AS b FROM i GROUP BY selection_id, g),
 t AS (SELECT selection_id, a // 65536 AS chunk, string_agg(CASE WHEN a = b THEN 'R' || a ELSE 'R' || a || '-R' || b END, ',' ORDER BY a) AS spans FROM s GROUP BY 1, 2),
 n AS (SELECT selection_id, COUNT(*) AS n FROM p GROUP BY 1)
SELECT 'count-' || n.selection_id AS proof_id, '{"op":"count-rows","selection_id":"' || n.selection_id || '"}' AS expression, CAST(n.n AS VARCHAR) AS result, chunk, spans
FROM n JOIN t ON t.selection_id = n.selection_id""",
)
def method_table(spark, folder):
    rows = scan(spark, folder, "orders").select(F.col("o_orderpriority").alias("selection_id"), (F.col("o_orderkey") + 2).alias("source_row"))
    spans = S.to_spans(rows, "source_row", ["selection_id"], distinct=False)
    proofs = rows.groupBy("selection_id").agg(F.count(F.lit(1)).cast("string").alias("result")).select(
        F.concat(F.lit("count-"), "selection_id").alias("proof_id"), "selection_id", "result", F.lit(None).cast("string").alias("reason"),
        F.concat(F.lit('{"op":"count-rows","selection_id":"'), "selection_id", F.lit('"}')).alias("expression"),
    )
    return K.method_table(proofs, spans)


@query(
    "summary_headlines",
    "K5",
    f"""WITH {METRICS} SELECT metric_id, unit FROM metrics WHERE metric_id IN ('all-current-revenue', 'all-current-cost', 'all-contribution', 'all-margin')""",
)
def summary_headlines(spark, folder):
    preferred = ("all-current-revenue", "all-current-cost", "all-contribution", "all-margin")
    return K.headline_table(metrics(spark, folder), preferred).select("metric_id", "unit")


@query(
    "recomputed_sums",
    "K6 V16",
    f"""WITH {OPS} SELECT {money_sql("SUM(revenue)")} AS value, 'ASIA' AS region FROM ops WHERE region = 'ASIA' AND {IN_CURRENT}
 UNION ALL SELECT {money_sql("SUM(revenue)")}, 'all' FROM ops WHERE {IN_CURRENT}""",
)
def recomputed_sums(spark, folder):
    from tabulith.sources.tables import fact_lines

    lines = fact_lines(spark, folder)
    value = F.col("revenue").cast("decimal(20,0)")
    parts = [
        K.recomputed_sum(lines, value, region, "1998-06-01", "1998-07-01").select(
            money_text(F.col("value")).alias("value"), F.lit(region or "all").alias("region")
        )
        for region in ("ASIA", None)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "text_sink_guard",
    "K7 S18",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' || left(text, 10) WHEN doc_id % 4 = 1 THEN '12345678901234567' WHEN doc_id % 4 = 2 THEN '-5' ELSE text END AS v FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(v, '^[\\t\\r ]*[=+\\-@]') THEN '''' || v ELSE v END AS guarded, CASE WHEN doc_id % 4 = 2 THEN FALSE ELSE TRUE END AS stays_text FROM t""".replace("\\\\", "\\"),
)
def text_sink_guard(spark, folder):
    from tabulith.functions.text import guard_formula

    d = scan(spark, folder, "documents")
    k = F.col("doc_id") % 4
    v = F.when(k == 0, F.concat(F.lit("="), F.substring("text", 1, 10))).when(k == 1, "12345678901234567").when(k == 2, "-5").otherwise(F.col("text"))
    return d.select("doc_id", v.alias("v")).select(
        "doc_id", guard_formula(F.col("v")).alias("guarded"), K.stays_text(F.col("v")).alias("stays_text")
    )


@query(
    "finding_caveats",
    "E10",
    f"WITH {FINDINGS} SELECT finding_id, 'limitations.noCausality' AS message_key, 'info' AS tone FROM found",
)
def finding_caveats(spark, folder):
    return E.subject_caveats(figures_and_findings(spark, folder)[1])


@query(
    "metric_caveats",
    "E10 A6",
    f"""WITH {PLACED}, m AS (SELECT site, COUNT(*) FILTER (WHERE date = DATE '1998-06-02') AS cur, COUNT(*) FILTER (WHERE date = DATE '1998-06-01') AS prev FROM placed GROUP BY 1)
SELECT site AS metric_id, 'metric.notComputable' AS message_key, 'warning' AS tone FROM m WHERE prev = 0 UNION ALL SELECT site, 'limitations.cache', 'info' FROM m WHERE cur > 0""",
)
def metric_caveats(spark, folder):
    day = lambda d: F.count_if(F.col("date") == F.lit(d).cast("date"))
    m = placed_orders(spark, folder).groupBy(F.col("site").alias("metric_id")).agg(
        day("1998-06-02").alias("cur"), day("1998-06-01").alias("prev")
    )
    none = F.array().cast("array<string>")
    return E.metric_caveats(
        m.select(
            "metric_id", F.when(F.col("prev") == 0, "undefined").otherwise("defined").alias("status"),
            F.when(F.col("prev") == 0, "metric.notComputable").alias("reason"),
            F.when(F.col("cur") > 0, F.array(F.lit("limitations.cache"))).otherwise(none).alias("warnings"),
        )
    )
