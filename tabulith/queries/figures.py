"""Figures in any number, the rows behind them, and proofs that are evaluated as a graph."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import expressions as X
from tabulith.operators import figures as G
from tabulith.operators import normalize as N
from tabulith.operators import proofs as P
from tabulith.operators import spans as S
from tabulith.operators.figures import SumSpec
from tabulith.operators.scope import Scope
from tabulith.plans import briefing as B
from tabulith.plans import generic
from tabulith.queries.briefing import METRICS, TWO_MONTHS, metrics
from tabulith.queries.provenance import event_rows
from tabulith.queries.quality import CLEAN, resolved
from tabulith.queries.registry import CURRENT, IN_CURRENT, IN_PREVIOUS, PLACED, PREVIOUS, long_division_sql, query
from tabulith.queries.totals import BEFORE, NOW, TEXT_ORDERS, _scope_specs, _text_orders
from tabulith.session import cut_lineage
from tabulith.sources.tables import fact_by_order, money_text, scan
from tabulith.table import ColumnInfo, Sheet

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FIRST_DAY, WINDOWS = datetime.date(1996, 1, 1), 50


def _window_specs() -> list[SumSpec]:
    """500 figures: two fields, five regions, 50 overlapping windows of four weeks."""
    out = []
    for w in range(WINDOWS):
        start = FIRST_DAY + datetime.timedelta(days=14 * w)
        days = (start.isoformat(), (start + datetime.timedelta(days=27)).isoformat())
        for r in REGIONS:
            scope = Scope(*days, regions=(r,))
            out += [SumSpec(f"{r}|{w}|amount", "amount", scope, ("score",)), SumSpec(f"{r}|{w}|score", "score", scope)]
    return out


@query(
    "many_figures",
    "P2 P3 A1 A2",
    f"""WITH {TEXT_ORDERS}, w AS (SELECT UNNEST(range(0, {WINDOWS})) AS w),
 x AS (SELECT r.r_name || '|' || w || '|' AS id, u.* FROM w CROSS JOIN region r LEFT JOIN u ON u.region = r.r_name
   AND date BETWEEN DATE '{FIRST_DAY}' + CAST(14 * w AS INTEGER) AND DATE '{FIRST_DAY}' + CAST(14 * w + 27 AS INTEGER)),
 g AS (SELECT id, SUM(a) FILTER (WHERE s IS NOT NULL) AS a, COUNT(a) FILTER (WHERE s IS NOT NULL) AS na, COALESCE(MAX(sc) FILTER (WHERE a IS NOT NULL AND s IS NOT NULL), 0) AS sc,
   SUM(s) AS s, COUNT(s) AS ns, COUNT(source_row) AS n FROM x GROUP BY 1)
SELECT id || 'amount' AS metric_id, CASE WHEN sc = 2 THEN CAST(CAST(COALESCE(a, 0) AS DECIMAL(38,2)) AS VARCHAR) ELSE CAST(CAST(COALESCE(a, 0) AS BIGINT) AS VARCHAR) END AS value,
 na AS eligible_rows, n AS total_rows, CAST(sc AS INTEGER) AS scale FROM g
UNION ALL SELECT id || 'score', CAST(CAST(COALESCE(s, 0) AS BIGINT) AS VARCHAR), ns, n, 0 FROM g""",
)
def many_figures(spark, folder):
    return G.scoped_sums(_text_orders(spark, folder), _window_specs(), F.col("date"), F.col("region"))


# --- interval sets -----------------------------------------------------------

_ISLANDS = 'SELECT {k}, MIN(source_row) AS "start", MAX(source_row) AS "end" FROM (SELECT {k}, source_row, source_row - ROW_NUMBER() OVER (PARTITION BY {k} ORDER BY source_row) AS g FROM {t}) GROUP BY {k}, g'


@query(
    "span_algebra",
    "W5 W6 E3",
    f"""WITH ev AS (SELECT event_id + 2 AS source_row, event_type, user_id FROM events),
 few AS (SELECT * FROM ev WHERE user_id % 3 <> 0), late AS (SELECT * FROM ev WHERE source_row % 7 < 4),
 m AS (SELECT event_type || '|union' AS k, source_row FROM few UNION SELECT event_type || '|union', source_row FROM late
  UNION ALL SELECT event_type || '|intersect', source_row FROM few WHERE source_row % 7 < 4
  UNION ALL SELECT event_type || '|difference', source_row FROM few WHERE source_row % 7 >= 4)
{_ISLANDS.format(k='k', t='m')}""",
)
def span_algebra(spark, folder):
    rows = event_rows(spark, folder)
    few = cut_lineage(S.to_spans(rows.filter("user_id % 3 <> 0"), "source_row", ["event_type"], distinct=False))
    late = cut_lineage(S.to_spans(rows.filter("source_row % 7 < 4"), "source_row", ["event_type"], distinct=False))
    out = None
    for op in ("union", "intersect", "difference"):
        part = S.combine(few, late, ["event_type"], op).select(F.concat("event_type", F.lit(f"|{op}")).alias("k"), "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


# --- selections --------------------------------------------------------------

_SCOPED = (
    ("m-asia-current", f"{IN_CURRENT} AND region = 'ASIA' AND a IS NOT NULL AND s IS NOT NULL"),
    ("m-asia-previous", f"{IN_PREVIOUS} AND region = 'ASIA' AND a IS NOT NULL"),
    ("m-two-regions", f"{IN_CURRENT} AND region IN ('ASIA', 'EUROPE') AND a IS NOT NULL AND s IS NOT NULL"),
    ("m-current", f"{IN_CURRENT} AND a IS NOT NULL"),
    ("m-all", "a IS NOT NULL AND s IS NOT NULL"),
)


@query(
    "figure_selections",
    "E3 A2 W5",
    f"WITH {TEXT_ORDERS}, m AS ("
    + " UNION ALL ".join(f"SELECT '{i}-rows' AS selection_id, source_row FROM u WHERE {test}" for i, test in _SCOPED)
    + f") {_ISLANDS.format(k='selection_id', t='m')}",
)
def figure_selections(spark, folder):
    spans = G.selection_spans(_text_orders(spark, folder), _scope_specs("m"), F.col("date"), F.col("region"))
    return spans.select("selection_id", "start", "end")


CLEAN_STATES = ("F", "O", "P")


def _clean_evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, G.Evidence]:
    """The normalized sheet of messy orders with one amount and one score figure a status."""
    sheet, done = resolved(spark, folder)
    done = cut_lineage(done)
    rows = cut_lineage(N.apply_approvals(sheet, done).select("source_row", "status", "amount", "score"))
    specs = [SumSpec(f"{s}-{f}", f, Scope(regions=(s,)), ("amount",)) for s in CLEAN_STATES for f in ("amount", "score")]
    return rows, G.evidence_of(rows, specs, None, F.col("status"), done)


_EVIDENCE = f"""{CLEAN}, n AS (SELECT *, CASE WHEN regexp_matches(amount, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?$') THEN amount END AS a,
   CASE WHEN regexp_matches(score, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?$') THEN score END AS s FROM clean),
 m AS (SELECT status || '-amount-rows' AS selection_id, source_row FROM n WHERE a IS NOT NULL UNION ALL SELECT status || '-score-rows', source_row FROM n WHERE a IS NOT NULL AND s IS NOT NULL),
 sp AS ({_ISLANDS.format(k='selection_id', t='m')}),
 c AS (SELECT selection_id, COUNT(*) AS spans, CAST(SUM("end" - "start" + 1) AS BIGINT) AS row_count FROM sp GROUP BY 1),
 ex AS (SELECT selection_id, COUNT(DISTINCT l.source_row) AS excluded_rows FROM ledger l JOIN m ON m.source_row = l.canonical_row WHERE l.kind = 'duplicate' GROUP BY 1)"""


@query(
    "figure_evidence",
    "A2 E3 E13",
    f"""WITH {_EVIDENCE} SELECT selection_id, spans, row_count, COALESCE(excluded_rows, 0) AS excluded_rows, row_count AS eligible_rows,
 (SELECT COUNT(*) FROM n WHERE n.status = split_part(selection_id, '-', 1)) AS total_rows, 0 AS warnings FROM c LEFT JOIN ex USING (selection_id)""",
)
def figure_evidence(spark, folder):
    _, e = _clean_evidence(spark, folder)
    heads = G.selection_heads(e).join(e.proofs.select("selection_id", F.col("proof_id").alias("provenance_id")), "selection_id")
    return heads.join(e.figures, "provenance_id").select("selection_id", "spans", "row_count", "excluded_rows", "eligible_rows", "total_rows", F.size("warnings").alias("warnings"))


@query(
    "excluded_rows",
    "E3 A2 J4",
    f"WITH {_EVIDENCE} SELECT DISTINCT selection_id, 'S0:R' || l.source_row AS row_id FROM ledger l JOIN m ON m.source_row = l.canonical_row WHERE l.kind = 'duplicate'",
)
def excluded_rows(spark, folder):
    return _clean_evidence(spark, folder)[1].excluded


@query(
    "selection_checks",
    "V6 V5 E3",
    f"""WITH {_EVIDENCE}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY selection_id) AS k FROM c),
 gone AS (SELECT selection_id, COUNT(*) AS n, MIN(source_row) AS first FROM m WHERE source_row % 50 = 9 GROUP BY 1),
 inside AS (SELECT selection_id, COUNT(*) AS n FROM m WHERE source_row % 500 = 8 GROUP BY 1)
SELECT selection_id, 'selection.sourceRef' AS rule, 'other.csv' AS detail FROM o WHERE k = 1
UNION ALL SELECT selection_id, 'selection.fieldId', 'remark' FROM o WHERE k = 2
UNION ALL SELECT selection_id, 'selection.rowCount', CAST(row_count AS VARCHAR) FROM o WHERE k = 3
UNION ALL SELECT selection_id, 'selection.row.missing', n || ' from ' || first FROM gone
UNION ALL SELECT selection_id, 'selection.exclusion.contributing', CAST(n AS VARCHAR) FROM inside
UNION ALL SELECT selection_id, 'selection.exclusion.id', 'S9:R1' FROM o WHERE k = 4""",
)
def selection_checks(spark, folder):
    """Planted: a foreign source, an unknown field, a wrong count, lost rows, excluded rows that count."""
    rows, e = _clean_evidence(spark, folder)
    spans = cut_lineage(e.spans)
    k = {f"{s}-{f}-rows": i + 1 for i, (s, f) in enumerate((s, f) for s in CLEAN_STATES for f in ("amount", "score"))}
    nth = F.create_map(*[F.lit(x) for pair in k.items() for x in pair])[F.col("selection_id")]
    heads = S.span_summary(spans, ["selection_id"]).select(
        "selection_id", F.when(nth == 1, "other.csv").otherwise("orders.csv").alias("source_ref"), F.when(nth == 2, "remark").otherwise("amount").alias("field"),
        F.when(nth == 3, F.col("row_count") + 1).otherwise(F.col("row_count")).alias("row_count"),
    )
    planted = spans.select("selection_id").distinct().join(
        rows.filter("source_row % 500 = 8").select(F.concat(F.lit("S0:R"), "source_row").alias("row_id"), F.col("status")),
        F.substring("selection_id", 1, 1) == F.col("status"),
    ).select("selection_id", "row_id")
    planted = planted.unionByName(spark.createDataFrame([(sorted(k)[3], "S9:R1")], "selection_id string, row_id string"))
    sources = spark.createDataFrame([("orders.csv",)], "source_ref string")
    fields = spark.createDataFrame([("amount",), ("score",)], "field string")
    return G.selection_violations(heads, spans, rows.filter("source_row % 50 <> 9"), sources, fields, e.excluded.unionByName(planted))


@query(
    "selection_lookup",
    "E13",
    "SELECT event_type || '-rows' AS selection_id, event_type || '-proof' AS proof_id, NULL AS error FROM events GROUP BY event_type UNION ALL SELECT 'never-rows', NULL, 'unknown-selection'",
)
def selection_lookup(spark, folder):
    kinds = scan(spark, folder, "events").select("event_type").distinct()
    proofs = kinds.select(F.concat("event_type", F.lit("-proof")).alias("proof_id"), F.concat("event_type", F.lit("-rows")).alias("selection_id"))
    wanted = proofs.select("selection_id").unionByName(spark.createDataFrame([("never-rows",)], "selection_id string"))
    return G.require_selections(wanted, proofs)


_ANALYSED = f"""{TEXT_ORDERS}, g AS (SELECT * FROM u WHERE {IN_CURRENT} AND region IN ('ASIA', 'EUROPE'))"""
_PACKS = {"operations": ("date", "region", "revenue", "target"), "orders": ("date", "region", "amount", "cost")}


def _analysed(spark: SparkSession, folder: str) -> tuple[Sheet, generic.Generic]:
    """Messy orders, declared as a reviewer would: one additive measure that has a label, one that has none, one not confirmed."""
    rows = _text_orders(spark, folder).withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn("other", F.col("score"))
    columns = (
        ColumnInfo("date", "date", 1, "date", "date", confirmed=True), ColumnInfo("region", "region", 2, confirmed=True), ColumnInfo("site", "site", 3, confirmed=True),
        ColumnInfo("amount", "amount", 4, "mixed", "measure", additive=True, confirmed=True), ColumnInfo("score", "score", 5, "integer", "measure", additive=True, confirmed=True),
        ColumnInfo("other", "other", 6, "integer", "measure", additive=True, confirmed=False),
    )
    sheet = Sheet(rows, columns)
    copies = spark.createDataFrame([("duplicate", "resolved", 9, 10**9, None), ("formula-cache", "resolved", None, 4, "amount")], "kind string, status string, canonical_row long, source_row long, field string")
    return sheet, generic.analyse(sheet, Scope(*CURRENT, regions=("ASIA", "EUROPE")), _PACKS, ["metric.amount", "metric.other"], copies)


@query(
    "generic_analysis",
    "E9 A3 P4 P17 P19 A2",
    f"""WITH {_ANALYSED} SELECT 'total-amount' AS metric_id, CASE WHEN MAX(sc) FILTER (WHERE a IS NOT NULL) = 2 THEN CAST(CAST(SUM(a) AS DECIMAL(38,2)) AS VARCHAR) ELSE CAST(CAST(COALESCE(SUM(a), 0) AS BIGINT) AS VARCHAR) END AS value,
 COUNT(a) AS eligible_rows, COUNT(*) AS total_rows, 'limitations.cache' AS warnings, CAST(NULL AS VARCHAR) AS pack, 'operations:revenue,target;orders:cost' AS lacking FROM g""",
)
def generic_analysis(spark, folder):
    _, done = _analysed(spark, folder)
    lacking = ";".join(f"{k}:{','.join(v)}" for k, v in done.lacking.items())
    return done.evidence.figures.select(
        "metric_id", "value", "eligible_rows", "total_rows", F.array_join("warnings", ",").alias("warnings"), F.lit(done.pack).cast("string").alias("pack"), F.lit(lacking).alias("lacking")
    )


@query("generic_rows", "P4 P20 P1", f"WITH {_ANALYSED} SELECT source_row, amount, region FROM g")
def generic_rows(spark, folder):
    sheet, done = _analysed(spark, folder)
    return generic.shown_rows(done, sheet, ("amount", "region", "no-such-column"))


# --- the proof graph ---------------------------------------------------------

DEPTH = 30


def _graph() -> dict[str, dict]:
    """Every figure doubles the one below it, so the graph shares all of its nodes; then what cannot be evaluated."""
    graph = {"d0": X.total("F-score-rows", "score")}
    graph |= {f"d{i}": X.binary("add", X.metric(f"d{i - 1}"), X.metric(f"d{i - 1}")) for i in range(1, DEPTH + 1)}
    return graph | {
        "round-a": X.binary("add", X.metric("round-b"), X.literal("1")), "round-b": X.binary("multiply", X.literal("2"), X.metric("round-a")),
        "behind": X.binary("subtract", X.metric("d0"), X.metric("round-a")), "lost-first": X.binary("add", X.total("lost", "amount"), X.metric("round-a")),
        "by-zero": X.binary("divide", X.metric("d0"), X.binary("subtract", X.metric("d1"), X.metric("d1"))), "after-zero": X.binary("add", X.metric("by-zero"), X.metric("lost-first")),
        "stranger": X.metric("nobody"), "no-field": X.total("F-amount-rows", "remark"), "rows": {"op": "count-rows", "selection_id": "O-score-rows"},
        "needs-sibling": X.binary("add", X.metric("sibling"), X.literal("1")), "on-undefined": X.metric("withheld"), "odd": X.literal("01"),
    }


@query(
    "proof_graph",
    "E1 E2 F5",
    f"""WITH {_EVIDENCE}, b AS (SELECT CAST(SUM(CAST(s AS BIGINT)) AS HUGEINT) AS v FROM n WHERE status = 'F' AND a IS NOT NULL AND s IS NOT NULL),
 r AS (SELECT COUNT(*) AS n FROM n WHERE status = 'O' AND a IS NOT NULL AND s IS NOT NULL)
SELECT 'd' || i AS metric_id, CAST(v * (1 << i) AS VARCHAR) AS value, NULL AS reason FROM b, (SELECT CAST(UNNEST(range(0, {DEPTH + 1})) AS BIGINT) AS i)
UNION ALL SELECT 'rows', CAST(n AS VARCHAR), NULL FROM r
UNION ALL SELECT UNNEST(['round-a', 'round-b', 'behind', 'lost-first', 'by-zero', 'after-zero', 'stranger', 'no-field', 'needs-sibling', 'sibling', 'on-undefined', 'withheld', 'odd']), NULL,
 UNNEST(['metric.cycle', 'metric.cycle', 'metric.cycle', 'selection.missing', 'divideByZero', 'divideByZero', 'metric.missing', 'fieldId.missing', 'proof.missing', 'proof.missing', 'metric.undefined', 'metric.undefined', 'literal.invalid'])""",
)
def proof_graph(spark, folder):
    rows, e = _clean_evidence(spark, folder)
    graph = _graph()
    stated = [(k, f"{k}-proof", "defined") for k in graph] + [("sibling", "sibling-proof", "defined"), ("withheld", "withheld-proof", "undefined")]
    figures = spark.createDataFrame(stated, "metric_id string, provenance_id string, status string")
    return P.evaluate_proofs(figures, P.proof_rows(spark, {f"{k}-proof": v for k, v in graph.items()}), G.selection_values(rows, e))


# --- the briefing, taken apart and added up again -----------------------------


def _briefing_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The fact of two months as text rows."""
    fact = fact_by_order(spark, folder, TWO_MONTHS)
    texts = [money_text(F.col(m)).alias(m) for m in B.MONEY] + [F.col(m).cast("string").alias(m) for m in B.COUNTS]
    return cut_lineage(fact.select("source_row", "date", "region", *texts))


def _briefing_specs(entities: list[str]) -> list[SumSpec]:
    sums = (("current-revenue", "revenue"), ("current-target", "target"), ("previous-orders", "orders"), ("current-orders", "orders"), ("previous-downtime", "downtime"), ("current-downtime", "downtime"), ("current-cost", "cost"))
    scope = lambda e, p: Scope((NOW if p == "current" else BEFORE).start, (NOW if p == "current" else BEFORE).end, () if e == B.WHOLE else (e,))
    return [SumSpec(f"{e.lower().replace(' ', '-')}-{s}", f, scope(e, s.split("-")[0])) for e in entities for s, f in sums]


def briefing_evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, G.Evidence]:
    rows = _briefing_rows(spark, folder)
    entities = [B.WHOLE, *sorted(r.region for r in rows.select("region").distinct().collect())]
    nothing = spark.createDataFrame([], "kind string, status string, canonical_row long, source_row long, field string")
    return rows, G.evidence_of(rows, _briefing_specs(entities), F.col("date"), F.col("region"), nothing)


def _recomputed(spark: SparkSession, folder: str, change=None) -> tuple[DataFrame, DataFrame]:
    """Stated figures of the briefing, and all of them evaluated again from the rows that their selections name."""
    rows, e = briefing_evidence(spark, folder)
    stated = cut_lineage(metrics(spark, folder).select("metric_id", "value", "status", "provenance_id", "expression", "reason", "entity", "unit"))
    again = P.evaluate_proofs(stated, B.proof_frame(stated), G.selection_values(rows if change is None else change(rows), e))
    return stated, again


_PLAIN = "CASE WHEN contains(value, '.') THEN rtrim(rtrim(value, '0'), '.') ELSE value END"


@query(
    "briefing_recomputed",
    "E2 E3 V10 A5 A6 A7",
    f"""WITH {METRICS}, nd AS (
  SELECT slug || '-target-gap' AS id, CAST(revenue_cur - target_cur AS HUGEINT) AS n, CAST(target_cur AS HUGEINT) AS d FROM f WHERE target_cur > 0
  UNION ALL SELECT slug || '-orders-change', orders_cur - orders_prev, orders_prev FROM f WHERE orders_prev > 0
  UNION ALL SELECT slug || '-downtime-change', downtime_cur - downtime_prev, downtime_prev FROM f WHERE downtime_prev > 0
  UNION ALL SELECT slug || '-margin', revenue_cur - cost_cur, revenue_cur FROM f WHERE revenue_cur > 0),
 {long_division_sql()} SELECT id AS metric_id, value, NULL AS reason FROM out
UNION ALL SELECT metric_id, {_PLAIN}, NULL FROM metrics WHERE unit <> 'ratio'""",
)
def briefing_recomputed(spark, folder):
    return _recomputed(spark, folder)[1]


_BRIEF = f"""{PLACED}, p AS (SELECT source_row, lower(replace(region, ' ', '-')) AS slug, CASE WHEN {IN_CURRENT} THEN 'current' WHEN {IN_PREVIOUS} THEN 'previous' END AS period
   FROM placed WHERE ({IN_CURRENT} OR {IN_PREVIOUS}) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 q AS (SELECT source_row, UNNEST(['all', slug]) AS slug, period FROM p),
 s AS (SELECT UNNEST(['current-revenue', 'current-target', 'previous-orders', 'current-orders', 'previous-downtime', 'current-downtime', 'current-cost']) AS suffix),
 m AS (SELECT slug || '-' || suffix || '-rows' AS selection_id, source_row FROM q JOIN s ON split_part(suffix, '-', 1) = period)"""


@query("briefing_selections", "E3 A2 W5", f"WITH {_BRIEF} {_ISLANDS.format(k='selection_id', t='m')}")
def briefing_selections(spark, folder):
    return briefing_evidence(spark, folder)[1].spans.select("selection_id", "start", "end")


@query(
    "proof_arithmetic",
    "V10 E2 F21",
    f"""WITH {_BRIEF}, hit AS (SELECT DISTINCT slug FROM q WHERE source_row % 20 = 7 AND period = 'current'),
 lost AS (SELECT DISTINCT slug FROM q WHERE source_row % 50 = 11 AND period = 'previous')
SELECT slug || '-' || UNNEST(['current-revenue', 'target-gap', 'contribution', 'margin']) AS metric_id, 'metric.value.mismatch' AS rule, '' AS reason FROM hit
UNION ALL SELECT slug || '-' || UNNEST(['previous-orders', 'previous-downtime', 'orders-change', 'downtime-change']), 'metric.evaluate', 'row.missing' FROM lost""",
)
def proof_arithmetic(spark, folder):
    """Rows that changed or went after the figures were stated: every figure that rests on them is told."""

    def change(rows: DataFrame) -> DataFrame:
        hit = (F.col("source_row") % 20 == 7) & F.col("date").between(*[F.lit(d).cast("date") for d in CURRENT])
        lost = (F.col("source_row") % 50 == 11) & F.col("date").between(*[F.lit(d).cast("date") for d in PREVIOUS])
        return rows.withColumn("revenue", F.when(hit, F.concat("revenue", F.lit("5"))).otherwise(F.col("revenue"))).filter(~lost)

    return P.arithmetic_violations(*_recomputed(spark, folder, change))
