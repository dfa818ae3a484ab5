"""Spans, selections, evidence and recomputed proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import evidence as E
from tabulith.operators import expressions as X
from tabulith.operators import ledger as L
from tabulith.operators import normalize as N
from tabulith.operators import spans as S
from tabulith.operators.ordinals import with_ordinal
from tabulith.operators.proofs import evaluate_proofs, proof_rows
from tabulith.queries.quality import CLEAN, LEDGER, RESOLVED, resolved, typed_messy_sheet
from tabulith.queries.registry import long_division_sql, query, ratio_sql
from tabulith.session import cut_lineage
from tabulith.sources.tables import scan


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").select((F.col("event_id") + 2).alias("source_row"), "event_type", "user_id")


def event_spans(spark: SparkSession, folder: str) -> DataFrame:
    return S.to_spans(event_rows(spark, folder), "source_row", ["event_type"], distinct=False)


SPANS = """ev AS (SELECT event_id + 2 AS source_row, event_type FROM events),
 isl AS (SELECT *, source_row - ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY source_row) AS g FROM ev),
 sp AS (SELECT event_type, MIN(source_row) AS "start", MAX(source_row) AS "end" FROM isl GROUP BY event_type, g)"""


@query("row_spans", "W5 E3", f'WITH {SPANS} SELECT event_type, "start", "end" FROM sp')
def row_spans(spark, folder):
    return event_spans(spark, folder)


@query(
    "row_spans_whole",
    "W5",
    """WITH r AS (SELECT DISTINCT l_orderkey + 2 AS source_row FROM lineitem),
 i AS (SELECT source_row, source_row - ROW_NUMBER() OVER (ORDER BY source_row) AS g FROM r)
SELECT MIN(source_row) AS "start", MAX(source_row) AS "end" FROM i GROUP BY g""",
)
def row_spans_whole(spark, folder):
    rows = scan(spark, folder, "lineitem").select((F.col("l_orderkey") + 2).alias("source_row"))
    return S.to_spans(rows, "source_row")


@query(
    "span_expand",
    "W6 U2",
    "SELECT event_type, COUNT(*) AS rows, CAST(SUM(event_id + 2) AS BIGINT) AS row_sum FROM events GROUP BY 1",
)
def span_expand(spark, folder):
    return S.expand_spans(event_spans(spark, folder)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("source_row").alias("row_sum")
    )


@query(
    "span_guard",
    "W6",
    "SELECT event_type, 'span-overflow' AS reason FROM events GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / 5 FROM events)",
)
def span_guard(spark, folder):
    spans = event_spans(spark, folder)
    fifth = scan(spark, folder, "events").count() // 5
    return S.oversized(spans, ["event_type"], fifth)


BROKEN = f"""{SPANS}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY "start") AS ordinal FROM sp),
 b AS (SELECT event_type, ordinal, CASE WHEN ordinal % 61 = 0 THEN "end" + 1 ELSE "start" END AS s,
   CASE WHEN ordinal % 61 = 0 THEN "start" WHEN ordinal % 40 = 0 THEN "end" + 3 ELSE "end" END AS e FROM o),
 p AS (SELECT *, LAG(s) OVER w AS ps, LAG(e) OVER w AS pe FROM b WINDOW w AS (PARTITION BY event_type ORDER BY ordinal))"""


@query(
    "span_check",
    "W8 V5 V6",
    f"""WITH {BROKEN} SELECT event_type, 'span.inverted' AS rule, s AS "start" FROM p WHERE s > e
 UNION ALL SELECT event_type, 'span.unsorted', s FROM p WHERE s < ps UNION ALL SELECT event_type, 'span.overlap', s FROM p WHERE s <= pe
 UNION ALL SELECT event_type, 'span.adjacent', s FROM p WHERE s = pe + 1
 UNION ALL SELECT d.event_type, 'span.row-count', NULL FROM (SELECT event_type, SUM(e - s + 1) AS n FROM p GROUP BY 1) d
   JOIN (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) c ON c.event_type = d.event_type WHERE c.n <> d.n""",
)
def span_check(spark, folder):
    o = with_ordinal(event_spans(spark, folder), "start", ["event_type"])
    flip, wide = F.col("ordinal") % 61 == 0, F.col("ordinal") % 40 == 0
    broken = o.select(
        "event_type", "ordinal",
        F.when(flip, F.col("end") + 1).otherwise(F.col("start")).alias("start"),
        F.when(flip, F.col("start")).when(wide, F.col("end") + 3).otherwise(F.col("end")).alias("end"),
    )
    declared = event_rows(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"))
    return S.check_spans(broken, declared, "event_type")


@query(
    "span_tokens",
    "F15",
    f"""WITH {SPANS}, r AS (SELECT *, CASE WHEN "start" = "end" THEN 'R' || "start" ELSE 'R' || "start" || '-R' || "end" END AS t,
   ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY "start") AS n FROM sp)
SELECT event_type, string_agg(t, ' · ' ORDER BY n) FILTER (WHERE n <= 3) AS tokens, GREATEST(COUNT(*) - 3, 0) AS more FROM r GROUP BY 1""",
)
def span_tokens(spark, folder):
    return S.first_tokens(event_spans(spark, folder), "event_type", 3)


# --- evidence -----------------------------------------------------------------


@query(
    "evidence_page",
    "T3 J5",
    """WITH c AS (SELECT event_id + 2 AS source_row, user_id, ROW_NUMBER() OVER (ORDER BY event_id) AS n, COUNT(*) OVER () AS total
  FROM events WHERE event_type = 'view')
SELECT source_row, user_id, total, CASE WHEN 500 < total THEN 500 END AS next_offset FROM c WHERE n BETWEEN 301 AND 500""",
)
def evidence_page(spark, folder):
    views = event_rows(spark, folder).filter("event_type = 'view'")
    index = E.selection_index(S.to_spans(views, "source_row", distinct=False))
    rows = scan(spark, folder, "events").select("event_id", "user_id")
    return E.evidence_page(rows, index, 300, 200, "event_id", shift=2)


@query(
    "evidence_page_present",
    "T3 J5 E4",
    """WITH c AS (SELECT event_type, event_id + 2 AS source_row, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS n, COUNT(*) OVER (PARTITION BY event_type) AS total
  FROM events WHERE event_id % 10 <> 3)
SELECT event_type, "start", "end", first FROM (SELECT event_type, MIN(source_row) AS "start", MAX(source_row) AS "end", MIN(n) AS first
  FROM (SELECT *, source_row - ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY source_row) AS g FROM c) GROUP BY event_type, g)""",
)
def evidence_page_present(spark, folder):
    """The directories of all selections at once, over a table that lost every tenth row."""
    kept = event_rows(spark, folder).filter((F.col("source_row") - 2) % 10 != 3)
    return E.selection_index(event_spans(spark, folder), ["event_type"], S.to_spans(kept, "source_row", distinct=False))


@query(
    "evidence_rows",
    "E5 J6 N13",
    f"""WITH {RESOLVED}, t AS (SELECT source_row, string_agg(issue_id, ',' ORDER BY issue_id) AS transforms,
   '{{' || COALESCE(string_agg('"' || field || '":"' || replace(original, '/', '/') || '"', ',' ORDER BY field) FILTER (WHERE field IS NOT NULL AND original IS NOT NULL), '') || '}}' AS original_values
   FROM resolved GROUP BY 1)
SELECT t.source_row, transforms, original_values FROM t WHERE t.source_row NOT IN (SELECT source_row FROM ledger WHERE kind = 'duplicate')""",
)
def evidence_rows(spark, folder):
    sheet, done = resolved(spark, folder)
    rows = N.apply_approvals(sheet, done).select("source_row")
    touched = E.evidence_rows(rows, done).filter(F.col("transforms").isNotNull())
    return touched.select("source_row", F.array_join("transforms", ",").alias("transforms"), "original_values")


@query(
    "issues_by_cell",
    "J6",
    f"""WITH {LEDGER} SELECT source_row, field, string_agg(issue_id, ',' ORDER BY issue_id) AS issues FROM ledger WHERE field IS NOT NULL GROUP BY 1, 2""",
)
def issues_by_cell(spark, folder):
    cells = E.issues_by_cell(L.quality_ledger(typed_messy_sheet(spark, folder)))
    return cells.select("source_row", "field", F.array_join("issues", ",").alias("issues"))


def _status_spans(spark, folder) -> DataFrame:
    rows = scan(spark, folder, "orders").select((F.col("o_orderkey") + 2).alias("source_row"), F.col("o_orderstatus").alias("selection_id"))
    return S.to_spans(rows, "source_row", ["selection_id"], distinct=False)


@query(
    "issues_in_selection",
    "J4 J5 E10",
    f"""WITH {RESOLVED} SELECT o_orderstatus AS selection_id, kind, r.status, COUNT(*) AS issues FROM resolved r JOIN orders ON o_orderkey + 2 = r.source_row GROUP BY 1, 2, 3""",
)
def issues_in_selection(spark, folder):
    _, done = resolved(spark, folder)
    inside = E.issues_in_selection(done, _status_spans(spark, folder))
    return inside.groupBy("selection_id", "kind", "status").agg(F.count(F.lit(1)).alias("issues"))


@query(
    "selection_caveats",
    "E10 J4",
    f"""WITH {RESOLVED}, f AS (SELECT o_orderstatus AS selection_id, bool_or(kind IN ('missing', 'malformed')) AS m FROM resolved r JOIN orders ON o_orderkey + 2 = r.source_row
  WHERE r.status IN ('unresolved', 'proposed') GROUP BY 1)
SELECT selection_id, CASE WHEN m THEN 'limitations.missingRetained' ELSE 'quality.unresolved' END AS message_key FROM f""",
)
def selection_caveats(spark, folder):
    _, done = resolved(spark, folder)
    return E.selection_caveats(done, _status_spans(spark, folder), "selection_id")


@query(
    "excluded_contributors",
    "J4 E3",
    f"""WITH {LEDGER} SELECT issue_id, l.source_row, canonical_row FROM ledger l JOIN orders ON o_orderkey + 2 = canonical_row WHERE kind = 'duplicate' AND o_orderstatus = 'F'""",
)
def excluded_contributors(spark, folder):
    sheet, done = resolved(spark, folder)
    selected = sheet.rows.filter("status = 'F'").select("source_row")
    return E.excluded_contributors(done, selected).select("issue_id", "source_row", "canonical_row")


@query(
    "selection_build",
    "E3 W5 A2",
    """WITH c AS (SELECT o_orderkey + 2 AS source_row FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'),
 i AS (SELECT source_row, source_row - ROW_NUMBER() OVER (ORDER BY source_row) AS g FROM c),
 s AS (SELECT MIN(source_row) AS "start", MAX(source_row) AS "end" FROM i GROUP BY g)
SELECT 'urgent-open' AS selection_id, "start", "end", (SELECT COUNT(*) FROM c) AS row_count, 'amount' AS field FROM s""",
)
def selection_build(spark, folder):
    orders = scan(spark, folder, "orders").withColumn("source_row", F.col("o_orderkey") + 2)
    wanted = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    head, spans = E.build_selection(orders, wanted, "urgent-open", "amount")
    return spans.withColumn("row_count", head.select("row_count").scalar()).withColumn("field", F.lit("amount"))


@query(
    "selection_absent_rows",
    "E4 J3 T6 V6",
    """WITH m AS (SELECT event_type AS selection_id, event_id + 2 AS source_row, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS n
  FROM events WHERE event_id % 10 = 3)
SELECT selection_id, COUNT(*) AS absent, string_agg(CAST(source_row AS VARCHAR), ', ' ORDER BY source_row) FILTER (WHERE n <= 5) AS examples FROM m GROUP BY 1""",
)
def selection_absent_rows(spark, folder):
    kept = event_rows(spark, folder).filter((F.col("source_row") - 2) % 10 != 3)
    spans = event_spans(spark, folder).withColumnRenamed("event_type", "selection_id")
    return E.absent_sample(kept, spans, "selection_id")


@query(
    "distinct_on_first",
    "U2",
    """WITH r AS (SELECT user_id, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id, event_type, value FROM r WHERE n = 1""",
)
def distinct_on_first(spark, folder):
    events = scan(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    return L.distinct_on(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


# --- proofs -------------------------------------------------------------------


def _proof_parts(spark, folder):
    """Cells, selections and definitions of a small proof graph over orders."""
    sheet, done = resolved(spark, folder)
    rows = cut_lineage(N.apply_approvals(sheet, done).select("source_row", "status", "amount", "score"))
    half = rows.filter(F.col("amount").rlike(r"^[0-9]+\.50\z") & F.col("score").rlike(r"^[0-9]+\z"))
    spans = S.to_spans(
        half.select("source_row", F.concat(F.lit("rows-"), F.col("status")).alias("selection_id")), "source_row", ["selection_id"], distinct=False
    ).unionByName(
        S.to_spans(rows.filter("status = 'P'").select("source_row"), "source_row", distinct=False).withColumn("selection_id", F.lit("rows-any"))
    )
    definitions = {
        "open-amount": X.total("rows-O", "amount"),
        "done-amount": X.total("rows-F", "amount"),
        "open-score": X.total("rows-O", "score"),
        "open-rows": {"op": "count-rows", "selection_id": "rows-O"},
        "gap": X.binary("divide", X.binary("subtract", X.metric("open-amount"), X.metric("done-amount")), X.metric("done-amount")),
        "per-row": X.binary("divide", X.metric("open-score"), X.metric("open-rows")),
        "scaled": X.binary("multiply", X.metric("open-amount"), X.binary("add", X.literal("1"), X.literal("0.08"))),
        "by-zero": X.binary("divide", X.metric("open-amount"), X.literal("0")),
        "loop": X.metric("loop-back"),
        "loop-back": X.metric("loop"),
        "lost": X.total("rows-unknown", "amount"),
        "dangling": X.metric("never-declared"),
        "not-decimal": X.total("rows-any", "score"),
        "odd-literal": X.literal("1e3"),
        "missing-cells": {"op": "count-issues", "set_id": "missing"},
        "repeated-ids": {"op": "count-issues", "set_id": "repeated"},
    }
    members = done.filter("kind = 'missing'").select(F.lit("missing").alias("set_id"), "issue_id")
    twice = done.filter("kind = 'ambiguous-date'").select(F.lit("repeated").alias("set_id"), "issue_id")
    counts = X.issue_set_counts(members.unionByName(twice).unionByName(twice), done)
    leaves = X.selection_leaves(rows, spans, ["amount", "score"])
    return definitions, leaves, counts


def _evaluated(spark, folder) -> DataFrame:
    definitions, leaves, counts = _proof_parts(spark, folder)
    stated = spark.createDataFrame([(k, f"{k}-proof", "defined") for k in definitions], "metric_id string, provenance_id string, status string")
    return evaluate_proofs(stated, proof_rows(spark, {f"{k}-proof": v for k, v in definitions.items()}), cut_lineage(leaves), counts)


PROOF = f"""{CLEAN}, h AS (SELECT * FROM clean WHERE regexp_matches(amount, '^[0-9]+\\.50$') AND regexp_matches(score, '^[0-9]+$')),
 s AS (SELECT SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE status = 'O') AS o, SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE status = 'F') AS f,
   SUM(CAST(score AS BIGINT)) FILTER (WHERE status = 'O') AS sc, COUNT(*) FILTER (WHERE status = 'O') AS n FROM h),
 c AS (SELECT COUNT(*) AS missing FROM ledger WHERE kind = 'missing'),
 fmt AS (SELECT *, CASE WHEN o = FLOOR(o) THEN CAST(CAST(o AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(o AS VARCHAR), '0') END AS ot,
   CASE WHEN f = FLOOR(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(f AS VARCHAR), '0') END AS ft FROM s, c)"""


@query(
    "proof_recompute",
    "E1 E2 F5 V10 E11",
    f"""WITH {PROOF}, nd AS (SELECT 'gap' AS id, CAST((o - f) * 10 AS HUGEINT) AS n, CAST(f * 10 AS HUGEINT) AS d FROM s UNION ALL SELECT 'per-row', CAST(sc AS HUGEINT), CAST(n AS HUGEINT) FROM s),
 {long_division_sql()} SELECT id AS metric_id, value, NULL AS reason FROM out UNION ALL SELECT 'open-amount', ot, NULL FROM fmt UNION ALL SELECT 'done-amount', ft, NULL FROM fmt
 UNION ALL SELECT 'open-score', CAST(sc AS VARCHAR), NULL FROM fmt UNION ALL SELECT 'open-rows', CAST(n AS VARCHAR), NULL FROM fmt
 UNION ALL SELECT 'scaled', rtrim(rtrim(CAST(CAST(o * 1.08 AS DECIMAL(30,4)) AS VARCHAR), '0'), '.'), NULL FROM fmt
 UNION ALL SELECT 'by-zero', NULL, 'divideByZero' UNION ALL SELECT 'loop', NULL, 'metric.cycle' UNION ALL SELECT 'loop-back', NULL, 'metric.cycle'
 UNION ALL SELECT 'lost', NULL, 'selection.missing' UNION ALL SELECT 'dangling', NULL, 'metric.missing' UNION ALL SELECT 'not-decimal', NULL, 'operand.notDecimal'
 UNION ALL SELECT 'odd-literal', NULL, 'literal.invalid' UNION ALL SELECT 'missing-cells', CAST(missing AS VARCHAR), NULL FROM fmt
 UNION ALL SELECT 'repeated-ids', NULL, 'issueIds.duplicate'""",
)
def proof_recompute(spark, folder):
    return _evaluated(spark, folder)


@query(
    "proof_ratios",
    "E1 E2 F5",
    f"""WITH {PROOF} SELECT 'gap' AS metric_id, {ratio_sql('(o - f) * 10', 'f * 10')} AS ratio FROM fmt
 UNION ALL SELECT 'per-row', {ratio_sql('sc', 'n')} FROM fmt""",
)
def proof_ratios(spark, folder):
    r = _evaluated(spark, folder).filter(F.col("metric_id").isin("gap", "per-row"))
    # The recomputed value carries 40 digits; six are compared here.
    return r.select("metric_id", F.round(F.col("value").cast("decimal(38,30)"), 6).cast("double").alias("ratio"))
