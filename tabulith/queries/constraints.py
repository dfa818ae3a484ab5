"""Constraint checks, reconciliations and set comparisons as violation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulith.functions.text import row_id
from tabulith.operators import checks as C
from tabulith.operators import expressions as X
from tabulith.operators import ledger as L
from tabulith.operators import normalize as N
from tabulith.plans import briefing as B
from tabulith.queries.briefing import FIGS, figures, metrics
from tabulith.queries.quality import CLEAN, LEDGER, RESOLVED, resolved, typed_messy_sheet
from tabulith.queries.registry import OPS, money_sql, query
from tabulith.sources.tables import fact_by_order, money_text, scan
from tabulith.table import ColumnInfo

# --- V: validation jobs -------------------------------------------------------


@query(
    "unique_checks",
    "V1 S17",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def unique_checks(spark, folder):
    return C.repeated_ids(scan(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "status_triples",
    "V2",
    """WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'defined' ELSE 'undefined' END AS status,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '1e5' ELSE CAST(event_id AS VARCHAR) END AS value,
  CASE WHEN event_id % 3 = 0 THEN 'why' WHEN event_id % 11 = 0 THEN '' END AS reason FROM events)
SELECT 'status.defined.value' AS rule, CAST(event_id AS VARCHAR) AS object_id FROM m WHERE status = 'defined' AND (value IS NULL OR value = '1e5')
UNION ALL SELECT 'status.defined.reason', CAST(event_id AS VARCHAR) FROM m WHERE status = 'defined' AND reason IS NOT NULL
UNION ALL SELECT 'status.undefined.value', CAST(event_id AS VARCHAR) FROM m WHERE status = 'undefined' AND value IS NOT NULL
UNION ALL SELECT 'status.undefined.reason', CAST(event_id AS VARCHAR) FROM m WHERE status = 'undefined' AND COALESCE(reason, '') = ''""",
)
def status_triples(spark, folder):
    k = F.col("event_id")
    m = scan(spark, folder, "events").select(
        "event_id",
        F.when(k % 2 == 0, "defined").otherwise("undefined").alias("status"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "1e5").otherwise(k.cast("string")).alias("value"),
        F.when(k % 3 == 0, "why").when(k % 11 == 0, "").alias("reason"),
    )
    return C.status_triple(m, "event_id")


@query(
    "scope_checks",
    "V3 F7",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 8 = 0 THEN '2001-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE strftime(o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER) - 1), '%Y-%m-%d') END AS b FROM orders)
SELECT 'scope.period.half' AS rule, CAST(o_orderkey AS VARCHAR) AS object_id FROM s WHERE (a IS NULL) <> (b IS NULL)
UNION ALL SELECT 'scope.period.date', CAST(o_orderkey AS VARCHAR) FROM s WHERE a = '2001-02-30' AND b IS NOT NULL
UNION ALL SELECT 'scope.period.order', CAST(o_orderkey AS VARCHAR) FROM s WHERE a <> '2001-02-30' AND a > b""",
)
def scope_checks(spark, folder):
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    s = scan(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 9 == 0, F.lit(None)).when(k % 8 == 0, "2001-02-30").otherwise(day.cast("string")).alias("a"),
        F.when(k % 6 != 0, F.date_add(day, (k % 5 - 1).cast("int")).cast("string")).alias("b"),
    )
    return C.scope_dates(s, "o_orderkey", "a", "b")


@query(
    "referential_checks",
    "V4 J3 U3",
    """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0), c AS (SELECT * FROM customer WHERE c_custkey % 9 <> 0)
SELECT 'line.order' AS rule, CAST(l_orderkey AS VARCHAR) AS object_id, COUNT(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY 2
UNION ALL SELECT 'order.customer', CAST(o_custkey AS VARCHAR), COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c) GROUP BY 2
UNION ALL SELECT 'label.document', CAST(doc_id AS VARCHAR), COUNT(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY 2""",
)
def referential_checks(spark, folder):
    orders, customer = scan(spark, folder, "orders"), scan(spark, folder, "customer")
    parts = [
        C.dangling(scan(spark, folder, "lineitem"), "l_orderkey", orders.filter("o_orderkey % 10 <> 0"), "o_orderkey", "line.order"),
        C.dangling(orders, "o_custkey", customer.filter("c_custkey % 9 <> 0"), "c_custkey", "order.customer"),
        C.dangling(scan(spark, folder, "labels"), "doc_id", scan(spark, folder, "documents"), "doc_id", "label.document"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "expression_references",
    "V4 E11 E13",
    f"""WITH {FIGS} SELECT slug || '-contribution-proof' AS proof_id, 'metric' AS operand, slug || '-current-cost' AS value FROM f
 UNION ALL SELECT slug || '-current-target-proof', 'selection', slug || '-current-target-rows' FROM f""",
)
def expression_references(spark, folder):
    m = metrics(spark, folder)
    proofs = B.proof_frame(m)
    declared = m.filter("metric_id not like '%-current-cost'")
    selections = proofs.filter("selection_id is not null and selection_id not like '%current-target-rows'")
    return X.dangling_references(proofs, declared, selections.select("selection_id"))


@query(
    "cell_checks",
    "V7 F1 F3 F4",
    f"""WITH {CLEAN} SELECT 'cell.date' AS rule, CAST(source_row AS VARCHAR) AS object_id, 'day' AS field FROM clean WHERE contains(day, '/')
 UNION ALL SELECT 'cell.nullable', CAST(source_row AS VARCHAR), 'score' FROM clean WHERE score IS NULL
 UNION ALL SELECT 'cell.decimal', CAST(source_row AS VARCHAR), 'score' FROM clean WHERE score = 'n/a'
 UNION ALL SELECT 'cell.significantDigits', CAST(source_row AS VARCHAR), 'amount' FROM clean WHERE length(replace(amount, '.', '')) > 30
 UNION ALL SELECT 'cell.integer', CAST(source_row AS VARCHAR), 'amount' FROM clean WHERE contains(amount, '.')
 UNION ALL SELECT 'cell.type', CAST(source_row AS VARCHAR), 'status' FROM clean""",
)
def cell_checks(spark, folder):
    sheet, done = resolved(spark, folder)
    rows = N.apply_approvals(sheet, done)
    declared = [
        ColumnInfo("day", "day", 1, "date"), ColumnInfo("score", "score", 4, "integer", nullable=False),
        ColumnInfo("amount", "amount", 5, "integer"), ColumnInfo("status", "status", 3, "boolean"),
        ColumnInfo("priority", "priority", 2, "text"),
    ]
    return C.cell_values(rows, declared)


@query(
    "table_checks",
    "V8 F16 V15",
    f"""WITH {LEDGER}, d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT 'row.id.binding' AS rule, 'S1:R' || source_row AS object_id FROM messy WHERE source_row % 50 = 0 AND source_row % 3 <> 0
UNION ALL SELECT 'row.sourceRow.range', CASE WHEN source_row % 50 = 0 THEN 'S1:R' ELSE 'S0:R' END || source_row FROM messy
  WHERE (source_row > 10000 OR source_row = 77) AND source_row % 3 <> 0
UNION ALL SELECT 'issue.fieldId', issue_id FROM ledger WHERE field = 'amount'
UNION ALL SELECT 'issue.canonicalRow', issue_id FROM ledger WHERE kind = 'duplicate' AND canonical_row % 3 = 0
UNION ALL SELECT 'calendar.unique', date FROM d WHERE n > 1 UNION ALL SELECT 'grain.column', 'site'""",
)
def table_checks(spark, folder):
    sheet = typed_messy_sheet(spark, folder)
    k = F.col("source_row")
    ids = row_id(F.when(k % 50 == 0, "S1").otherwise("S0"), k)
    rows = sheet.rows.select(ids.alias("row_id"), "source_row")
    calendar = scan(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    # Every third row is gone, so some kept copies of duplicates are missing.
    return C.table_internals(
        rows.filter(k % 3 != 0), L.quality_ledger(sheet), "S0", 77, 2, 10000, ["day", "priority", "status", "score"],
        ["day", "site"], calendar,
    )


@query(
    "summary_reconciled",
    "V9",
    f"""WITH {RESOLVED}, k AS (SELECT COUNT(*) AS raw FROM messy)
SELECT 'qualitySummary.raw_rows' AS rule, 'raw_rows' AS object_id, CAST(raw + 1 AS VARCHAR) AS claimed, CAST(raw AS VARCHAR) AS expected FROM k
UNION ALL SELECT 'qualitySummary.resolved', 'resolved', '0', CAST(COUNT(*) FILTER (WHERE status = 'resolved') AS VARCHAR) FROM resolved""",
)
def summary_reconciled(spark, folder):
    sheet, done = resolved(spark, folder)
    expected = L.quality_summary(N.apply_approvals(sheet, done), done)
    claimed = expected.withColumn("raw_rows", F.col("raw_rows") + 1).withColumn("resolved", F.lit(0))
    return C.one_row_equal(claimed, expected, "qualitySummary")


@query(
    "source_range_checks",
    "V15",
    """WITH s AS (SELECT o_custkey AS id, MIN(o_orderkey) AS first_row, MAX(o_orderkey) AS last_row, 5 AS first_column, COUNT(*) AS last_column, MIN(o_orderkey) + COUNT(*) AS header_row FROM orders GROUP BY 1)
SELECT 'range.order' AS rule, CAST(id AS VARCHAR) AS object_id FROM s WHERE first_row > last_row OR first_column > last_column
UNION ALL SELECT 'range.headerRow', CAST(id AS VARCHAR) FROM s WHERE header_row NOT BETWEEN first_row AND last_row""",
)
def source_range_checks(spark, folder):
    s = scan(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"), F.lit(5).alias("first_column"),
        F.count(F.lit(1)).alias("last_column"), (F.min("o_orderkey") + F.count(F.lit(1))).alias("header_row"),
    )
    return C.source_ranges(s, "id")


@query(
    "unit_checks",
    "V14 F22",
    """WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'count' ELSE 'currency' END AS kind,
  CASE s_suppkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'ZZZ' WHEN 3 THEN 'usd' END AS currency FROM supplier)
SELECT 'unit.currency.missing' AS rule, CAST(s_suppkey AS VARCHAR) AS object_id FROM m WHERE kind = 'currency' AND currency IS NULL
UNION ALL SELECT 'unit.currency.unsupported', CAST(s_suppkey AS VARCHAR) FROM m WHERE kind = 'currency' AND currency IN ('ZZZ', 'usd')""",
)
def unit_checks(spark, folder):
    from tabulith.sources.currencies import currencies

    k = F.col("s_suppkey") % 5
    m = scan(spark, folder, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "count").otherwise("currency").alias("unit_kind"),
        F.when(k == 0, "USD").when(k == 1, "EUR").when(k == 2, "ZZZ").when(k == 3, "usd").alias("currency"),
    )
    return C.units(m, "s_suppkey", currencies(spark))


@query(
    "label_checks",
    "V17",
    """WITH l AS (SELECT p_brand || '/' || p_type AS label, p_size FROM part)
SELECT DISTINCT label FROM l WHERE label NOT IN (SELECT label FROM l WHERE p_size > 46)""",
)
def label_checks(spark, folder):
    parts = scan(spark, folder, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("used"), "p_size")
    declared = parts.filter("p_size > 46").select(F.col("used").alias("label")).distinct()
    return C.undeclared_labels(parts, "used", declared)


@query(
    "manifest_checks",
    "V18",
    """WITH m AS (SELECT c_nationkey AS id, COUNT(*) AS raw_records, COUNT(*) + (c_nationkey % 3) - 1 AS clean_records, COUNT(*) FILTER (WHERE c_acctbal < 0) AS duplicates,
  c_nationkey % 2 AS categories, 1 AS missing, COUNT(*) FILTER (WHERE c_acctbal < 0) + 1 AS issues, COUNT(*) FILTER (WHERE c_acctbal < 0) AS resolved, c_nationkey % 4 AS unresolved FROM customer GROUP BY 1)
SELECT 'manifest.records' AS rule, CAST(id AS VARCHAR) AS object_id FROM m WHERE clean_records > raw_records
UNION ALL SELECT 'manifest.issueCount', CAST(id AS VARCHAR) FROM m WHERE issues <> duplicates + categories + missing
UNION ALL SELECT 'manifest.qualityStatus', CAST(id AS VARCHAR) FROM m WHERE resolved + unresolved <> issues""",
)
def manifest_checks(spark, folder):
    n, low = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") < 0)
    m = scan(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        n.alias("raw_records"), low.alias("duplicates")
    )
    full = m.select(
        "id", "raw_records", (F.col("raw_records") + F.col("id") % 3 - 1).alias("clean_records"), "duplicates",
        (F.col("id") % 2).alias("categories"), F.lit(1).alias("missing"), (F.col("duplicates") + 1).alias("issues"),
        F.col("duplicates").alias("resolved"), (F.col("id") % 4).alias("unresolved"),
    )
    return C.manifest(full, "id")


@query(
    "hash_binding",
    "V22 S1",
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN doc_id % 7 = 0 THEN 'hash.undeclared' ELSE 'hash.mismatch' END AS rule
FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 5 = 0 AND doc_id % 7 <> 0)""",
)
def hash_binding(spark, folder):
    from tabulith.sources.landing import audit, files_from_text

    docs = scan(spark, folder, "documents")
    landed = audit(files_from_text(docs, "doc_id", "text"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    declared = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("file_id"), F.sha2(text, 256).alias("sha256"))
    return C.hash_binding(landed, declared, "file_id")


@query(
    "dataset_oracle",
    "V19 A15 A16",
    f"""WITH {OPS}, m AS (SELECT strftime(date, '%Y-%m') AS period, COUNT(DISTINCT date) AS days, COUNT(*) AS rows, COUNT(*) FILTER (WHERE cost > revenue) AS above,
   MAX(downtime) AS peak FROM ops GROUP BY 1)
SELECT period, days, rows, above, peak, above = 0 AS subset_holds FROM m""",
)
def dataset_oracle(spark, folder):
    from tabulith.functions.dates import month_key
    from tabulith.sources.tables import fact_lines

    lines = fact_lines(spark, folder).withColumn("period", month_key(F.col("date")))
    # Per day first, so that counting days never gathers a month's rows.
    daily = lines.groupBy("period", "date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cost") > F.col("revenue")).alias("above"), F.max("downtime").alias("peak")
    )
    m = daily.groupBy("period").agg(
        F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.sum("above").alias("above"), F.max("peak").alias("peak")
    )
    return m.withColumn("subset_holds", F.col("above") == 0)


# --- reconciliation and sets --------------------------------------------------


@query(
    "oracle_reconcile",
    "J10 F21",
    f"""WITH {OPS}, e AS (SELECT site, {money_sql('SUM(revenue)')} AS v FROM ops GROUP BY 1),
 c AS (SELECT site, CASE WHEN length(site) = 8 THEN v || '1' WHEN site = 'NATION_3' THEN rtrim(v, '0') || '00' ELSE v END AS v FROM e WHERE site <> 'NATION_7' UNION ALL SELECT 'ELSEWHERE', '1.00')
SELECT COALESCE(c.site, e.site) AS site, CASE WHEN e.site IS NULL THEN 'unknown-field' WHEN c.site IS NULL THEN 'missing-claim'
  WHEN CAST(c.v AS DECIMAL(38,6)) = CAST(e.v AS DECIMAL(38,6)) THEN 'match' ELSE 'mismatch' END AS status, c.v AS claimed, e.v AS expected
FROM c FULL JOIN e ON c.site = e.site""",
)
def oracle_reconcile(spark, folder):
    expected = fact_by_order(spark, folder).groupBy("site").agg(money_text(F.sum("revenue")).alias("v"))
    claim = (
        F.when(F.length("site") == 8, F.concat("v", F.lit("1")))
        .when(F.col("site") == "NATION_3", F.concat(F.regexp_replace("v", r"0+\z", ""), F.lit("00")))
        .otherwise(F.col("v"))
    )
    claimed = expected.filter("site <> 'NATION_7'").select("site", claim.alias("v"))
    extra = spark.createDataFrame([("ELSEWHERE", "1.00")], "site string, v string")
    return C.reconcile(claimed.union(extra), expected, "site", "v")


@query(
    "group_expectations",
    "A16 U3",
    """WITH a AS (SELECT o_orderstatus AS status_code, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS v FROM orders GROUP BY 1),
 e AS (SELECT status_code, CASE WHEN status_code = 'P' THEN v + 1 ELSE v END AS v FROM a WHERE status_code <> 'O' UNION ALL SELECT 'X', CAST(0 AS DECIMAL(38,2)))
SELECT COALESCE(a.status_code, e.status_code) AS status_code, CASE WHEN e.v IS NULL THEN 'undeclared' WHEN a.v IS NULL THEN 'absent' WHEN a.v = e.v THEN 'match' ELSE 'mismatch' END AS status,
 CAST(a.v AS VARCHAR) AS actual, CAST(e.v AS VARCHAR) AS expected FROM a FULL JOIN e ON a.status_code = e.status_code""",
)
def group_expectations(spark, folder):
    o = scan(spark, folder, "orders").select(F.col("o_orderstatus").alias("status_code"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = o.groupBy("status_code").agg(F.sum("v").alias("v"))
    declared = sums.filter("status_code <> 'O'").select(
        "status_code", F.when(F.col("status_code") == "P", F.col("v") + 1).otherwise(F.col("v")).cast("decimal(28,2)").cast("string").alias("declared")
    ).union(spark.createDataFrame([("X", "0.00")], "status_code string, declared string"))
    return C.group_expectations(o, ["status_code"], F.col("v"), declared, "declared")


@query(
    "set_difference",
    "U3 P17",
    "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)",
)
def set_difference(spark, folder):
    events = scan(spark, folder, "events")
    return C.undeclared_groups(events, events.filter("event_type = 'purchase' and value > 60"), "user_id")


@query(
    "set_overlap",
    "U4",
    "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'",
)
def set_overlap(spark, folder):
    events = scan(spark, folder, "events")
    return C.overlap(events.filter("event_type = 'purchase'"), events.filter("event_type = 'error'"), "user_id")


@query(
    "label_parity",
    "U5",
    """WITH r AS (SELECT 'key.' || p_partkey AS key, p_name || ' {brand} {size}' AS text FROM part WHERE p_partkey % 10 <> 0),
 c AS (SELECT 'key.' || p_partkey AS key, CASE p_partkey % 7 WHEN 0 THEN p_name || ' {size} {brand}' WHEN 1 THEN p_name || ' {size}' WHEN 2 THEN '  ' ELSE p_name || ' {brand} {size}' END AS text FROM part WHERE p_partkey % 11 <> 0)
SELECT r.key, 'missing-key' AS gap FROM r WHERE r.key NOT IN (SELECT key FROM c) UNION ALL SELECT c.key, 'extra-key' FROM c WHERE c.key NOT IN (SELECT key FROM r)
UNION ALL SELECT r.key, 'placeholder-mismatch' FROM r JOIN c ON c.key = r.key WHERE NOT (contains(c.text, '{brand}') AND contains(c.text, '{size}'))
UNION ALL SELECT r.key, 'empty-value' FROM r JOIN c ON c.key = r.key WHERE trim(c.text) = ''""",
)
def label_parity(spark, folder):
    p, k = scan(spark, folder, "part"), F.col("p_partkey")
    key = F.concat(F.lit("key."), k.cast("string")).alias("key")
    full = F.concat("p_name", F.lit(" {brand} {size}"))
    reference = p.filter(k % 10 != 0).select(key, full.alias("text"))
    other = (
        F.when(k % 7 == 0, F.concat("p_name", F.lit(" {size} {brand}"))).when(k % 7 == 1, F.concat("p_name", F.lit(" {size}"))).when(k % 7 == 2, "  ").otherwise(full)
    )
    return C.parity_of_dimensions(reference, p.filter(k % 11 != 0).select(key, other.alias("text")), "key", "text")


@query(
    "bundle_guard",
    "K9 V11 V13",
    """WITH n AS (SELECT c_nationkey AS id, sha256(CAST(SUM(c_custkey) AS VARCHAR)) AS h FROM customer GROUP BY 1)
SELECT 'snapshot.tableId' AS rule, CAST(id AS VARCHAR) AS object_id FROM n WHERE id % 5 = 0 UNION ALL SELECT 'normalizationRevision.mismatch', CAST(id AS VARCHAR) FROM n WHERE id % 4 = 0
UNION ALL SELECT 'sourceHash.mismatch', CAST(id AS VARCHAR) FROM n WHERE id % 3 = 0 UNION ALL SELECT 'export.scenarioBaseline', CAST(id AS VARCHAR) FROM n WHERE id % 2 = 1""",
)
def bundle_guard(spark, folder):
    n = scan(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.sha2(F.sum("c_custkey").cast("string"), 256).alias("source_hash")
    )
    k, name = F.col("id"), F.concat(F.lit("raw-"), F.col("id").cast("string"))
    parts = n.select(
        "id", name.alias("table_id"), F.lit("r1").alias("revision"), "source_hash",
        F.when(k % 5 == 0, "raw-old").otherwise(name).alias("snapshot_table_id"),
        F.when(k % 4 == 0, "r0").otherwise("r1").alias("snapshot_revision"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("source_hash")).alias("snapshot_source_hash"),
        F.lit("analysis").alias("analysis_id"),
        F.when(k % 2 == 1, "other").when(k % 10 == 0, "analysis").alias("baseline_id"),
    )
    return C.bundle_parts(parts, "id")


@query(
    "document_checks",
    "V21 C2",
    """WITH d AS (SELECT p_partkey AS id, p_size % 30 AS lo, 20 AS hi, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size % 3 + 1 END AS step, p_size AS dflt FROM part)
SELECT 'definition.bounds' AS rule, CAST(id AS VARCHAR) AS object_id FROM d WHERE lo > hi UNION ALL SELECT 'definition.step', CAST(id AS VARCHAR) FROM d WHERE step = 0 OR (step <> 0 AND dflt % step <> 0)""",
)
def document_checks(spark, folder):
    found = B.entity_findings(figures(spark, folder))
    odd = C.stand_alone_findings(found)
    k = F.col("p_partkey")
    d = scan(spark, folder, "part").select(
        k.alias("id"), (F.col("p_size") % 30).alias("minimum"), F.lit(20).alias("maximum"),
        F.when(k % 9 == 0, 0).otherwise(F.col("p_size") % 3 + 1).alias("step"), F.col("p_size").alias("default"),
    )
    return C.stand_alone_definitions(d, "id").unionByName(odd)


@query(
    "shape_expectations",
    "V20 S2",
    r"""WITH ln AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS at_line FROM documents),
 rec AS (SELECT doc_id, len(string_split(line, ',')) AS width, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY at_line) AS ordinal FROM ln WHERE trim(replace(line, ',', '')) <> ''),
 a AS (SELECT doc_id, COUNT(*) AS records, MAX(width) FILTER (WHERE ordinal = 1) AS header_columns, MAX(width) AS widest FROM rec GROUP BY 1),
 d AS (SELECT doc_id, doc_id % 4 + 5 AS records, 3 AS header_columns, doc_id % 6 + 4 AS widest FROM documents WHERE doc_id % 10 <> 0)
SELECT CAST(a.doc_id AS VARCHAR) AS file_id, 'shape.records' AS rule, d.records AS expected, a.records AS actual FROM a LEFT JOIN d ON d.doc_id = a.doc_id WHERE a.records IS DISTINCT FROM d.records
UNION ALL SELECT CAST(a.doc_id AS VARCHAR), 'shape.header_columns', d.header_columns, a.header_columns FROM a LEFT JOIN d ON d.doc_id = a.doc_id WHERE a.header_columns IS DISTINCT FROM d.header_columns
UNION ALL SELECT CAST(a.doc_id AS VARCHAR), 'shape.widest', d.widest, a.widest FROM a LEFT JOIN d ON d.doc_id = a.doc_id WHERE a.widest IS DISTINCT FROM d.widest""",
)
def shape_expectations(spark, folder):
    from tabulith.queries.ingest import records

    docs, k = scan(spark, folder, "documents"), F.col("doc_id")
    declared = docs.filter(k % 10 != 0).select(
        k.cast("string").alias("file_id"), (k % 4 + 5).alias("records"), F.lit(3).alias("header_columns"), (k % 6 + 4).alias("widest")
    )
    return C.file_shapes(records(spark, folder), declared)
