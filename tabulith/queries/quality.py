"""Profiles, quality ledgers, approvals and reversal over messy text sheets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.numbers import with_localized, with_percent
from tabulith.functions.text import fold_key, slug
from tabulith.operators import ledger as L
from tabulith.operators import normalize as N
from tabulith.operators import profile as P
from tabulith.operators.ordinals import systematic_sample
from tabulith.queries.registry import PLACED, query
from tabulith.session import cut_lineage
from tabulith.sources.tables import placed_orders, scan
from tabulith.table import ColumnInfo, Sheet, sheet_from_table

LONG_NUMBER = "1234567890123456789012345678901"


def messy_sheet(spark: SparkSession, folder: str) -> Sheet:
    """Orders as an untidy sheet: odd spellings, slash dates, blanks, bad numbers."""
    o = scan(spark, folder, "orders")
    k = F.col("o_orderkey")
    day = F.when(k % 97 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    p = F.col("o_orderpriority")
    priority = (
        F.when(k % 23 == 0, F.concat(F.lit(" "), F.lower(p), F.lit(" "))).when(k % 29 == 0, F.lower(p)).otherwise(p)
    )
    score = (
        F.when(k % 11 == 0, "n/a").when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "").otherwise((k % 5).cast("string"))
    )
    amount = F.when(k % 31 == 0, LONG_NUMBER).otherwise(F.concat((k % 3).cast("string"), F.lit(".50")))
    rows = o.select(
        (k + 2).alias("source_row"), day.alias("day"), priority.alias("priority"), F.col("o_orderstatus").alias("status"),
        score.alias("score"), amount.alias("amount"),
    )
    ids = ("day", "priority", "status", "score", "amount")
    return Sheet(rows, tuple(ColumnInfo(c, c, i + 1) for i, c in enumerate(ids)))


TYPES = {"day": ("date", "date"), "priority": ("text", "dimension"), "status": ("text", "dimension"),
         "score": ("mixed", "unknown"), "amount": ("decimal", "measure")}


def typed_messy_sheet(spark: SparkSession, folder: str) -> Sheet:
    """The same sheet with the confirmed column types a reviewer settled on."""
    sheet = messy_sheet(spark, folder)
    return sheet.with_columns([c.with_(type=TYPES[c.id][0], role=TYPES[c.id][1]) for c in sheet.columns])


MESSY = f"""messy AS (SELECT o_orderkey + 2 AS source_row,
  CASE WHEN o_orderkey % 97 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_orderkey % 23 = 0 THEN ' ' || lower(o_orderpriority) || ' ' WHEN o_orderkey % 29 = 0 THEN lower(o_orderpriority)
       ELSE o_orderpriority END AS priority,
  o_orderstatus AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN ''
       ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS score,
  CASE WHEN o_orderkey % 31 = 0 THEN '{LONG_NUMBER}' ELSE CAST(o_orderkey % 3 AS VARCHAR) || '.50' END AS amount
  FROM orders)"""

LEDGER = f"""{MESSY},
 dup AS (SELECT source_row, day, MIN(source_row) OVER (PARTITION BY day, priority, status, score, amount) AS canon FROM messy),
 cells AS (SELECT source_row, 1 AS pos, 'priority' AS field, priority AS text FROM messy
   UNION ALL SELECT source_row, 2, 'status', status FROM messy UNION ALL SELECT source_row, 3, 'score', score FROM messy),
 folded AS (SELECT *, FIRST_VALUE(text) OVER (PARTITION BY field, lower(trim(text)) ORDER BY source_row) AS canon
   FROM cells WHERE text <> ''),
 variants AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_row ORDER BY pos) AS nth FROM folded WHERE text <> canon),
 ledger AS (
  SELECT 'quality-duplicate-' || source_row AS issue_id, 'duplicate' AS kind, source_row, CAST(NULL AS VARCHAR) AS field, day AS original,
    CAST(NULL AS VARCHAR) AS normalized, 'exclude-row' AS action, canon AS canonical_row, 'quality.duplicate' AS message_key FROM dup WHERE source_row > canon
  UNION ALL SELECT 'quality-category-' || source_row || CASE WHEN nth = 1 THEN '' ELSE '-' || field END, 'category', source_row, field, text,
    canon, 'map-category', NULL, 'quality.category' FROM variants
  UNION ALL SELECT 'quality-missing-' || source_row, 'missing', source_row, 'score', NULL, NULL, 'none', NULL, 'quality.missing'
    FROM messy WHERE COALESCE(score, '') = ''
  UNION ALL SELECT 'quality-date-' || source_row || '-c1', 'ambiguous-date', source_row, 'day', day, NULL, 'confirm-type', NULL, 'upload.ambiguousDate'
    FROM messy WHERE contains(day, '/')
  UNION ALL SELECT 'quality-precision-' || source_row || '-c5', 'precision', source_row, 'amount', amount, amount, 'confirm-type', NULL, 'quality.proposed'
    FROM messy WHERE length(replace(amount, '.', '')) > 30
  UNION ALL SELECT 'quality-malformed-' || source_row || '-c4', 'malformed', source_row, 'score', score, score, 'none', NULL, 'quality.proposed'
    FROM messy WHERE score = 'n/a')"""

RESOLVED = f"""{LEDGER}, resolved AS (SELECT * REPLACE (source_row AS source_row),
  CASE WHEN action <> 'none' THEN 'resolved' WHEN kind = 'missing' THEN 'unresolved' ELSE 'proposed' END AS status,
  CASE WHEN action <> 'none' THEN 'user' ELSE 'none' END AS approval FROM ledger)"""

CLEAN = f"""{LEDGER}, clean AS (SELECT m.source_row, day, COALESCE(p.canon, priority) AS priority, COALESCE(s.canon, status) AS status,
  CASE WHEN score <> '' THEN score END AS score, amount
  FROM messy m LEFT JOIN variants p ON p.source_row = m.source_row AND p.field = 'priority'
  LEFT JOIN variants s ON s.source_row = m.source_row AND s.field = 'status'
  WHERE m.source_row NOT IN (SELECT source_row FROM ledger WHERE kind = 'duplicate'))"""


def resolved(spark: SparkSession, folder: str) -> tuple[Sheet, DataFrame]:
    """The sheet and its resolved ledger; review is where a ledger is materialised.

    The sheet is written in even parts first: its ledger reads it several times, and a
    compressed table of orders gives few tasks for millions of rows.
    """
    sheet = typed_messy_sheet(spark, folder)
    sheet = replace(sheet, rows=cut_lineage(sheet.rows.repartition("source_row")))
    proposals = cut_lineage(L.quality_ledger(sheet))
    return sheet, N.resolve_ledger(proposals, N.approve_actionable(proposals))


# --- profiling ---------------------------------------------------------------

NUM = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"


def _vote_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """Votes, type and role per column; ``columns`` pairs an id with its text."""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS id, {i + 1} AS source_column, {e} AS v FROM {table}" for i, (c, e) in enumerate(columns)
    )
    return f"""cells AS ({parts}),
 votes AS (SELECT id, source_column, COUNT(*) FILTER (WHERE v <> '') AS n,
   COUNT(*) FILTER (WHERE regexp_matches(trim(v), '{NUM}')) AS numeric,
   COUNT(*) FILTER (WHERE regexp_matches(trim(v), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(trim(v) AS DATE) IS NOT NULL) AS date,
   COUNT(*) FILTER (WHERE lower(trim(v)) IN ('true', 'false', 'yes', 'no', 'نعم', 'لا')) AS boolean,
   COUNT(*) FILTER (WHERE regexp_matches(trim(v), '^-?0[0-9]')) AS leading_zero,
   COUNT(*) FILTER (WHERE v <> '' AND contains(trim(v), '.')) AS point FROM cells GROUP BY 1, 2),
 typed AS (SELECT *, CASE WHEN n = 0 THEN 'text' WHEN leading_zero > 0 AND numeric / n >= 0.95 THEN 'identifier'
   WHEN date / n >= 0.98 THEN 'date' WHEN numeric / n >= 0.95 AND leading_zero = 0 AND point > 0 THEN 'decimal'
   WHEN numeric / n >= 0.95 AND leading_zero = 0 THEN 'integer' WHEN boolean / n >= 0.95 THEN 'boolean'
   WHEN numeric / n > 0.5 THEN 'mixed' ELSE 'text' END AS type FROM votes)
SELECT id, source_column, n, numeric, date, boolean, leading_zero, point, type,
 CASE WHEN type = 'date' THEN 'date' WHEN type = 'identifier' OR regexp_matches(lower(id), '(^|_)(id|key|code|site)$') THEN 'identifier'
  WHEN type IN ('integer', 'decimal') THEN 'measure' WHEN type = 'text' THEN 'dimension' ELSE 'unknown' END AS role FROM typed"""


@query(
    "type_vote",
    "P9 P10 P11 P12 F7",
    f"WITH {MESSY}, " + _vote_sql("messy", [(c, c) for c in ("day", "priority", "status", "score", "amount")]),
)
def type_vote(spark, folder):
    return P.column_profile(messy_sheet(spark, folder)).drop("label")


CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "padded", "flag")


def _customer_sheet(spark, folder) -> Sheet:
    c = scan(spark, folder, "customer")
    df = c.select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment",
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.when(F.col("c_nationkey") % 2 == 0, "yes").otherwise("No").alias("flag"),
    )
    return sheet_from_table(df.withColumn("_k", F.col("c_custkey")), "_k", CUSTOMER_COLUMNS)


@query(
    "role_proposal",
    "P9 P10",
    "WITH c AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, CASE WHEN c_nationkey % 2 = 0 THEN 'yes' ELSE 'No' END AS flag FROM customer), "
    + _vote_sql("c", [(x, f"CAST({x} AS VARCHAR)") for x in CUSTOMER_COLUMNS]),
)
def role_proposal(spark, folder):
    return P.column_profile(_customer_sheet(spark, folder)).drop("label")


@query(
    "systematic_sample",
    "P8",
    """WITH e AS (SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k,
  COUNT(*) OVER (PARTITION BY event_type) AS n FROM events),
 i AS (SELECT event_type, n, UNNEST(range(500)) AS i FROM (SELECT DISTINCT event_type, n FROM e)),
 want AS (SELECT DISTINCT event_type, CAST(floor(i * (n / CAST(500 AS DOUBLE))) AS BIGINT) AS k FROM i)
SELECT e.event_type, e.event_id FROM e LEFT JOIN want w ON w.event_type = e.event_type AND w.k = e.k WHERE e.n <= 500 OR w.k IS NOT NULL""",
)
def systematic_sample_query(spark, folder):
    events = scan(spark, folder, "events").select("event_type", "event_id")
    return systematic_sample(events, "event_id", 500, ["event_type"])


@query(
    "first_distinct_values",
    "P13",
    """WITH f AS (SELECT 'c_mktsegment' AS field, c_mktsegment AS text, MIN(c_custkey) + 2 AS first_row FROM customer GROUP BY 2
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), MIN(c_custkey) + 2 FROM customer GROUP BY 2),
 r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY field ORDER BY first_row) AS INTEGER) AS ordinal FROM f)
SELECT * FROM r WHERE ordinal <= 3""",
)
def first_distinct_values(spark, folder):
    sheet = sheet_from_table(scan(spark, folder, "customer"), "c_custkey", ("c_mktsegment", "c_nationkey"))
    return P.first_distinct_values(sheet, 3)


@query(
    "capabilities",
    "P14 P16 P18 N16",
    f"""WITH {LEDGER} SELECT TRUE AS has_date_axis, TRUE AS has_additive_measure,
 COUNT(*) FILTER (WHERE action <> 'none' AND kind <> 'category') AS open_count, COUNT(*) FILTER (WHERE kind = 'missing') AS missing_count,
 FALSE AS has_formula_cells, 0 AS cache_opt_in_count FROM ledger""",
)
def capabilities(spark, folder):
    sheet = typed_messy_sheet(spark, folder)
    columns = P.bind_currency(sheet.columns, "USD", ["amount"])
    settled = [c.with_(confirmed=c.id in ("day", "amount"), additive=c.id == "amount") for c in columns]
    proposals = L.quality_ledger(sheet)
    approved = proposals.filter("kind = 'category'").select("issue_id")
    return P.capabilities(P.columns_frame(spark, settled), proposals, P.Decisions(approved))


@query(
    "column_review",
    "P15 P16 P18 P20",
    "WITH " + MESSY + ", " + _vote_sql("messy", [(c, c) for c in ("day", "priority", "status", "score", "amount")]).replace(
        "SELECT id, source_column, n,", ", prof AS (SELECT id, source_column, n,", 1
    ) + """) SELECT id, CASE WHEN id = 'score' THEN 'decimal' ELSE type END AS type, id <> 'score' AS pending,
 CASE WHEN id = 'score' THEN 'none' WHEN type = 'date' THEN 'date' WHEN type IN ('decimal', 'integer', 'mixed') THEN 'number' ELSE 'none' END AS hint,
 CASE WHEN id = 'amount' THEN 'USD' END AS currency FROM prof""",
)
def column_review(spark, folder):
    sheet = messy_sheet(spark, folder)
    proposed = P.proposed_columns(sheet, P.column_profile(sheet))
    overrides = {"score": sheet.column("score").with_(type="decimal", confirmed=True)}
    settled = P.bind_currency(P.effective(proposed, overrides), "USD", ["amount"])
    waiting = {c.id for c in P.pending(proposed, overrides)}
    frame = P.ambiguity(P.columns_frame(spark, settled))
    return frame.select("id", "type", F.col("id").isin(*waiting).alias("pending"), "hint", "currency")


@query(
    "column_slug",
    "F13 P6 F11",
    r"""WITH s AS (SELECT part.p_partkey, p_brand || ' ' || p_type AS label FROM part),
 b AS (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM s)
SELECT slug, COUNT(*) AS uses, MIN(p_partkey) AS first_row FROM b GROUP BY 1""",
)
def column_slug(spark, folder):
    p = scan(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("label"))
    return p.groupBy(slug(F.col("label")).alias("slug")).agg(
        F.count(F.lit(1)).alias("uses"), F.min("p_partkey").alias("first_row")
    )


# --- ledger ------------------------------------------------------------------

ISSUE = "issue_id, kind, source_row, field, original, normalized, action, canonical_row, message_key"


HEADER_CELLS = ("Day", "priority", "", "STATUS", "Priority", "day")


@query(
    "quality_ledger",
    "N1 N2 N3 N4 N5 N6 N8 P7 P11 W1 F4",
    f"""WITH {LEDGER} SELECT {ISSUE} FROM ledger
UNION ALL SELECT 'quality-header-3', 'header', 1, 'column_c', '', 'Column C', 'confirm-type', NULL, 'quality.proposed'
UNION ALL SELECT 'quality-header-ambiguous-5', 'header', 1, 'priority__2', 'Priority', NULL, 'confirm-type', NULL, 'quality.proposed'
UNION ALL SELECT 'quality-header-ambiguous-6', 'header', 1, 'day__2', 'day', NULL, 'confirm-type', NULL, 'quality.proposed'""",
)
def quality_ledger(spark, folder):
    """The sheet under a header row with a blank cell and two labels that differ only in case from earlier ones."""
    cells = spark.createDataFrame([(i, text) for i, text in enumerate(HEADER_CELLS, 1)], "column int, raw string")
    headers = P.column_ids(P.read_headers(cells.withColumn("table", F.lit(1)), ["table"]), ["table"])
    return L.quality_ledger(typed_messy_sheet(spark, folder), headers).drop("status", "approval")


@query(
    "duplicate_documents",
    "N1 W1",
    """WITH d AS (SELECT doc_id + 2 AS source_row, MIN(doc_id + 2) OVER (PARTITION BY text, lang, source) AS canonical_row FROM documents)
SELECT 'quality-duplicate-' || source_row AS issue_id, source_row, canonical_row FROM d WHERE source_row > canonical_row""",
)
def duplicate_documents(spark, folder):
    sheet = sheet_from_table(scan(spark, folder, "documents"), "doc_id", ("text", "lang", "source"))
    return L.duplicate_rows(sheet).select("issue_id", "source_row", "canonical_row")


@query(
    "duplicate_hot_rows",
    "N1 W1",
    """WITH d AS (SELECT event_id + 2 AS source_row, MIN(event_id + 2) OVER (PARTITION BY event_type) AS canonical_row FROM events)
SELECT canonical_row, COUNT(*) AS copies, MAX(source_row) AS last_copy FROM d WHERE source_row > canonical_row GROUP BY 1""",
)
def duplicate_hot_rows(spark, folder):
    sheet = sheet_from_table(scan(spark, folder, "events"), "event_id", ("event_type",))
    return L.duplicate_rows(sheet).groupBy("canonical_row").agg(
        F.count(F.lit(1)).alias("copies"), F.max("source_row").alias("last_copy")
    )


@query(
    "category_spellings",
    "N2 N9 F11 W1",
    """WITH s AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN upper(role) WHEN (conv_id + turn) % 7 = 0 THEN chr(160) || role || ' ' ELSE role END AS text,
   (conv_id * 1000 + turn) AS source_row FROM conversations),
 g AS (SELECT text, MIN(source_row) AS first_row, COUNT(*) AS n, lower(trim(replace(text, chr(160), ' '))) AS fold FROM s GROUP BY 1, 4),
 c AS (SELECT *, FIRST_VALUE(text) OVER (PARTITION BY fold ORDER BY first_row) AS canonical FROM g)
SELECT 'role' AS field, text, canonical, n FROM c WHERE text <> canonical""",
)
def category_spellings(spark, folder):
    c = scan(spark, folder, "conversations")
    odd = F.col("conv_id") + F.col("turn")
    role = (
        F.when(odd % 3 == 0, F.upper("role"))
        .when(odd % 7 == 0, F.concat(F.lit(" "), "role", F.lit(" ")))
        .otherwise(F.col("role"))
    )
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_row"), role.alias("role"))
    return L.spelling_map(Sheet(rows, (ColumnInfo("role", "role", 1),)), ["role"])


@query(
    "formula_cells",
    "N7 N10 S14",
    """SELECT 'quality-formula-' || (s_suppkey + 2) || '-c2' AS issue_id, s_suppkey + 2 AS source_row, 'balance' AS field,
 '=A' || (s_suppkey + 2) || '*2' AS original, CAST(s_suppkey * 2 AS VARCHAR) AS normalized, 'use-cache' AS action
FROM supplier WHERE s_suppkey % 4 = 0""",
)
def formula_cells(spark, folder):
    return L.cell_issues(_formula_sheet(spark, folder)).filter("kind = 'formula-cache'").select(
        "issue_id", "source_row", "field", "original", "normalized", "action"
    )


def _formula_sheet(spark, folder) -> Sheet:
    """Suppliers whose balance is a formula with a cached result on every fourth row."""
    s = scan(spark, folder, "supplier")
    k = F.col("s_suppkey")
    formula = k % 4 == 0
    text = F.concat(F.lit("=A"), (k + 2).cast("string"), F.lit("*2"))
    rows = s.select(
        (k + 2).alias("source_row"),
        F.col("s_name").alias("name"),
        F.when(formula, text).otherwise((k * 3).cast("string")).alias("balance"),
        F.when(formula, "formula").otherwise("number").alias("balance__kind"),
        F.when(formula, text).alias("balance__formula"),
        F.when(formula, (k * 2).cast("string")).alias("balance__cached"),
    )
    columns = (ColumnInfo("name", "name", 1), ColumnInfo("balance", "balance", 2, "integer", "measure"))
    return Sheet(rows, columns, kinds=frozenset({"balance"}))


@query(
    "formula_cache_applied",
    "N7 N10 N11",
    """SELECT 'S0:R' || (s_suppkey + 2) AS row_id, s_suppkey + 2 AS source_row, s_name AS name,
 CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 3 AS VARCHAR) WHEN s_suppkey % 8 = 0 THEN CAST(s_suppkey * 2 AS VARCHAR) END AS balance FROM supplier""",
)
def formula_cache_applied(spark, folder):
    sheet = _formula_sheet(spark, folder)
    proposals = L.cell_issues(sheet)
    approved = proposals.filter((F.col("kind") == "formula-cache") & ((F.col("source_row") - 2) % 8 == 0)).select("issue_id")
    return N.apply_approvals(sheet, N.resolve_ledger(proposals, approved), ["balance"])


# --- approvals ---------------------------------------------------------------


@query(
    "normalize_apply",
    "N10 N11 N16 J2 J3 F16",
    f"WITH {CLEAN} SELECT 'S0:R' || source_row AS row_id, source_row, day, priority, status, score, amount FROM clean",
)
def normalize_apply(spark, folder):
    return N.apply_approvals(*resolved(spark, folder))


@query("ledger_status", "N12 T2", f"WITH {RESOLVED} SELECT issue_id, kind, source_row, status, approval FROM resolved")
def ledger_status(spark, folder):
    _, done = resolved(spark, folder)
    return L.review_order(done).select("issue_id", "kind", "source_row", "status", "approval")


@query(
    "ledger_counts",
    "A8",
    f"""WITH {LEDGER} SELECT k.kind, COUNT(l.issue_id) AS issues FROM (VALUES ('duplicate'), ('category'), ('missing'), ('unsupported')) k(kind)
 LEFT JOIN ledger l ON l.kind = k.kind GROUP BY 1""",
)
def ledger_counts(spark, folder):
    return L.counts_by_kind(
        L.quality_ledger(typed_messy_sheet(spark, folder)), ("duplicate", "category", "missing", "unsupported")
    )


@query(
    "quality_summary",
    "A9 V9",
    f"""WITH {RESOLVED}, k AS (SELECT COUNT(*) AS raw FROM messy)
SELECT raw AS raw_rows, raw - COUNT(*) FILTER (WHERE kind = 'duplicate') AS retained_rows, COUNT(*) AS issue_count,
 COUNT(*) FILTER (WHERE status = 'resolved') AS resolved, COUNT(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM resolved, k GROUP BY raw""",
)
def quality_summary(spark, folder):
    sheet, done = resolved(spark, folder)
    return L.quality_summary(N.apply_approvals(sheet, done), done)


@query(
    "issue_groups",
    "N15",
    f"""WITH {LEDGER}, b AS (SELECT *, CASE WHEN kind = 'duplicate' THEN 'duplicates' WHEN kind = 'category' THEN 'category'
   WHEN kind = 'missing' THEN 'missing' WHEN action = 'confirm-type' THEN 'confirm-type' ELSE 'other' END AS bucket FROM ledger)
SELECT bucket, canonical_row AS group_row, COUNT(*) AS issues, MIN(source_row) AS first_row, MAX(source_row) AS last_row FROM b GROUP BY 1, 2""",
)
def issue_groups(spark, folder):
    return L.review_groups(L.quality_ledger(typed_messy_sheet(spark, folder)))


@query(
    "normalize_reverse",
    "N13 J2",
    f"""WITH {CLEAN} SELECT c.source_row, m.day, m.priority, m.status, c.score, m.amount FROM clean c JOIN messy m ON m.source_row = c.source_row""",
)
def normalize_reverse(spark, folder):
    sheet, done = resolved(spark, folder)
    return N.original_values(N.apply_approvals(sheet, done), done, sheet.ids)


@query(
    "unknown_approvals",
    "N10 J3",
    f"""WITH {LEDGER} SELECT DISTINCT 'quality-duplicate-' || source_row AS issue_id FROM messy
 WHERE 'quality-duplicate-' || source_row NOT IN (SELECT issue_id FROM ledger)""",
)
def unknown_approvals(spark, folder):
    sheet = typed_messy_sheet(spark, folder)
    claimed = sheet.rows.select(F.concat(F.lit("quality-duplicate-"), F.col("source_row").cast("string")).alias("issue_id"))
    return N.unknown_approvals(L.quality_ledger(sheet), claimed)


@query("revision_hash", "N14 F18")
def revision_hash(spark, folder):
    sheet, done = resolved(spark, folder)
    rows = N.apply_approvals(sheet, done)
    return N.revision_hash(rows, sheet.columns, done.filter("status = 'resolved'"), "0" * 64, source_range=("S0", 2, 10**9, 1, len(sheet.columns), 1))


@query(
    "manifest_mapping",
    "N18",
    f"""WITH {PLACED}, t AS (SELECT source_row, CASE WHEN source_row % 5 = 0 THEN ' ' || lower(region) || ' ' WHEN source_row % 7 = 0 THEN region || '!' ELSE region END AS text FROM placed)
SELECT text, CASE WHEN text LIKE '%!' THEN NULL ELSE upper(trim(text)) END AS mapped, COUNT(*) AS n FROM t GROUP BY 1, 2""",
)
def manifest_mapping(spark, folder):
    k = F.col("source_row")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.lower("region"), F.lit(" ")))
        .when(k % 7 == 0, F.concat("region", F.lit("!")))
        .otherwise(F.col("region"))
    )
    placed = placed_orders(spark, folder).select(text.alias("text"))
    vocabulary = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return placed.groupBy("text", N.map_vocabulary(F.col("text"), vocabulary).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "localized_numbers",
    "N17",
    r"""WITH b AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders),
 t AS (SELECT o_orderkey, p, CASE o_orderkey % 8
   WHEN 0 THEN regexp_replace(p, '^([0-9]+)([0-9]{3})\.', '\1,\2.') WHEN 1 THEN replace(translate(p, '0123456789', '٠١٢٣٤٥٦٧٨٩'), '.', '٫')
   WHEN 2 THEN replace(p, '.', ',') WHEN 3 THEN p || ' USD' WHEN 4 THEN '−' || p WHEN 5 THEN ' ' || p || chr(160) WHEN 6 THEN p || '-'
   ELSE regexp_replace(p, '^([0-9]+)([0-9]{3})\.([0-9])([0-9])$', '\1.\2,\3\4') END AS text FROM b),
 n AS (SELECT o_orderkey, regexp_replace(CASE WHEN contains(p, '.') THEN rtrim(rtrim(p, '0'), '.') ELSE p END, '^$', '0') AS c FROM b)
SELECT t.o_orderkey, text, CASE t.o_orderkey % 8 WHEN 0 THEN c WHEN 1 THEN c WHEN 4 THEN '-' || c WHEN 5 THEN c
   WHEN 7 THEN CASE WHEN text = p THEN c END END AS value,
 CASE t.o_orderkey % 8 WHEN 2 THEN 'ambiguous-number' WHEN 3 THEN 'invalid-number' WHEN 6 THEN 'invalid-number'
   WHEN 7 THEN CASE WHEN text <> p THEN 'ambiguous-number' END END AS reason
FROM t JOIN n ON n.o_orderkey = t.o_orderkey""",
)
def localized_numbers(spark, folder):
    o = scan(spark, folder, "orders")
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 8
    arabic = F.translate(p, "0123456789.", "٠١٢٣٤٥٦٧٨٩٫")
    text = (
        F.when(k == 0, F.regexp_replace(p, r"^([0-9]+)([0-9]{3})\.", "$1,$2."))
        .when(k == 1, arabic)
        .when(k == 2, F.replace(p, F.lit("."), F.lit(",")))
        .when(k == 3, F.concat(p, F.lit(" USD")))
        .when(k == 4, F.concat(F.lit("−"), p))
        .when(k == 5, F.concat(F.lit(" "), p, F.lit(" ")))
        .when(k == 6, F.concat(p, F.lit("-")))
        .otherwise(F.regexp_replace(p, r"^([0-9]+)([0-9]{3})\.([0-9])([0-9])\z", "$1.$2,$3$4"))
    )
    return with_localized(o.select("o_orderkey", text.alias("text")), "text")


@query(
    "percent_inputs",
    "F20 F6",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 - 3 + l_linenumber * 6 AS DECIMAL(10,1)) AS v,
   (l_orderkey % 4) AS k FROM lineitem),
 u AS (SELECT *, CASE k WHEN 0 THEN CAST(v AS VARCHAR) || '%' WHEN 1 THEN '%' || CAST(v AS VARCHAR) WHEN 2 THEN CAST(v AS VARCHAR) || '5' ELSE 'x' END AS text FROM t)
SELECT text, CASE WHEN k IN (0, 1) AND v BETWEEN -20 AND 30 THEN
   CASE WHEN v = 0 THEN '0' ELSE rtrim(rtrim(CAST(CAST(v / 100 AS DECIMAL(10,4)) AS VARCHAR), '0'), '.') END END AS fraction, COUNT(*) AS n FROM u GROUP BY 1, 2""",
)
def percent_inputs(spark, folder):
    li = scan(spark, folder, "lineitem")
    v = (F.col("l_discount").cast("decimal(4,2)") * 100 - 3 + F.col("l_linenumber") * 6).cast("decimal(10,1)").cast("string")
    k = F.col("l_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(v, F.lit("%"))).when(k == 1, F.concat(F.lit("%"), v)).when(k == 2, F.concat(v, F.lit("5"))).otherwise(F.lit("x"))
    )
    texts = li.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return with_percent(texts, "text")


@query(
    "fold_keys",
    "F11",
    """WITH w AS (SELECT UNNEST(string_split(text, ' ')) AS word FROM documents), d AS (SELECT word, COUNT(*) AS n FROM w WHERE word <> '' GROUP BY 1)
SELECT lower(regexp_replace(nfc_normalize(word), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')) AS fold, COUNT(*) AS spellings, CAST(SUM(n) AS BIGINT) AS uses FROM d GROUP BY 1""".replace("\\\\", "\\"),
)
def fold_keys(spark, folder):
    words = scan(spark, folder, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    spelled = words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(fold_key(F.col("word")).alias("fold")).agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("uses")
    )
