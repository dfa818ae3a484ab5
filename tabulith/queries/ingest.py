"""Landing, delimited records, cells and sheets over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import profile as P
from tabulith.policy import Limits
from tabulith.queries.registry import query
from tabulith.session import cut_lineage, shared_folder
from tabulith.sources import cells as CE
from tabulith.sources import delimited as D
from tabulith.sources import landing as LA
from tabulith.sources.tables import scan
from tabulith.table import ColumnInfo


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one landed file of (file_id, text)."""
    landed = LA.decode(LA.files_from_text(scan(spark, folder, "documents"), "doc_id", "text"))
    return landed.filter("problem is null").select("file_id", "text")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return D.read_records(files(spark, folder), ",")


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Records written once to the shared folder, for steps that read them several times."""
    return cut_lineage(records(spark, folder))


# Documents hold no field that opens with a quote, so lines and commas split them.
RECORDS = r"""ln AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS start_line FROM documents),
 rec AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, start_line, line, string_split(line, ',') AS fields, len(string_split(line, ',')) AS width,
   ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY start_line) AS ordinal FROM ln WHERE trim(replace(line, ',', '')) <> '')"""

HEADERS = f"""{RECORDS}, wd AS (SELECT file_id, width, COUNT(*) AS n, MIN(ordinal) AS first_at FROM rec WHERE ordinal <= 30 GROUP BY 1, 2),
 hd AS (SELECT file_id, width, first_at AS header FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY n DESC, first_at) AS rn FROM wd) WHERE rn = 1),
 tr AS (SELECT r.*, r.ordinal = h.header AS is_header FROM rec r JOIN hd h ON h.file_id = r.file_id WHERE r.ordinal >= h.header)"""


@query(
    "landing_audit",
    "S1 S7",
    """SELECT 'd' || doc_id AS file_id, strlen(text) AS bytes, sha256(text) AS sha256, 'delimited' AS format FROM documents
 UNION ALL SELECT 'p' || page_id, strlen(html), sha256(html), 'delimited' FROM pages""",
)
def landing_audit(spark, folder):
    docs = scan(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body"))
    pages = scan(spark, folder, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("body"))
    return LA.audit(LA.files_from_text(docs.union(pages), "id", "body"))


def _planted(spark, folder) -> DataFrame:
    """Documents as bytes with containers, bad encodings, marks and blank files planted."""
    docs = LA.files_from_text(scan(spark, folder, "documents"), "doc_id", "text")
    k = F.col("file_id").cast("long")
    lead = lambda h: F.concat(F.unhex(F.lit(h)), F.col("content"))
    content = (
        F.when(k % 13 == 0, lead("504B0304"))
        .when(k % 17 == 0, lead("D0CF11E0A1B11AE1"))
        .when(k % 11 == 0, F.concat(F.col("content"), F.unhex(F.lit("FF"))))
        .when(k % 7 == 0, F.unhex(F.lit("200A0D0920")))
        .when(k % 3 == 0, lead("EFBBBF"))
        .otherwise(F.col("content"))
    )
    return docs.withColumn("content", content)


@query(
    "format_sniff",
    "S7 S8 S10",
    """SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND strlen(text) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END <= 20000 THEN CAST(length(text) AS INTEGER) END AS chars,
 CASE WHEN strlen(text) + CASE WHEN doc_id % 13 = 0 THEN 4 WHEN doc_id % 17 = 0 THEN 8 WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 5 - strlen(text) WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END > 20000 THEN 'limit.input-bytes'
  WHEN doc_id % 13 = 0 THEN 'cells-required' WHEN doc_id % 17 = 0 THEN 'unsupported.ole2-container' WHEN doc_id % 11 = 0 THEN 'csv.invalid-utf8' WHEN doc_id % 7 = 0 THEN 'csv.empty' END AS problem FROM documents""",
)
def format_sniff(spark, folder):
    decoded = LA.decode(_planted(spark, folder), Limits(input_bytes=20_000))
    return decoded.select("file_id", F.length("text").alias("chars"), "problem")


@query(
    "csv_records",
    "S2 A17",
    f"WITH {RECORDS} SELECT file_id, ordinal, start_line, start_line AS end_line, CAST(width AS INTEGER) AS width, fields[1] AS first_field, fields[-1] AS last_field FROM rec",
)
def csv_records(spark, folder):
    return records(spark, folder).select(
        "file_id", "ordinal", "start_line", "end_line", F.size("fields").alias("width"),
        F.element_at("fields", 1).alias("first_field"), F.element_at("fields", -1).alias("last_field"),
    )


@query("quoted_records", "S2 S8")
def quoted_records(spark, folder):
    """Pages wrapped as quoted fields: newlines, quotes and commas stay inside a field."""
    pages = scan(spark, folder, "pages")
    quoted = F.concat(F.lit('"'), F.replace(F.col("html"), F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("page,url,body\n"), F.col("page_id").cast("string"), F.lit(","), F.col("url"), F.lit(","), quoted, F.lit("\n"))
    found = D.read_records(pages.select(F.col("page_id").cast("string").alias("file_id"), text.alias("text")), ",")
    return found.select("file_id", "ordinal", "start_line", "end_line", F.size("fields").alias("width"), F.sha2(F.element_at("fields", -1), 256).alias("last_sha"))


@query(
    "delimiter_vote",
    "S4",
    """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ',', ';') ELSE replace(text, ' ', chr(9)) END AS text FROM documents),
 s AS (SELECT doc_id, string_split(left(text, 65536), chr(10)) AS lines FROM f), l AS (SELECT doc_id, UNNEST(lines) AS line FROM s),
 w AS (SELECT doc_id, d, len(string_split(line, d)) AS width FROM l, (SELECT UNNEST([',', chr(9), ';']) AS d) WHERE trim(replace(replace(line, d, ''), chr(9), '')) <> ''),
 v AS (SELECT doc_id, d, MIN(width) AS lo, MAX(width) AS hi FROM w GROUP BY 1, 2),
 c AS (SELECT doc_id, COUNT(*) FILTER (WHERE lo = hi AND lo > 1) AS c, COUNT(*) FILTER (WHERE hi > 1 AND lo <> hi) AS p,
   MIN(d) FILTER (WHERE lo = hi AND lo > 1) AS cd, MIN(d) FILTER (WHERE hi > 1 AND lo <> hi) AS pd FROM v GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS file_id, CASE WHEN c <= 1 AND p <= 1 THEN COALESCE(cd, pd, ',') END AS delimiter, CASE WHEN c > 1 OR p > 1 THEN 'csv.ambiguous-delimiter' END AS problem FROM c""",
)
def delimiter_vote(spark, folder):
    k = F.col("file_id").cast("long") % 3
    text = F.when(k == 0, F.col("text")).when(k == 1, F.replace(F.col("text"), F.lit(","), F.lit(";"))).otherwise(
        F.replace(F.col("text"), F.lit(" "), F.lit("\t"))
    )
    return D.choose_delimiter(D.delimiter_votes(files(spark, folder).withColumn("text", text)))


@query("header_vote", "S5 A17", f"WITH {HEADERS} SELECT file_id, header, CAST(width AS INTEGER) AS width FROM hd")
def header_vote(spark, folder):
    return D.header_ordinals(records(spark, folder))


@query(
    "explicit_header",
    "S9",
    f"""WITH {RECORDS}, f AS (SELECT DISTINCT file_id FROM rec)
SELECT f.file_id, r.ordinal AS header, CASE WHEN r.ordinal IS NULL THEN 'csv.header-row-not-a-record' END AS problem FROM f LEFT JOIN rec r ON r.file_id = f.file_id AND r.start_line = 3""",
)
def explicit_header(spark, folder):
    return D.explicit_header(records(spark, folder), F.lit(3))


def landed_cells(spark, folder) -> DataFrame:
    r = landed(spark, folder)
    return D.to_cells(D.table_records(r, D.header_ordinals(r)))


@query(
    "csv_cells",
    "S3 S2 S5",
    f"""WITH {HEADERS}, mx AS (SELECT file_id, MAX(width) AS widest FROM tr GROUP BY 1),
 c AS (SELECT file_id, start_line AS "row", is_header, UNNEST(fields) AS raw, UNNEST(range(1, len(fields) + 1)) AS "column" FROM tr
   UNION ALL SELECT t.file_id, t.start_line, TRUE, '', UNNEST(range(t.width + 1, m.widest + 1)) FROM tr t JOIN mx m ON m.file_id = t.file_id WHERE t.is_header)
SELECT file_id, "row", CAST("column" AS INTEGER) AS "column", NULLIF(raw, '') AS raw, CASE WHEN raw = '' THEN 'blank' ELSE 'text' END AS cell_type, is_header FROM c WHERE raw <> '' OR is_header""",
)
def csv_cells(spark, folder):
    return landed_cells(spark, folder)


@query(
    "header_labels",
    "P5 P6 F14 N8 W2",
    f"""WITH {HEADERS}, h AS (SELECT file_id, UNNEST(fields) AS raw, UNNEST(range(1, len(fields) + 1)) AS pos FROM tr WHERE is_header),
 l AS (SELECT file_id, pos, trim(raw) = '' AS blank, CASE WHEN trim(raw) = '' THEN 'Column ' || CASE WHEN pos > 26 THEN chr(CAST(64 + (pos - 1) // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (pos - 1) % 26 AS INTEGER)) ELSE raw END AS label FROM h),
 s AS (SELECT *, regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9؀-ۿ]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug0 FROM l),
 g AS (SELECT *, CASE WHEN slug0 = '' THEN 'column' ELSE slug0 END AS slug FROM s),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id, slug ORDER BY pos) AS n FROM g)
SELECT file_id, CAST(pos AS INTEGER) AS source_column, label, blank, CASE WHEN n = 1 THEN slug ELSE slug || '__' || n END AS id FROM r""",
)
def header_labels(spark, folder):
    r = landed(spark, folder)
    header = D.table_records(r, D.header_ordinals(r)).filter("is_header")
    return P.column_ids(P.read_headers(D.to_cells(header), ["file_id"]), ["file_id"])


@query(
    "case_ambiguous_headers",
    "N9 F11",
    """WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN upper(role) ELSE role END AS label FROM conversations),
 f AS (SELECT *, FIRST_VALUE(label) OVER (PARTITION BY conv_id, lower(label) ORDER BY turn) AS first_label FROM h)
SELECT conv_id, CAST(turn AS INTEGER) AS source_column, label, first_label FROM f WHERE label <> first_label""",
)
def case_ambiguous_headers(spark, folder):
    h = scan(spark, folder, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("source_column"),
        F.when(F.col("turn") % 3 == 2, F.upper("role")).otherwise(F.col("role")).alias("label"), F.lit(False).alias("blank"),
    )
    return P.case_ambiguous_headers(h, ["conv_id"]).drop("blank")


@query(
    "ingest_limits",
    "S10",
    f"""WITH {HEADERS}, q AS (SELECT file_id, COUNT(*) AS n, MAX(width) AS columns, SUM(len(list_filter(fields, lambda f: f <> ''))) AS cells,
   MAX(list_max(list_transform(fields, lambda f: length(f)))) AS longest, (MAX(start_line) - MIN(start_line) + 1) * MAX(width) AS volume FROM tr GROUP BY 1)
SELECT file_id, CASE WHEN n > 20 THEN 'rows-including-header' WHEN columns > 12 THEN 'columns' WHEN volume > 60 THEN 'range-cells' WHEN longest > 300 THEN 'cell.characters' ELSE 'nonempty-cells' END AS reason
FROM q WHERE n > 20 OR columns > 12 OR volume > 60 OR longest > 300 OR cells > 60""",
)
def ingest_limits(spark, folder):
    r = landed(spark, folder)
    limits = Limits(rows_including_header=20, columns=12, nonempty_cells=60, cell_characters=300)
    return LA.limit_problems(D.table_records(r, D.header_ordinals(r)), limits)


@query(
    "ingest_warnings",
    "S11",
    f"""WITH {RECORDS}, g AS (SELECT *, COALESCE(LAG(start_line) OVER (PARTITION BY file_id ORDER BY ordinal), 0) AS prev FROM rec)
SELECT file_id, 'ingest.warn.csv-ragged-rows' AS warning FROM g GROUP BY 1 HAVING MIN(width) < MAX(width)
UNION ALL SELECT file_id, 'ingest.warn.csv-blank-records-skipped' FROM g GROUP BY 1 HAVING bool_or(start_line > prev + 1)""",
)
def ingest_warnings(spark, folder):
    return D.ingest_warnings(landed(spark, folder))


@query(
    "source_preview",
    "S12",
    f"""WITH {RECORDS}, b AS (SELECT file_id, COUNT(*) AS records, MIN(start_line) AS first_row, MAX(start_line) AS last_row, CAST(MAX(width) AS INTEGER) AS last_column FROM rec GROUP BY 1)
SELECT r.file_id, ordinal, start_line, CAST(width AS INTEGER) AS width, records, first_row, last_row, last_column FROM rec r JOIN b ON b.file_id = r.file_id WHERE ordinal <= 30""",
)
def source_preview(spark, folder):
    p = D.preview(landed(spark, folder))
    return p.withColumn("width", F.size("fields")).drop("fields")


@query(
    "hazard_scan",
    "S18",
    f"""WITH {RECORDS}, w AS (SELECT file_id, width AS w0 FROM rec WHERE ordinal = 1),
 h AS (SELECT r.file_id, ordinal, len(list_filter(fields, lambda f: regexp_matches(f, '^[\\t\\r ]*[=+\\-@]'))) AS formulas, len(list_filter(fields, lambda f: length(f) > 400)) AS long_cells,
   CASE WHEN ordinal > 1 AND width <> w0 THEN 1 ELSE 0 END AS ragged FROM rec r JOIN w ON w.file_id = r.file_id)
SELECT file_id, ordinal AS "row", 'csv.formula-prefix' AS rule, CAST(formulas AS BIGINT) AS n FROM h WHERE formulas > 0 UNION ALL SELECT file_id, ordinal, 'csv.cell-overflow', CAST(long_cells AS BIGINT) FROM h WHERE long_cells > 0
UNION ALL SELECT file_id, ordinal, 'csv.ragged-row', 1 FROM h WHERE ragged = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, 'csv.unterminated-quote', 1 FROM documents WHERE (length(text) - length(replace(text, '"', ''))) % 2 = 1
UNION ALL SELECT file_id, NULL, 'csv.row-limit', COUNT(*) FROM rec GROUP BY 1 HAVING COUNT(*) > 30""",
)
def hazard_scan(spark, folder):
    return D.hazards(landed(spark, folder), files(spark, folder), 400, 30)


@query(
    "large_file_lines",
    "S2",
    "SELECT CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS lines, TRUE AS numbered FROM documents",
)
def large_file_lines(spark, folder):
    path = _as_text_files(spark, folder)
    per_file = D.numbered_lines(spark, path).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("line").alias("m"), F.sum("line").alias("s")
    )
    exact = (F.col("m") == F.col("n")) & (F.col("s") == F.col("n") * (F.col("n") + 1) / 2)
    return per_file.agg(F.sum("n").alias("lines"), F.bool_and(exact).alias("numbered"))


def _as_text_files(spark, folder) -> str:
    import uuid

    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    scan(spark, folder, "documents").select("text").write.text(path)
    return path


@query("large_file_records", "S2")
def large_file_records(spark, folder):
    """Records of split text files; quotes carry over lines by a running count."""
    lines = D.numbered_lines(spark, _as_text_files(spark, folder))
    return D.read_large(lines, ",").groupBy(F.size("fields").alias("width")).agg(F.count(F.lit(1)).alias("records"))


# --- sheets of cells ------------------------------------------------------------


def sheet_cells(spark, folder) -> DataFrame:
    """Events as extractor cells of one workbook per user: four cells per row."""
    e = scan(spark, folder, "events")
    k = F.col("event_id")
    text = F.col("value").cast("string")
    null = F.lit(None)

    def cell(column, kind, number=None, text_=None, flag=None, formula=None, cached=None, is_date=False):
        return F.struct(
            F.lit(column).alias("column"), F.lit(kind).alias("kind"), (null if number is None else number).cast("double").alias("number"),
            (null if text_ is None else text_).cast("string").alias("text"), (null if flag is None else flag).cast("boolean").alias("flag"),
            (null if formula is None else formula).cast("string").alias("formula"), (null if cached is None else cached).cast("string").alias("cached"),
            F.lit(is_date).alias("is_date"), F.lit("1900").alias("date_system"),
        )

    big = F.when(k % 4 == 0, F.concat(text, F.lit("E20"))).when(k % 4 == 1, F.concat(text, F.lit("E-9"))).otherwise(text).cast("double")
    formula = F.when(k % 6 == 0, F.concat(F.lit("SUM(A"), k.cast("string"), F.lit(")")))
    cells = F.array(
        cell(1, "s", text_=F.when(k % 5 == 0, "").otherwise(F.col("event_type"))),
        cell(2, "n", number=big),
        cell(3, "n", number=k % 200 - 5, is_date=True),
        cell(4, "b", flag=k % 2 == 0, formula=formula, cached=F.when(k % 12 == 0, "7")),
    )
    return e.select(F.col("user_id").alias("file_id"), k.alias("row"), F.explode(cells).alias("c")).select("file_id", "row", "c.*")


CELLS = """e AS (SELECT user_id AS file_id, event_id AS "row", event_type, value, event_id AS k,
   replace(CASE WHEN value = FLOOR(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END, '.', '') AS digits,
   CASE WHEN value = FLOOR(value) THEN 0 ELSE length(CAST(value AS VARCHAR)) - position('.' IN CAST(value AS VARCHAR)) END AS places,
   CASE WHEN value = FLOOR(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS shown FROM events),
 c AS (SELECT file_id, "row", 1 AS "column", CASE WHEN k % 5 = 0 THEN NULL ELSE event_type END AS raw, CASE WHEN k % 5 = 0 THEN 'blank' ELSE 'text' END AS cell_type, NULL AS cached_value, NULL AS warning FROM e
  UNION ALL SELECT file_id, "row", 2, CASE k % 4 WHEN 0 THEN ltrim(digits, '0') || repeat('0', 20 - places)
    WHEN 1 THEN rtrim('0.' || lpad(digits, CAST(9 + places AS INTEGER), '0'), '0') ELSE shown END, 'number', NULL, NULL FROM e
  UNION ALL SELECT file_id, "row", 3, CAST(k % 200 - 5 AS VARCHAR), 'date', NULL, CASE WHEN k % 200 - 5 < 0 OR k % 200 - 5 = 60 THEN 'ingest.warn.invalid-date-serial' END FROM e
  UNION ALL SELECT file_id, "row", 4, CASE WHEN k % 6 = 0 THEN '=SUM(A' || k || ')' WHEN k % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END, CASE WHEN k % 6 = 0 THEN 'formula' ELSE 'boolean' END,
    CASE WHEN k % 12 = 0 THEN '7' END, CASE WHEN k % 6 = 0 THEN 'ingest.warn.formula-cells' END FROM e)"""


@query("mapped_cells", "S14 S15 S13", f'WITH {CELLS} SELECT file_id, "row", "column", raw, cell_type, cached_value, warning FROM c')
def mapped_cells(spark, folder):
    return CE.map_cells(sheet_cells(spark, folder)).drop("formula")


@query(
    "cell_warnings",
    "S11 S15",
    f"WITH {CELLS} SELECT file_id, string_agg(DISTINCT warning, ',' ORDER BY warning) AS warnings FROM c WHERE warning IS NOT NULL GROUP BY 1",
)
def cell_warnings(spark, folder):
    return CE.warnings(CE.map_cells(sheet_cells(spark, folder)), ["file_id"])


@query(
    "content_bounds",
    "S13",
    f"""WITH {CELLS} SELECT file_id, MAX("row") AS last_row, CAST(MIN("column") AS INTEGER) AS first_column, CAST(MAX("column") AS INTEGER) AS last_column FROM c WHERE cell_type <> 'blank' AND "row" >= 100 GROUP BY 1""",
)
def content_bounds(spark, folder):
    return CE.content_bounds(CE.map_cells(sheet_cells(spark, folder)), ["file_id"], 100)


@query(
    "sparse_header_row",
    "S6 A17",
    f"""WITH {CELLS}, w AS (SELECT file_id, "row", COUNT(*) AS w, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY "row") AS rn FROM c WHERE cell_type <> 'blank' GROUP BY 1, 2),
 n AS (SELECT file_id, w, COUNT(*) AS n, MIN("row") AS f FROM w WHERE rn <= 30 GROUP BY 1, 2)
SELECT file_id, f AS header_row FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_id ORDER BY n DESC, f) AS k FROM n) WHERE k = 1""",
)
def sparse_header_row(spark, folder):
    return CE.sparse_header_row(CE.map_cells(sheet_cells(spark, folder)), ["file_id"], 30)


SHEETS = """s AS (SELECT conv_id AS file_id, 'S' || turn AS sheet_id, turn AS ordinal, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'hidden' ELSE 'visible' END AS visibility FROM conversations)"""


def _sheets(spark, folder) -> DataFrame:
    hidden = (F.col("role") == "user") & (F.col("turn") % 4 == 0)
    return scan(spark, folder, "conversations").select(
        F.col("conv_id").alias("file_id"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("sheet_id"), F.col("turn").alias("ordinal"),
        F.when(hidden, "hidden").otherwise("visible").alias("visibility"),
    )


@query(
    "sheet_choice",
    "S16",
    f"""WITH {SHEETS}, v AS (SELECT file_id, COUNT(*) FILTER (WHERE visibility = 'visible') AS n, arg_min(sheet_id, ordinal) FILTER (WHERE visibility = 'visible') AS f FROM s GROUP BY 1)
SELECT file_id, f AS sheet_id, CASE WHEN n = 0 THEN 'sheet.none-visible' END AS problem FROM v""",
)
def sheet_choice(spark, folder):
    return CE.choose_sheet(_sheets(spark, folder))


@query(
    "sheet_choice_explicit",
    "S16",
    f"""WITH {SHEETS}, v AS (SELECT file_id, bool_or(sheet_id = 'S4') AS f, bool_or(sheet_id = 'S4' AND visibility = 'visible') AS ok FROM s GROUP BY 1)
SELECT file_id, CASE WHEN ok THEN 'S4' END AS sheet_id, CASE WHEN NOT f THEN 'sheet.not-found' WHEN NOT ok THEN 'sheet.hidden-requires-opt-in' END AS problem FROM v""",
)
def sheet_choice_explicit(spark, folder):
    return CE.choose_sheet(_sheets(spark, folder), "S4")


@query(
    "cells_to_rows",
    "P12 P7",
    "SELECT c_custkey + 2 AS source_row, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer",
)
def cells_to_rows(spark, folder):
    c = scan(spark, folder, "customer")
    pairs = F.array(
        F.struct(F.lit(1).alias("column"), F.col("c_name").alias("raw")),
        F.struct(F.lit(2).alias("column"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("raw")),
    )
    cells = c.select((F.col("c_custkey") + 2).alias("row"), F.explode(pairs).alias("p")).select("row", "p.*").filter("raw is not null")
    columns = [ColumnInfo("name", "name", 1), ColumnInfo("segment", "segment", 2)]
    return CE.to_sheet(cells, columns, header_row=1).rows


@query(
    "data_rows",
    "P7",
    f'WITH {CELLS} SELECT COUNT(DISTINCT "row") AS rows FROM c WHERE "row" > 10',
)
def data_rows(spark, folder):
    return CE.data_rows(CE.map_cells(sheet_cells(spark, folder)), 10).agg(F.count(F.lit(1)).alias("rows"))
