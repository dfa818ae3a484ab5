"""The quality ledger: proposals about rows and cells, never changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.dates import SLASH_DATE
from tabulith.functions.decimals import DECIMAL_PATTERN, significant_digits
from tabulith.functions.text import fold_key, is_blank, trim_blanks
from tabulith.operators.profile import NUMERIC_TYPES, case_ambiguous_headers, long_values
from tabulith.operators.skew import hot_keys, salted_join
from tabulith.policy import POLICY
from tabulith.session import cut_lineage
from tabulith.table import Sheet

LEDGER_COLUMNS = (
    "issue_id", "kind", "source_row", "field", "original", "normalized",
    "status", "action", "approval", "canonical_row", "message_key",
)

# The order in which actions are reviewed.
ACTION_ORDER = ("map-category", "use-cache", "none", "confirm-type", "exclude-row")


def _issues(df: DataFrame, kind: str, action: str, message: str, **cols: Column) -> DataFrame:
    defaults = {
        "field": F.lit(None).cast("string"),
        "original": F.lit(None).cast("string"),
        "normalized": F.lit(None).cast("string"),
        "canonical_row": F.lit(None).cast("long"),
    } | cols
    return df.select(
        defaults["issue_id"].alias("issue_id"),
        F.lit(kind).alias("kind"),
        F.col("source_row").cast("long").alias("source_row"),
        defaults["field"].alias("field"),
        defaults["original"].alias("original"),
        defaults["normalized"].alias("normalized"),
        F.lit("proposed").alias("status"),
        F.lit(action).alias("action"),
        F.lit("none").alias("approval"),
        defaults["canonical_row"].alias("canonical_row"),
        F.lit(message).alias("message_key"),
    )


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit(f"quality-{prefix}"), *[p.cast("string") for p in parts])


def duplicate_rows(sheet: Sheet) -> DataFrame:
    """Every later copy of a row, linked to its earliest copy.

    Rows are compared by the SHA-256 of all their cells (null and empty kept
    apart), so only fixed-width digests are shuffled. They are written in the one scan
    that makes them; groups, hot digests and the join back read the digests. The
    earliest row per digest is a map-side aggregate, and a digest that a third of the
    rows share is salted in the join back.
    """
    cells = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sheet.ids]))
    lead = F.col(f"`{sheet.ids[0]}`")
    keyed = cut_lineage(sheet.rows.select("source_row", lead.alias("lead"), F.unhex(F.sha2(cells, 256)).alias("digest")))
    groups = cut_lineage(
        keyed.groupBy("digest")
        .agg(F.min("source_row").alias("canonical"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    copies = keyed.agg(F.count(F.lit(1)).alias("t")).scalar()
    hot = hot_keys(groups, ["digest"], "n", copies)
    later = salted_join(keyed, groups, ["digest"], hot, ["source_row"]).filter(
        F.col("source_row") > F.col("canonical")
    )
    return _issues(
        later, "duplicate", "exclude-row", "quality.duplicate",
        issue_id=_id("duplicate", F.col("source_row")),
        original=F.when(F.col("lead") != "", F.col("lead")),
        canonical_row=F.col("canonical"),
    )


def _spellings(sheet: Sheet, columns: Sequence[str]) -> DataFrame:
    """(field, text, first_row, n): distinct spellings, combined map-side."""
    return long_values(sheet, columns).groupBy("field", "text").agg(
        F.min("source_row").alias("first_row"), F.count(F.lit(1)).alias("n")
    )


def spelling_map(sheet: Sheet, columns: Sequence[str], spelled: DataFrame | None = None) -> DataFrame:
    """(field, text, canonical, n): spellings whose fold key was first seen otherwise.

    Cells collapse to distinct spellings before anything is folded, so the
    composed form is computed once per spelling.
    """
    spelled = (_spellings(sheet, columns) if spelled is None else spelled).withColumn("fold", fold_key(F.col("text")))
    canon = spelled.groupBy("field", "fold").agg(
        F.min_by("text", "first_row").alias("canonical"), F.count(F.lit(1)).alias("spellings")
    )
    several = canon.filter(F.col("spellings") > 1)
    # A category is only hot here when it has very many spellings, not rows.
    hot = hot_keys(several, ["field", "fold"], "spellings")
    joined = salted_join(spelled, several.drop("spellings"), ["field", "fold"], hot, ["text"])
    return joined.filter(F.col("text") != F.col("canonical")).select("field", "text", "canonical", "n")


def category_variants(sheet: Sheet, columns: Sequence[str]) -> DataFrame:
    """Cells spelled differently from the first-seen spelling of their category.

    The distinct spellings with their counts are written in one scan; they give the
    variants and the hot spellings, so the cells are read once more and not three times.
    """
    spelled = cut_lineage(_spellings(sheet, columns))
    variants = cut_lineage(spelling_map(sheet, columns, spelled).drop("n"))
    hot = cut_lineage(hot_keys(spelled, ["field", "text"], "n"))
    cells = salted_join(long_values(sheet, columns), variants, ["field", "text"], hot, ["source_row"])
    places = F.array(*[F.lit(c) for c in sheet.ids])
    # At most one entry per column of one row, so this window is narrow.
    nth = F.row_number().over(W.partitionBy("source_row").orderBy(F.array_position(places, F.col("field"))))
    cells = cells.withColumn("nth", nth)
    short = _id("category", F.col("source_row"))
    return _issues(
        cells, "category", "map-category", "quality.category",
        issue_id=F.when(F.col("nth") == 1, short).otherwise(F.concat_ws("-", short, F.col("field"))),
        field=F.col("field"), original=F.col("text"), normalized=F.col("canonical"),
    )


def missing_cells(sheet: Sheet) -> DataFrame:
    """One issue per blank cell of a row; nothing is ever imputed."""
    blanks = F.filter(
        F.array(
            *[
                F.when(is_blank(F.col(f"`{c.id}`")), F.struct(F.lit(c.id).alias("id"), F.lit(c.source_column).alias("at")))
                for c in sheet.columns
            ]
        ),
        lambda x: x.isNotNull(),
    )
    exploded = sheet.rows.select("source_row", F.posexplode(blanks).alias("nth", "c"))
    short = _id("missing", F.col("source_row"))
    long_ = F.concat(short, F.lit("-c"), F.col("c.at").cast("string"))
    return _issues(
        exploded, "missing", "none", "quality.missing",
        issue_id=F.when(F.col("nth") == 0, short).otherwise(long_), field=F.col("c.id"),
    )


def cell_issues(sheet: Sheet) -> DataFrame:
    """Formula, slash-date, precision and malformed issues in one narrow pass.

    Trimmed text and the numeric test are projections of their own, so each is
    computed once per cell.
    """
    staged = sheet.rows.withColumns({f"{c.id}__t": trim_blanks(F.col(f"`{c.id}`")) for c in sheet.columns})
    staged = staged.withColumns({f"{c.id}__d": F.col(f"`{c.id}__t`").rlike(DECIMAL_PATTERN) for c in sheet.columns})
    per_column = []
    for c in sheet.columns:
        text = F.col(f"`{c.id}`")
        t, numeric = F.col(f"`{c.id}__t`"), F.col(f"`{c.id}__d`")
        kind = sheet.kind_of(c.id)
        formula = kind == "formula"
        limit = F.when(kind == "number", POLICY.spreadsheet_significant_digits).otherwise(POLICY.max_significant_digits)
        at = F.lit(c.source_column)

        def found(test, name, prefix, original, normalized, action, message, id_=c.id, at=at):
            return F.when(
                test,
                F.struct(
                    F.lit(name).alias("kind"), F.lit(prefix).alias("prefix"), F.lit(id_).alias("field"), at.alias("at"),
                    original.alias("original"), normalized.alias("normalized"),
                    F.lit(action).alias("action"), F.lit(message).alias("message_key"),
                ),
            )

        null = F.lit(None).cast("string")
        filled = ~is_blank(text)
        if c.id in sheet.kinds:
            per_column.append(
                found(filled & formula, "formula-cache", "formula", F.col(f"`{c.id}__formula`"),
                      F.col(f"`{c.id}__cached`"), "use-cache", "quality.proposed")
            )
        per_column.append(
            found(filled & t.rlike(SLASH_DATE), "ambiguous-date", "date", text, null, "confirm-type",
                  "upload.ambiguousDate")
        )
        per_column.append(
            # A text no longer than the limit cannot hold more digits than it.
            found(filled & numeric & (F.length(t) > limit) & (significant_digits(t) > limit), "precision", "precision", text, text,
                  "confirm-type", "quality.proposed")
        )
        if c.type in NUMERIC_TYPES:
            per_column.append(
                found(filled & ~numeric & (kind != "formula"), "malformed", "malformed", text, text, "none",
                      "quality.proposed")
            )
    hits = F.filter(F.array(*per_column), lambda x: x.isNotNull())
    rows = staged.select("source_row", F.explode(hits).alias("x")).select("source_row", "x.*")
    id_ = F.concat(F.lit("quality-"), F.col("prefix"), F.lit("-"), F.col("source_row").cast("string"), F.lit("-c"),
                   F.col("at").cast("string"))
    return rows.select(
        id_.alias("issue_id"), "kind", F.col("source_row").cast("long").alias("source_row"), "field", "original",
        "normalized", F.lit("proposed").alias("status"), "action", F.lit("none").alias("approval"),
        F.lit(None).cast("long").alias("canonical_row"), "message_key",
    )


def header_issues(headers: DataFrame, header_row: int) -> DataFrame:
    """Blank headers, and headers that differ from an earlier one only in spelling."""
    at = F.lit(header_row).cast("long")
    blank = headers.filter("blank").withColumn("source_row", at)
    clash = case_ambiguous_headers(headers).withColumn("source_row", at)
    return _issues(
        blank, "header", "confirm-type", "quality.proposed",
        issue_id=_id("header", F.col("source_column")), field=F.col("id"), original=F.lit(""),
        normalized=F.col("label"),
    ).unionByName(
        _issues(
            clash, "header", "confirm-type", "quality.proposed",
            issue_id=_id("header-ambiguous", F.col("source_column")), field=F.col("id"), original=F.col("label"),
        )
    )


def quality_ledger(sheet: Sheet, headers: DataFrame | None = None) -> DataFrame:
    """Every proposal for a profiled sheet (column types already set)."""
    parts = [
        duplicate_rows(sheet),
        category_variants(sheet, [c.id for c in sheet.columns if c.type in ("text", "mixed")]),
        missing_cells(sheet),
        cell_issues(sheet),
    ]
    if headers is not None:
        parts.append(header_issues(headers, sheet.header_row))
    return reduce(DataFrame.unionByName, parts)


# --- views of a ledger -----------------------------------------------------


def action_rank(action: Column) -> Column:
    ranks = [F.when(action == a, i) for i, a in enumerate(ACTION_ORDER)]
    return F.coalesce(*ranks, F.lit(9))


def review_order(ledger: DataFrame) -> DataFrame:
    """Action priority, then source row, then id; a distributed range sort."""
    return ledger.orderBy(action_rank(F.col("action")), "source_row", "issue_id")


def review_bucket(kind: Column, action: Column) -> Column:
    return (
        F.when((kind == "duplicate") & (action == "exclude-row"), "duplicates")
        .when((kind == "category") & (action == "map-category"), "category")
        .when(kind == "missing", "missing")
        .when((kind == "formula-cache") & (action == "use-cache"), "formula-cache")
        .when((action == "confirm-type") | (kind == "ambiguous-date"), "confirm-type")
        .otherwise("other")
    )


def review_members(ledger: DataFrame) -> DataFrame:
    """Each issue with its review bucket and, for duplicates, its group row."""
    bucket = review_bucket(F.col("kind"), F.col("action"))
    group = F.when(F.col("bucket") == "duplicates", F.coalesce("canonical_row", "source_row"))
    return ledger.withColumn("bucket", bucket).withColumn("group_row", group)


def review_groups(ledger: DataFrame) -> DataFrame:
    """(bucket, group_row, issues, first_row, last_row); members stay a table of their own."""
    return review_members(ledger).groupBy("bucket", "group_row").agg(
        F.count(F.lit(1)).alias("issues"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row")
    )


def counts_by_kind(ledger: DataFrame, kinds: Sequence[str] = ("duplicate", "category", "missing")) -> DataFrame:
    """(kind, issues) for a fixed list of kinds, zeros included, from one row of counts."""
    wide = ledger.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    packed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("issues")) for k in kinds])
    return wide.select(F.explode(packed).alias("x")).select("x.*")


def quality_summary(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: raw, retained, issue, resolved and unresolved counts."""
    kept = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = ledger.agg(
        F.count_if((F.col("action") == "exclude-row") & (F.col("status") == "resolved")).alias("_excluded"),
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(F.col("status") == "unresolved").alias("unresolved"),
    )
    return counts.withColumn("retained_rows", kept).select(
        (F.col("retained_rows") + F.col("_excluded")).alias("raw_rows"),
        "retained_rows", "issue_count", "resolved", "unresolved",
    )


def distinct_on(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key in a stated order; the kept row is never arbitrary."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*keys, "_r.*")
