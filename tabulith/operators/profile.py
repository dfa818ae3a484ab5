"""Column profiling: one pass over the rows proposes types and roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.dates import is_valid_date
from tabulith.functions.decimals import DECIMAL_PATTERN
from tabulith.functions.text import column_letter, fold_key, slug, trim_blanks
from tabulith.operators.ordinals import systematic_sample
from tabulith.policy import POLICY
from tabulith.table import ColumnInfo, Sheet

# Name and value patterns of the proposals.
IDENTIFIER_NAME = r"(?i)(^|_)(id|key|code|site)\z"
LEADING_ZERO = r"^-?0[0-9]"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "نعم", "لا")
NUMERIC_TYPES = ("decimal", "integer", "mixed")


def read_headers(header_cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, source_column, label, blank): an empty header becomes ``Column <letter>``.

    Landed header rows keep their blank positions, so every column has a cell.
    """
    text = F.coalesce(F.col("raw"), F.lit(""))
    blank = trim_blanks(text) == ""
    label = F.when(blank, F.concat(F.lit("Column "), column_letter(F.col("column")))).otherwise(text)
    return header_cells.select(*keys, F.col("column").alias("source_column"), label.alias("label"), blank.alias("blank"))


def column_ids(headers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``id``: the label's slug, later repeats numbered ``__2``, ``__3``...

    The window runs over the headers of one table (``keys``), so its size is a
    table's width.
    """
    base = headers.withColumn("_slug", slug(F.col("label")))
    n = F.row_number().over(W.partitionBy(*keys, "_slug").orderBy("source_column"))
    id_ = F.when(n == 1, F.col("_slug")).otherwise(F.concat(F.col("_slug"), F.lit("__"), n.cast("string")))
    return base.withColumn("id", id_).drop("_slug")


def _votes(text: Column) -> dict[str, Column]:
    t = trim_blanks(text)
    return {
        "numeric": t.rlike(DECIMAL_PATTERN),
        "date": is_valid_date(t),
        "boolean": F.lower(t).isin(*BOOLEAN_WORDS),
        "leading_zero": t.rlike(LEADING_ZERO),
        "point": t.contains("."),
    }


def propose_type(n: Column, numeric: Column, date: Column, boolean: Column, lead: Column, point: Column) -> Column:
    """The type ladder over vote counts; ``lead`` and ``point`` are flags."""
    share = lambda c: c / n
    return (
        F.when(n == 0, "text")
        .when(lead & (share(numeric) >= POLICY.numeric_share), "identifier")
        .when(share(date) >= POLICY.date_share, "date")
        .when((share(numeric) >= POLICY.numeric_share) & ~lead & point, "decimal")
        .when((share(numeric) >= POLICY.numeric_share) & ~lead, "integer")
        .when(share(boolean) >= POLICY.numeric_share, "boolean")
        .when(share(numeric) > 0.5, "mixed")
        .otherwise("text")
    )


def propose_role(label: Column, type_: Column) -> Column:
    return (
        F.when(type_ == "date", "date")
        .when((type_ == "identifier") | label.rlike(IDENTIFIER_NAME), "identifier")
        .when(type_.isin("integer", "decimal"), "measure")
        .when(type_ == "text", "dimension")
        .otherwise("unknown")
    )


def column_profile(sheet: Sheet, sample: int | None = None) -> DataFrame:
    """(id, label, source_column, n, votes..., type, role), one row per column.

    All columns are voted on in a single aggregation over all rows. ``sample``
    switches to evenly spaced non-empty values per column, as an interactive
    profiler would read.
    """
    if sample is not None:
        return _sampled_profile(sheet, sample)
    aggs = []
    for c in sheet.columns:
        text = F.col(f"`{c.id}`")
        filled = text.isNotNull() & (text != "")
        aggs.append(F.count_if(filled).alias(f"{c.id}|n"))
        for name, vote in _votes(text).items():
            aggs.append(F.count_if(filled & vote).alias(f"{c.id}|{name}"))
    wide = sheet.rows.agg(*aggs)
    return _finish(
        wide.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c.id).alias("id"),
                            F.lit(c.label).alias("label"),
                            F.lit(c.source_column).alias("source_column"),
                            *[
                                F.col(f"`{c.id}|{k}`").alias(k)
                                for k in ("n", "numeric", "date", "boolean", "leading_zero", "point")
                            ],
                        )
                        for c in sheet.columns
                    ]
                )
            ).alias("p")
        ).select("p.*")
    )


def _finish(votes: DataFrame) -> DataFrame:
    type_ = propose_type(
        F.col("n"), F.col("numeric"), F.col("date"), F.col("boolean"), F.col("leading_zero") > 0, F.col("point") > 0
    )
    return votes.withColumn("type", type_).withColumn("role", propose_role(F.col("label"), F.col("type")))


def long_values(sheet: Sheet, columns: Sequence[str] | None = None) -> DataFrame:
    """(source_row, field, text) for every non-empty cell of the given columns."""
    ids = list(columns) if columns is not None else sheet.ids
    pairs = [F.struct(F.lit(i).alias("field"), F.col(f"`{i}`").alias("text")) for i in ids]
    if not pairs:
        return sheet.rows.select("source_row", F.lit(None).cast("string").alias("field"),
                                 F.lit(None).cast("string").alias("text")).filter(F.lit(False))
    filled = F.filter(F.array(*pairs), lambda p: p["text"].isNotNull() & (p["text"] != ""))
    return sheet.rows.select("source_row", F.explode(filled).alias("p")).select("source_row", "p.field", "p.text")


def _sampled_profile(sheet: Sheet, sample: int) -> DataFrame:
    picked = systematic_sample(long_values(sheet), "source_row", sample, ["field"])
    votes = _votes(F.col("text"))
    counted = picked.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in votes.items()]
    )
    spark = sheet.rows.sparkSession
    declared = spark.createDataFrame(
        [(c.id, c.label, c.source_column) for c in sheet.columns], "id string, label string, source_column int"
    )
    joined = declared.join(counted, declared["id"] == counted["field"], "left").drop("field")
    return _finish(joined.fillna(0, ["n", *votes]))


def proposed_columns(sheet: Sheet, profile: DataFrame) -> tuple[ColumnInfo, ...]:
    """The profile as column facts: one small row per column of one table."""
    found = {r["id"]: (r["type"], r["role"]) for r in profile.select("id", "type", "role").collect()}
    return tuple(c.with_(type=found[c.id][0], role=found[c.id][1]) for c in sheet.columns)


def case_ambiguous_headers(headers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Headers that fold to an earlier header's key but are spelled differently."""
    named = headers.filter(~F.col("blank")).withColumn("_fold", fold_key(F.col("label")))
    w = W.partitionBy(*keys, "_fold").orderBy("source_column").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first("label").over(w)
    return named.withColumn("first_label", first).filter(F.col("label") != F.col("first_label")).drop("_fold")


# --- declared columns ------------------------------------------------------


def pending(columns: Sequence[ColumnInfo], overrides: Mapping[str, ColumnInfo]) -> list[ColumnInfo]:
    return [c for c in columns if not c.confirmed and c.id not in overrides]


def effective(columns: Sequence[ColumnInfo], overrides: Mapping[str, ColumnInfo]) -> list[ColumnInfo]:
    return [overrides.get(c.id, c) for c in columns]


def ambiguity(columns: DataFrame) -> DataFrame:
    """Add ``hint``: which question an unconfirmed column still raises."""
    hint = (
        F.when(F.col("confirmed"), "none")
        .when(F.col("type") == "date", "date")
        .when(F.col("type").isin(*NUMERIC_TYPES), "number")
        .otherwise("none")
    )
    return columns.withColumn("hint", hint)


def columns_frame(spark, columns: Sequence[ColumnInfo]) -> DataFrame:
    return spark.createDataFrame(
        [
            (c.id, c.label, c.source_column, c.type, c.role, c.unit_kind, c.currency, c.additive, c.confirmed, c.nullable)
            for c in columns
        ],
        "id string, label string, source_column int, type string, role string, unit_kind string, "
        "currency string, additive boolean, confirmed boolean, nullable boolean",
    )


def missing_required(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    """Required ids a table lacks; a rule pack fires only when this is empty."""
    return [r for r in required if r not in set(columns)]


def bind_currency(columns: Sequence[ColumnInfo], currency: str, ids: Sequence[str]) -> list[ColumnInfo]:
    return [c.with_(unit_kind="currency", currency=currency) if c.id in set(ids) else c for c in columns]


def visible_columns(columns: Sequence[str], selected: Sequence[str]) -> list[str]:
    """The selection's fields in their order, every column when it names none."""
    known = [f for f in selected if f in set(columns)]
    return known or list(columns)


@dataclass(frozen=True)
class Decisions:
    """What a reviewer settled: approved issue ids and columns read from caches."""

    approved: DataFrame | None = None
    cache_columns: tuple[str, ...] = ()


def capabilities(columns: DataFrame, ledger: DataFrame, decisions: Decisions = Decisions()) -> DataFrame:
    """One row: date axis, additive measure, open and missing counts, formulas."""
    cols = columns.agg(
        F.coalesce(F.bool_or(F.col("confirmed") & (F.col("type") == "date")), F.lit(False)).alias("has_date_axis"),
        F.coalesce(
            F.bool_or(F.col("confirmed") & (F.col("role") == "measure") & F.col("additive")), F.lit(False)
        ).alias("has_additive_measure"),
    )
    open_issue = (F.col("action") != "none") & (F.col("status") == "proposed")
    issues = ledger
    if decisions.approved is not None:
        settled = decisions.approved.select("issue_id").distinct().withColumn("_ok", F.lit(True))
        issues = ledger.join(settled, "issue_id", "left")
        open_issue = open_issue & F.col("_ok").isNull()
    counts = issues.agg(
        F.count_if(open_issue).alias("open_count"),
        F.count_if(F.col("kind") == "missing").alias("missing_count"),
        F.coalesce(F.bool_or(F.col("kind") == "formula-cache"), F.lit(False)).alias("has_formula_cells"),
    )
    packed = counts.select(F.struct("*").alias("c")).scalar()
    return cols.withColumn("_c", packed).select(
        "has_date_axis",
        "has_additive_measure",
        "_c.*",
        F.lit(len(decisions.cache_columns)).alias("cache_opt_in_count"),
    )


def first_distinct_values(sheet: Sheet, k: int = 3) -> DataFrame:
    """(field, ordinal, text): the first ``k`` distinct values of each column."""
    firsts = long_values(sheet).groupBy("field", "text").agg(F.min("source_row").alias("first_row"))
    rank = F.row_number().over(W.partitionBy("field").orderBy("first_row"))
    return firsts.withColumn("ordinal", rank).filter(F.col("ordinal") <= k)
