"""Approved changes applied to a sheet, and the way back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import is_decimal
from tabulith.functions.text import is_blank, trim_blanks
from tabulith.operators.ordinals import block_of
from tabulith.policy import POLICY
from tabulith.table import ColumnInfo, Sheet

TRUE_WORDS = ("true", "yes", "نعم")
FALSE_WORDS = ("false", "no", "لا")


def typed_value(text: Column, column: ColumnInfo) -> Column:
    """Canonical text of a cell for its column type; blank becomes null.

    Decimals keep the scale they were written with, booleans become true/false,
    anything that does not fit its type stays as it was.
    """
    t = trim_blanks(text)
    value = text
    if column.type == "boolean":
        value = (
            F.when(F.lower(t).isin(*TRUE_WORDS), "true").when(F.lower(t).isin(*FALSE_WORDS), "false").otherwise(text)
        )
    elif column.type in ("decimal", "integer"):
        value = F.when(is_decimal(t), t).otherwise(text)
    return F.when(~is_blank(text), value)


def unknown_approvals(ledger: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved ids no proposal carries; normalizing with any is an error."""
    return approved.select("issue_id").distinct().join(ledger, "issue_id", "left_anti")


def approve_actionable(ledger: DataFrame) -> DataFrame:
    """Ids a manifest approves as a whole: every proposal that asks for an action."""
    return ledger.filter(F.col("action") != "none").select("issue_id")


def resolve_ledger(ledger: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved issues become resolved by the user, missing ones unresolved."""
    marks = approved.select("issue_id").distinct().withColumn("_ok", F.lit(True))
    joined = ledger.join(marks, "issue_id", "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    status = F.when(ok, "resolved").when(F.col("kind") == "missing", "unresolved").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn(
        "approval", F.when(ok, "user").otherwise(F.col("approval"))
    ).select(*ledger.columns)


def apply_approvals(
    sheet: Sheet, ledger: DataFrame, cache_columns: Sequence[str] = ()
) -> DataFrame:
    """Normalized rows from a resolved ledger: (row_id, source_row, values...).

    Approved duplicates are dropped, approved categories replaced, formula cells
    are null unless their cached value was approved for an opted-in column. All
    changes of a row are gathered first, so the rows meet the ledger in one join
    on the unique ``source_row``.
    """
    done = ledger.filter(F.col("status") == "resolved")
    mapped = (F.col("kind") == "category") & (F.col("action") == "map-category") & F.col("normalized").isNotNull()
    cached = (F.col("kind") == "formula-cache") & F.col("field").isin(*cache_columns) if cache_columns else F.lit(False)
    entry = F.when(mapped | cached, F.struct(F.col("field").alias("f"), F.col("normalized").alias("v")))
    changes = done.groupBy("source_row").agg(
        F.bool_or((F.col("kind") == "duplicate") & (F.col("action") == "exclude-row")).alias("_drop"),
        # At most one entry per column of the row.
        F.map_from_entries(F.collect_list(entry)).alias("_set"),
    )
    joined = sheet.rows.join(changes, "source_row", "left").filter(~F.coalesce(F.col("_drop"), F.lit(False)))
    values = []
    for c in sheet.columns:
        raw = F.col(f"`{c.id}`")
        change = F.try_element_at(F.col("_set"), F.lit(c.id))
        plain = F.coalesce(change, typed_value(raw, c))
        value = F.when(sheet.kind_of(c.id) == "formula", typed_value(change, c)).otherwise(plain)
        values.append(value.alias(c.id))
    return joined.select(
        F.concat(F.lit(f"{sheet.sheet_id}:R"), F.col("source_row").cast("string")).alias("row_id"),
        "source_row",
        *values,
    )


def original_values(rows: DataFrame, ledger: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pre-normalization values: the ledger's original, else the current value."""
    first = (
        ledger.filter(F.col("original").isNotNull() & F.col("field").isNotNull())
        .groupBy("source_row", "field")
        .agg(F.min_by("original", "issue_id").alias("o"))
    )
    per_row = first.groupBy("source_row").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "o"))).alias("_orig")
    )
    joined = rows.join(per_row, "source_row", "left")
    restored = [F.coalesce(F.try_element_at("_orig", F.lit(f)), F.col(f"`{f}`")).alias(f) for f in fields]
    return joined.select("source_row", *restored)


def revision_hash(
    rows: DataFrame, columns: Sequence[ColumnInfo], approved: DataFrame, source_hash: str, policy: str = POLICY.version,
    source_range: tuple[str, int, int, int, int, int] | None = None,
) -> DataFrame:
    """One row, ``revision``: changes iff content, columns, approvals, policy or the selected range do.

    ``source_range`` is the sheet with its first and last row, first and last column and header row.

    Rows are digested where they are, digests are combined per block of 65,536
    source rows, then per 65,536 blocks, so no task sees more than a block.
    """

    def fold(df: DataFrame, bits: int) -> DataFrame:
        parent = block_of(F.col("at"), bits)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])
        return df.groupBy(parent.alias("at")).agg(F.sha2(F.concat_ws("|", ordered), 256).alias("d"))

    values = F.to_json(F.struct("row_id", *[F.col(f"`{c.id}`") for c in columns]), {"ignoreNullFields": "false"})
    digests = rows.select(F.col("source_row").alias("at"), F.sha2(values, 256).alias("d"))
    content = fold(fold(fold(digests, 16), 16), 62)
    ids = approved.select(F.col("issue_id").alias("i")).distinct()
    # Approvals are folded by a hash prefix so that no list grows without bound.
    hashed = ids.select(F.sha2("i", 256).alias("d")).withColumn("at", F.conv(F.substring("d", 1, 8), 16, 10).cast("long"))
    approvals = fold(fold(hashed, 16), 62)
    described = repr([(c.id, c.type, c.role, c.unit_kind, c.currency, c.additive, c.confirmed) for c in columns])
    payload = F.concat_ws(
        "|", F.lit(policy), F.lit(source_hash), F.lit(repr(source_range)), F.lit(described),
        F.coalesce(content.select("d").scalar(), F.lit("")), F.coalesce(approvals.select("d").scalar(), F.lit("")),
    )
    return rows.sparkSession.range(1).select(F.sha2(payload, 256).alias("revision"))


def map_vocabulary(text: Column, vocabulary: Sequence[str]) -> Column:
    """The closed-vocabulary term a text equals up to case and outer blanks, else null."""
    terms: Mapping[str, str] = {v.lower(): v for v in vocabulary}
    pairs = [F.lit(x) for kv in terms.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(trim_blanks(text)))
