"""Result tables ready to be written: clean data, ledger, figures, method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.decimals import is_decimal, significant_digits
from tabulith.functions.text import guard_formula, span_token
from tabulith.operators.ordinals import block_of, running_total
from tabulith.policy import POLICY


class StaleBundle(RuntimeError):
    """The parts of an export do not belong to the same table and revision."""


def clean_table(rows: DataFrame, columns: Sequence[str], sheet_name: str, guard: bool = False) -> DataFrame:
    """Values plus lineage: source_sheet, source_row, record_id."""
    values = [(guard_formula(F.col(c)) if guard else F.col(c)).alias(c) for c in columns]
    return rows.select(*values, F.lit(sheet_name).alias("source_sheet"), "source_row", F.col("row_id").alias("record_id"))


def ledger_table(ledger: DataFrame) -> DataFrame:
    """Ledger numbered 1..n by source row, then id.

    Rows are counted per source row and the counts run up block by block; the
    rank inside one source row is bounded by the table's width.
    """
    per_row = ledger.groupBy("source_row").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(per_row, "source_row", F.col("_n"), "_upto").select(
        "source_row", (F.col("_upto") - F.col("_n")).alias("_before")
    )
    nth = F.row_number().over(W.partitionBy("source_row").orderBy("issue_id"))
    numbered = ledger.withColumn("_nth", nth).join(upto, "source_row")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return numbered.select(
        (F.col("_before") + F.col("_nth")).alias("issue"), "kind", "source_row", blank("field"), blank("original"),
        blank("normalized"), "status", "action", "approval",
    )


def coverage_text(eligible: Column, total: Column) -> Column:
    return F.format_string("%d/%d", eligible, total)


def figures_table(metrics: DataFrame) -> DataFrame:
    """(metric_id, value, unit, coverage, exact_note): ledger counts are left out."""
    note = is_decimal(F.col("value")) & (significant_digits(F.col("value")) > POLICY.spreadsheet_significant_digits)
    return metrics.filter(~F.col("metric_id").startswith("quality-")).select(
        "metric_id", "value", "unit",
        coverage_text(F.col("eligible_rows"), F.col("total_rows")).alias("coverage"),
        F.when(note, F.concat(F.lit("exact stored value: "), "value")).alias("exact_note"),
    )


def method_table(proofs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per proof and block of source rows: expression, result, spans.

    Spans of one proof are rendered per 65,536 source rows, so no proof's text
    grows with the table.
    """
    chunk = block_of(F.col("start"))
    item = F.struct("start", span_token(F.col("start"), F.col("end")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), ",")
    per_proof = spans.groupBy("selection_id", chunk.alias("chunk")).agg(text.alias("spans"))
    joined = proofs.join(per_proof, "selection_id", "left")
    return joined.select(
        "proof_id", "expression", F.coalesce("result", "reason").alias("result"), F.coalesce("chunk", F.lit(0)).alias("chunk"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def headline_table(metrics: DataFrame, preferred: Sequence[str], cap: int = POLICY.headline_cap) -> DataFrame:
    """Up to ``cap`` figures: preferred ids first, then table order; no ledger counts."""
    wanted = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("metric_id"))
    first = F.when(wanted > 0, wanted).otherwise(F.lit(1_000_000))
    shown = metrics.filter(~F.col("metric_id").startswith("quality-"))
    return shown.orderBy(first, "ordinal").limit(cap)


def recomputed_sum(rows: DataFrame, value: Column, region: str | None, start: str, next_month: str) -> DataFrame:
    """Second, independent form of a scoped sum over ``[start, next_month)``."""
    inside = (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(next_month).cast("date"))
    if region is not None:
        inside = inside & (F.col("region") == region)
    return rows.filter(inside).agg(F.sum(value).alias("value"))


def stays_text(value: Column) -> Column:
    """Cells a spreadsheet must not turn into numbers or formulas."""
    return ~(is_decimal(value) & (significant_digits(value) <= POLICY.spreadsheet_significant_digits))


def assert_current(table: DataFrame, snapshot: DataFrame, names: Sequence[str]) -> None:
    """Refuse an export whose one-row identities differ."""
    a, b = table.select(*names).first(), snapshot.select(*names).first()
    stale = [n for n in names if a is None or b is None or a[n] != b[n]]
    if stale:
        raise StaleBundle(f"export parts disagree on {', '.join(stale)}")
