"""Scopes and masks: which rows count, and whether a period is complete."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.dates import to_real_date
from tabulith.session import cut_lineage
from tabulith.table import ColumnInfo


@dataclass(frozen=True)
class Scope:
    """A closed date range and a region list; an empty list means every region."""

    start: str | None = None
    end: str | None = None
    regions: tuple[str, ...] = ()
    complete: bool = True


def find_date_column(columns: Sequence[ColumnInfo]) -> ColumnInfo | None:
    return next((c for c in columns if c.role == "date" and c.type == "date"), None)


def find_region_column(columns: Sequence[ColumnInfo]) -> ColumnInfo | None:
    """The column whose id is ``region``; never guessed from its content."""
    return next((c for c in columns if c.id == "region"), None)


def in_scope(scope: Scope, date: Column | None, region: Column | None) -> Column:
    """Row predicate. Asking for regions where there is no region column is false.

    ``date`` is a DateType column, so the range reaches the scan as a filter.
    """
    test = F.lit(True)
    if date is not None and scope.start is not None and scope.end is not None:
        test = test & date.between(F.lit(scope.start).cast("date"), F.lit(scope.end).cast("date"))
    if scope.regions:
        test = test & (F.lit(False) if region is None else region.isin(*scope.regions))
    return F.coalesce(test, F.lit(False))


def scope_rows(rows: DataFrame, columns: Sequence[ColumnInfo], scope: Scope) -> DataFrame:
    """Rows of a text sheet inside a scope; only real dates can match."""
    date, region = find_date_column(columns), find_region_column(columns)
    return rows.filter(
        in_scope(scope, to_real_date(F.col(date.id)) if date else None, F.col(region.id) if region else None)
    )


def period_completeness(rows: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Per calendar period: scheduled days, missing days, complete flag.

    ``calendar`` is (date, period). Present dates are made distinct map-side, so
    the anti-join sees one row per day.
    """
    present = rows.select(F.col(date).alias("date")).distinct()
    missing = calendar.join(present, "date", "left_anti").groupBy("period").agg(F.count(F.lit(1)).alias("_m"))
    scheduled = calendar.groupBy("period").agg(F.count(F.lit(1)).alias("scheduled"))
    joined = scheduled.join(missing, "period", "left")
    gaps = F.coalesce(F.col("_m"), F.lit(0))
    return joined.select("period", "scheduled", gaps.alias("missing"), (gaps == 0).alias("complete"))


def complete_periods(rows: DataFrame, calendar: DataFrame, periods: DataFrame, confirmed: bool = True, date: str = "date") -> DataFrame:
    """``periods`` (period, start, end) with a ``complete`` flag.

    A confirmed period is complete when every day that ``calendar`` schedules in it
    has rows; one without scheduled days when it has any row; an unconfirmed one never.
    """
    days = periods.select("period", F.explode(F.sequence("start", "end")).alias("date"))
    present = rows.select(F.col(date).alias("date")).distinct().withColumn("_present", F.lit(True))
    scheduled = calendar.select("date").distinct().withColumn("_scheduled", F.lit(True))
    per_period = days.join(scheduled, "date", "left").join(present, "date", "left").groupBy("period").agg(
        F.count("_scheduled").alias("_n"), F.count(F.when(F.col("_scheduled") & F.col("_present").isNull(), 1)).alias("_m"), F.count("_present").alias("_p")
    )
    complete = F.when(F.col("_n") == 0, F.col("_p") > 0).otherwise(F.col("_m") == 0) & F.lit(confirmed)
    return periods.join(per_period, "period").select(*periods.columns, complete.alias("complete"))


def month_region_grid(cells: DataFrame, months: DataFrame | None, measures: Sequence[str]) -> DataFrame:
    """Every (month, region) pair, empty ones as zero-row totals.

    ``cells`` is (month, region, measures...) already aggregated and ``months``
    a bounded list of month keys (the months of the cells when None); the grid is regions times that list by
    exploding the list, then one equi-join. Three branches read the cells, so the
    small aggregate is written first and the fact is scanned once.
    """
    cells = cut_lineage(cells)
    months = cells if months is None else months
    listed = months.agg(F.collect_set("month").alias("m")).scalar()
    grid = cells.select("region").distinct().withColumn("month", F.explode(listed))
    full = grid.join(cells, ["month", "region"], "left")
    return full.select("month", "region", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])
