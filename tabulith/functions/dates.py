"""Calendar helpers over real Gregorian dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
SLASH_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})\z"
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)"
    r"(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
)


def to_real_date(s: Column) -> Column:
    """The date of a strict ``YYYY-MM-DD`` text, null for anything else."""
    return F.when(s.rlike(ISO_DATE), F.try_to_date(s, "yyyy-MM-dd"))


def is_valid_date(s: Column) -> Column:
    return to_real_date(s).isNotNull()


def is_valid_datetime(s: Column) -> Column:
    """RFC 3339 date-time with a real date and an explicit offset."""
    return F.coalesce(s.rlike(RFC3339) & is_valid_date(F.substring(s, 1, 10)), F.lit(False))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def previous_month(start: Column) -> tuple[Column, Column]:
    """First and last day of the month before the month of ``start``."""
    first = F.add_months(F.trunc(start, "month"), -1)
    return first, F.last_day(first)


def trailing_months(end_start: Column, count: int) -> Column:
    """Month starts ending with the month of ``end_start``, oldest first."""
    last = F.trunc(end_start, "month")
    return F.sequence(F.add_months(last, -(count - 1)), last, F.expr("interval 1 month"))


def weekday_calendar(months: DataFrame, per_month: int = 20) -> DataFrame:
    """The first ``per_month`` weekdays of each ``month_start``: (date, period).

    A month never has more than 31 days, so the ranking window is bounded.
    """
    days = months.select(
        "month_start",
        F.explode(F.sequence(F.col("month_start"), F.last_day("month_start"))).alias("date"),
    ).filter(F.weekday("date") < 5)
    ranked = days.withColumn("rn", F.row_number().over(W.partitionBy("month_start").orderBy("date")))
    return ranked.filter(F.col("rn") <= per_month).select("date", month_key(F.col("date")).alias("period"))


def month_starts(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per month from ``first`` to ``last`` (dates inside those months)."""
    return spark.range(1).select(
        F.explode(
            F.sequence(
                F.trunc(F.lit(first).cast("date"), "month"),
                F.trunc(F.lit(last).cast("date"), "month"),
                F.expr("interval 1 month"),
            )
        ).alias("month_start")
    )
