"""Many scoped figures from one scan, and the figures derived from them."""

from __future__ import annotations

import decimal as pydec
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.decimals import plain, ratio6
from tabulith.operators.figures import SumSpec, scoped_sums
from tabulith.operators.ordinals import null_safe_join, running_total, with_ordinal
from tabulith.operators.scope import Scope, in_scope
from tabulith.operators.skew import hot_keys, salted_join
from tabulith.session import cut_lineage
from tabulith.table import ColumnInfo

_WIDE = pydec.Context(prec=400, rounding=pydec.ROUND_HALF_UP)


def summed_measures(columns: Sequence[ColumnInfo], declared_labels: Sequence[str]) -> list[str]:
    """Measures a generic analysis may add up: declared, confirmed, additive, numeric."""
    return [
        c.id
        for c in columns
        if c.role == "measure"
        and c.additive
        and c.confirmed
        and c.type in ("decimal", "integer", "mixed")
        and f"metric.{c.id}" in set(declared_labels)
    ]


def generic_totals(
    rows: DataFrame, columns: Sequence[ColumnInfo], scope: Scope, declared_labels: Sequence[str], date, region
) -> DataFrame:
    specs = [SumSpec(f"total-{m}", m, scope) for m in summed_measures(columns, declared_labels)]
    return scoped_sums(rows, specs, date, region)


# --- figures per entity ----------------------------------------------------


def two_periods(
    fact: DataFrame, entity: str, current: Scope, previous: Scope, measures: Sequence[str], rows: str
) -> DataFrame:
    """Current and previous period totals of every entity from one scan.

    The scan is limited to the two periods; each measure is summed under both
    conditions in the same aggregation, so no self-join is needed.
    """
    cur = in_scope(current, F.col("date"), None)
    prev = in_scope(previous, F.col("date"), None)
    aggs = []
    for m in measures:
        aggs.append(F.coalesce(F.sum(F.when(cur, F.col(m))), F.lit(0)).alias(f"{m}_cur"))
        aggs.append(F.coalesce(F.sum(F.when(prev, F.col(m))), F.lit(0)).alias(f"{m}_prev"))
    aggs.append(F.coalesce(F.sum(F.when(cur, F.col(rows))), F.lit(0)).alias("rows_cur"))
    aggs.append(F.coalesce(F.sum(F.when(prev, F.col(rows))), F.lit(0)).alias("rows_prev"))
    return fact.filter(cur | prev).groupBy(entity).agg(*aggs)


def relative_change(current: Column, previous: Column) -> tuple[Column, Column, Column]:
    """(status, ratio, absolute): a zero base is not computable, never infinite."""
    status = (
        F.when(previous == 0, "not_computable").when(previous < 0, "negative-base").otherwise("defined")
    )
    return status, ratio6(current - previous, previous), current - previous


def target_gap(actual: Column, target: Column) -> tuple[Column, Column]:
    """(ratio, reason): defined only for a positive target."""
    ok = target > 0
    return F.when(ok, ratio6(actual - target, target)), F.when(~ok, F.lit("metric.targetNonPositive"))


def margin(revenue: Column, cost: Column) -> tuple[Column, Column]:
    """(ratio, reason): contribution over revenue, defined only for positive revenue."""
    ok = revenue > 0
    return F.when(ok, ratio6(revenue - cost, revenue)), F.when(~ok, F.lit("metric.revenueNonPositive"))


def previous_period_value(monthly: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``previous`` and ``status``: the value one calendar month earlier.

    A gap in the months gives a null, not the last month that has data. The
    window holds one row per month of a key.
    """
    w = W.partitionBy(*keys).orderBy("month_start")
    contiguous = F.lag("month_start").over(w) == F.add_months("month_start", -1)
    return monthly.withColumn("previous", F.when(contiguous, F.lag(value).over(w)))


def monotonic_trend(monthly: DataFrame, keys: Sequence[str], value: str, periods: int) -> DataFrame:
    """Strictly rising or falling totals over exactly ``periods`` complete months.

    ``monthly`` is (keys, month_start, value, rows, complete), one row per month
    of the wanted range. Returns (keys, direction) for keys that qualify.
    """
    w = W.partitionBy(*keys).orderBy("month_start")
    step = F.signum((F.col(value) - F.lag(value).over(w)).cast("double"))
    stepped = monthly.withColumn("_step", step)
    per_key = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("complete") & (F.col("rows") > 0)).alias("_complete"),
        F.min("_step").alias("_lo"),
        F.max("_step").alias("_hi"),
    )
    qualifies = (F.col("_n") == periods) & F.col("_complete") & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") != 0)
    direction = F.when(F.col("_lo") > 0, "up").otherwise("down")
    return per_key.filter(qualifies).select(*keys, direction.alias("direction"))


@F.pandas_udf(T.StringType())
def domain_ceiling(max_abs: pd.Series) -> pd.Series:
    """Smallest two-significant-digit number at or above ``1.1 * max_abs``; 10 for zero.

    Decimal texts of any size in and out; charts are few, so this runs on aggregated rows.
    """

    def ceiling(text: str | None) -> str | None:
        if text is None:
            return None
        stretched = _WIDE.multiply(abs(pydec.Decimal(text)), pydec.Decimal("1.1"))
        if stretched == 0:
            return "10"
        step = pydec.Decimal(1).scaleb(stretched.adjusted() - 1)
        whole = _WIDE.divide(stretched, step).to_integral_value(pydec.ROUND_CEILING, _WIDE)
        return plain(_WIDE.multiply(whole, step))

    return max_abs.map(ceiling, na_action="ignore")


def axis_domain(kind_is_bar: Column, low: Column, high: Column, data_min: Column, data_max: Column):
    """Display domain: zero baseline for bars, widened to the data, never degenerate."""
    lo = F.when(kind_is_bar & (low > 0), F.lit(0.0)).otherwise(low)
    hi = F.when(kind_is_bar & (high < 0), F.lit(0.0)).otherwise(high)
    lo, hi = F.least(lo, data_min), F.greatest(hi, data_max)
    pad = F.when(lo == 0, F.lit(1.0)).otherwise(F.abs(lo) * 0.1)
    return F.when(lo == hi, lo - pad).otherwise(lo), F.when(lo == hi, hi + pad).otherwise(hi)


def largest_remainder(rows: DataFrame, keys: Sequence[str], weight: str, total: str, order: str) -> DataFrame:
    """Add ``share``: whole parts of ``total`` by integer weight that add up exactly.

    Leftover units go to the largest remainders, ties to the smaller ``order``.
    Remainders are whole numbers, so rows are counted per remainder, and the one at
    which the leftover runs out is selected by a running total over those counts;
    only the rows tied at it are numbered. What is read more than once (the sums of a
    key, the rows with their parts, the counts) is written once.
    """
    keys = list(keys)
    sums = cut_lineage(rows.groupBy(*keys).agg(F.sum(weight).cast("long").alias("_w"), F.max(total).alias("_t"), F.count(F.lit(1)).alias("_n")))
    hot = cut_lineage(hot_keys(sums, keys, "_n"))
    joined = salted_join(rows, sums.drop("_n"), keys, hot, [order])
    product = F.col("_t").cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")
    divisor = F.col("_w").cast("decimal(38,0)")
    parts = joined.withColumn("_base", F.call_function("div", product, divisor)).withColumn(
        "_short", F.col("_w") - (product % divisor).cast("long")
    )
    parts = cut_lineage(parts.drop("_t", "_w"))
    per_short = cut_lineage(parts.groupBy(*keys, "_short").agg(F.count(F.lit(1)).alias("_c"), F.sum("_base").alias("_b")))
    given = null_safe_join(per_short.groupBy(*keys).agg(F.sum("_b").alias("_given")), sums, keys)
    left = given.select(*keys, (F.col("_t") - F.col("_given")).alias("_left"))
    filled = null_safe_join(running_total(per_short.drop("_b"), "_short", F.col("_c"), "_cum", keys), left, keys)
    cut = cut_lineage(
        filled.filter((F.col("_cum") >= F.col("_left")) & (F.col("_cum") - F.col("_c") < F.col("_left"))).select(
            *keys, F.col("_short").alias("_cut"), (F.col("_left") - F.col("_cum") + F.col("_c")).alias("_take")
        )
    )
    marked = salted_join(parts, cut, keys, hot, [order], "left")
    tied = cut_lineage(marked.filter(F.col("_short") == F.col("_cut")).select(*keys, order))
    ranked = null_safe_join(marked, with_ordinal(tied, order, keys, "_tie"), [*keys, order], "left")
    extra = (F.col("_short") < F.col("_cut")) | (F.col("_tie") <= F.col("_take"))
    share = F.col("_base") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return ranked.withColumn("share", share).drop("_base", "_short", "_cut", "_take", "_tie")


def weighted_rate(fact: DataFrame, keys: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Sum over sum per key: never the mean of row rates."""
    sums = fact.groupBy(*keys).agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"))
    return sums.withColumn("rate", ratio6(F.col("num"), F.col("den")))
