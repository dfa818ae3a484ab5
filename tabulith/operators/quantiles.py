"""Exact type-7 quantiles per group by radix selection, without ordering a group's values.

One pass counts the rows of every group by the length and the leading digits of their
values: a few hundred buckets, in the order of the values, each with its count, its
smallest and its largest value. The bucket that holds a wanted rank is the next
bracket. Brackets of few rows are ranked; larger ones are counted again by the
leading digits of the distance from their smallest value, so values that share a long
prefix spread out as well. All groups and probabilities are narrowed together. The
table is scanned twice: once for the first counts, once for the rows inside the first
brackets, equal values collapsed; every further pass reads only what that left.
A bracket whose smallest and largest value are equal is an answer, however many rows
it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.decimals import dec_add, dec_mul, dec_sub
from tabulith.operators.ordinals import null_safe_join
from tabulith.operators.skew import hot_keys, salted_join
from tabulith.session import cut_lineage

#: Leading digits that one pass tells apart, and distinct values of a bracket that are ranked.
DIGITS, FEW = 4, 10_000


def _code(value: Column) -> Column:
    """A whole number in the order of the decimals: sign, how many digits, the first of them."""
    digits = F.regexp_replace(F.regexp_replace(F.abs(value).cast("string"), r"\.", ""), "^0+", "")
    size = F.length(digits).cast("long") * 10**DIGITS + F.substring(F.rpad(digits, DIGITS, "0"), 1, DIGITS).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).when(value < 0, -size).otherwise(size)


def _counted(rows: DataFrame, keys: list[str], by: list[str], code: Column, weight: Column) -> DataFrame:
    """Buckets: their rows, smallest and largest value, and how many rows of the bracket lie in earlier buckets."""
    buckets = cut_lineage(
        rows.withColumn("_code", code).groupBy(*keys, *by, "_code").agg(F.sum(weight).alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    )
    earlier = W.partitionBy(*keys, *by).orderBy("_code").rowsBetween(W.unboundedPreceding, -1)
    return buckets.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))


def _first(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    rows = df.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    return rows, _counted(rows, keys, [], _code(F.col("v")), F.lit(1).cast("long"))


def _sizes(buckets: DataFrame, keys: list[str]) -> DataFrame:
    return buckets.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max"))


def _select(rows: DataFrame, buckets: DataFrame, wanted: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """(keys, rank, value) of the wanted ranks (keys, rank)."""
    rank_in = (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_c"))
    found = null_safe_join(buckets, wanted.groupBy(*keys).agg(F.collect_set("rank").alias("_ranks")), keys)
    inside = found.withColumn("rank", F.explode("_ranks")).filter(rank_in)
    # ``below`` rows of the group lie under the bracket; ``_lo`` names it.
    brackets = cut_lineage(inside.select(*keys, "rank", F.col("_before").alias("below"), F.col("_lo"), F.col("_hi")))
    done = [brackets.filter("_lo = _hi").select(*keys, "rank", F.col("_lo").alias("value"))]
    left = brackets.filter("_lo < _hi")
    held = None
    while not left.isEmpty():
        if held is None:
            spans = left.groupBy(*keys).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_spans"))
            kept = salted_join(rows, spans, keys, hot, ["v"]).select(
                *keys, "v", F.explode(F.filter("_spans", lambda s: F.col("v").between(s["_lo"], s["_hi"]))).alias("_s")
            )
            kept = kept.select(*keys, F.col("_s._lo").alias("_at"), "v").groupBy(*keys, "_at", "v").agg(F.count("*").alias("c"))
        else:
            named = left.select(*keys, F.col("_from").alias("_at"), F.col("_lo").alias("_new"), "_hi").distinct()
            kept = null_safe_join(held, named.withColumnRenamed("_hi", "_top"), [*keys, "_at"]).filter(F.col("v").between(F.col("_new"), F.col("_top")))
            kept = kept.select(*keys, F.col("_new").alias("_at"), "v", "c")
        held = cut_lineage(kept)
        values = held.groupBy(*keys, "_at").agg(F.count("*").alias("_distinct"))
        asked = null_safe_join(left.withColumn("_at", F.col("_lo")), values, [*keys, "_at"])
        asked = cut_lineage(asked.select(*keys, "_at", "rank", "below", (F.col("_distinct") <= FEW).alias("_few")))
        small = asked.filter("_few").groupBy(*keys, "_at").agg(F.collect_list(F.struct("rank", "below")).alias("_asked"))
        upto = W.partitionBy(*keys, "_at").orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # at most FEW values
        ranked = null_safe_join(held, small, [*keys, "_at"]).withColumn("_upto", F.sum("c").over(upto))
        hit = ranked.select(*keys, "v", "c", "_upto", F.explode("_asked").alias("a")).filter(
            (F.col("a.rank") - F.col("a.below") > F.col("_upto") - F.col("c")) & (F.col("a.rank") - F.col("a.below") <= F.col("_upto"))
        )
        done.append(cut_lineage(hit.select(*keys, F.col("a.rank").alias("rank"), F.col("v").alias("value"))))
        large = asked.filter("not _few")
        if large.isEmpty():
            break
        wide = null_safe_join(held, large.select(*keys, "_at").distinct(), [*keys, "_at"])
        finer = _counted(wide, keys, ["_at"], _code(F.col("v") - F.col("_at")), F.col("c"))
        per = large.groupBy(*keys, "_at").agg(F.collect_list(F.struct("rank", "below")).alias("_asked"))
        split = null_safe_join(finer, per, [*keys, "_at"]).withColumn("a", F.explode("_asked"))
        rest = F.col("a.rank") - F.col("a.below")
        left = cut_lineage(
            split.filter((rest > F.col("_before")) & (rest <= F.col("_before") + F.col("_c"))).select(
                *keys, F.col("_at").alias("_from"), F.col("a.rank").alias("rank"), (F.col("a.below") + F.col("_before")).alias("below"), "_lo", "_hi"
            )
        )
        done.append(left.filter("_lo = _hi").select(*keys, "rank", F.col("_lo").alias("value")))
        left = left.filter("_lo < _hi")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[str]) -> DataFrame:
    """(keys, p, n, quantile): ``lo + g * (hi - lo)`` in exact decimals.

    ``value`` must be a DecimalType column; nulls are left out.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probabilities).drop("_all")
    rows, buckets = _first(df, list(keys), value)
    return _quantiles(rows, buckets, list(keys), probabilities)


def _quantiles(rows: DataFrame, buckets: DataFrame, keys: list[str], probabilities: Sequence[str]) -> DataFrame:
    sizes = cut_lineage(_sizes(buckets, keys))

    def target(p: str) -> Column:
        h = (F.col("n") - 1).cast("decimal(18,0)") * F.lit(Decimal(p)).cast("decimal(20,10)") + 1
        rank = F.greatest(F.lit(1), F.least(F.floor(h), F.col("n") - 1)).cast("long")
        return F.struct(F.lit(p).alias("p"), rank.alias("rank"), F.least(rank + 1, F.col("n")).alias("upper"), (h - rank).cast("decimal(20,10)").alias("g"))

    targets = cut_lineage(sizes.select(*keys, "n", F.explode(F.array(*[target(p) for p in probabilities])).alias("t")).select(*keys, "n", "t.*"))
    wanted = targets.select(*keys, F.explode(F.array("rank", "upper")).alias("rank")).distinct()
    values = _select(rows, buckets, wanted, keys, hot_keys(sizes, keys, "n"))
    low = null_safe_join(targets, values.withColumnRenamed("value", "_lo"), [*keys, "rank"])
    both = null_safe_join(low, values.select(*keys, F.col("rank").alias("upper"), F.col("value").alias("_hi")), [*keys, "upper"])
    # The digits of p add to those of the value; the sum is taken on texts, so none is lost on the way.
    scale = rows.schema["v"].dataType.scale
    digits = max((max(0, -Decimal(p).normalize().as_tuple().exponent) for p in probabilities), default=0)
    wide = f"decimal(38,{min(38, max(scale + digits, min(scale + 6, 30)))})"
    lo, hi = F.col("_lo").cast("string"), F.col("_hi").cast("string")
    exact = dec_add(lo, dec_mul(F.col("g").cast("string"), dec_sub(hi, lo)))
    return both.select(*keys, "p", "n", exact.cast(wide).alias("quantile"))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, min, max, median and quartiles per group."""
    keys = list(keys)
    rows, buckets = _first(df, keys, value)
    q = _quantiles(rows, buckets, keys, ("0.25", "0.5", "0.75"))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    wide = q.groupBy(*keys).agg(at("0.25").alias("q1"), at("0.5").alias("median"), at("0.75").alias("q3"))
    base = _sizes(buckets, keys).select(*keys, F.col("n").alias("count"), F.col("_min").alias("min"), F.col("_max").alias("max"))
    return null_safe_join(base, wide, keys)


def outliers(
    df: DataFrame, keys: Sequence[str], value: str, row: str, min_rows: int, multiplier: int
) -> DataFrame:
    """Rows outside ``q1 - m*iqr .. q3 + m*iqr`` in groups that qualify.

    A group needs ``min_rows`` values and a positive interquartile range.
    """
    keys = list(keys)
    stats = cut_lineage(describe(df, keys, value))
    iqr = F.col("q3") - F.col("q1")
    fences = stats.filter((F.col("count") >= min_rows) & (F.col("q3") > F.col("q1"))).select(
        *keys, (F.col("q1") - iqr * multiplier).alias("lower"), (F.col("q3") + iqr * multiplier).alias("upper")
    )
    rows = df.select(*keys, row, value)
    flagged = salted_join(rows, fences, keys, hot_keys(stats, keys, "count"), [row])
    return flagged.filter((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
