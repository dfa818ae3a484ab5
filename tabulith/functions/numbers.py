"""Localized number text: declared separators, never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import compare_decimal, hundredth, is_decimal, is_multiple_of, normalize_decimal
from tabulith.functions.text import trim_blanks
from tabulith.policy import POLICY

# Digits, separators, dashes, blanks and direction marks.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_ARABIC_INDIC = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
SEPARATORS = "٫٬−–—٪"
ASCII_SEPARATORS = ".,---%"
REMOVED = (
    "[ \\u00A0\\u2000-\\u200A\\u202F\\u3000"
    "\\u200E\\u200F\\u061C\\u2066-\\u2069]"
)


def normalize_numeric_text(s: Column) -> Column:
    """ASCII digits and separators; blanks and direction marks removed."""
    mapped = F.translate(
        s,
        ARABIC_INDIC + EXTENDED_ARABIC_INDIC + SEPARATORS,
        ASCII_DIGITS + ASCII_DIGITS + ASCII_SEPARATORS,
    )
    return F.regexp_replace(mapped, REMOVED, "")


def with_localized(df: DataFrame, source: str, value: str = "value", reason: str = "reason") -> DataFrame:
    """Add a canonical decimal and, exactly where there is none, the reason.

    Reasons are ``invalid-number`` and ``ambiguous-number``. Commas count as
    grouping only in complete three-digit groups before any point. The cleaned
    text is its own projection, so it is computed once per row.
    """
    n = F.col("_n")
    has_comma, has_dot = n.contains(","), n.contains(".")
    why = (
        F.when(n.isNull() | n.isin("", "-", "."), "invalid-number")
        .when(n.rlike(r"[^0-9,.\-]"), "invalid-number")
        .when(n.rlike(r"^.+-"), "invalid-number")
        .when(has_comma & has_dot & ~n.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*\.[0-9]+\z"), "ambiguous-number")
        .when(has_comma & ~has_dot & ~n.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+\z"), "ambiguous-number")
        .when(~has_comma & ~n.rlike(r"^-?([0-9]+(\.[0-9]+)?|\.[0-9]+)\z"), "invalid-number")
    )
    cleaned = df.withColumn("_n", normalize_numeric_text(F.col(source))).withColumn(reason, why)
    bare = F.regexp_replace(F.regexp_replace(n, ",", ""), r"^(-?)\.", "$10.")
    led = cleaned.withColumn("_n", F.when(F.col(reason).isNull(), F.regexp_replace(bare, r"^(-?)0+([0-9])", "$1$2")))
    return led.withColumn(value, normalize_decimal(F.col("_n"))).drop("_n")


def with_percent(df: DataFrame, source: str, out: str = "fraction") -> DataFrame:
    """Add the fraction of a typed percent, null when out of range or off the step."""
    bare = F.regexp_replace(trim_blanks(F.col(source)), r"%\z|^%", "")
    parsed = with_localized(df.withColumn("_p", bare), "_p", "_v", "_why")
    sized = parsed.withColumn("_f", F.when(is_decimal(F.col("_v")), hundredth(F.col("_v"))))
    low, high = F.lit(str(POLICY.scenario_min)), F.lit(str(POLICY.scenario_max))
    inside = (compare_decimal(F.col("_f"), low) >= 0) & (compare_decimal(F.col("_f"), high) <= 0)
    ok = inside & is_multiple_of(F.col("_f"), str(POLICY.scenario_step))
    return sized.withColumn(out, F.when(ok, F.col("_f"))).drop("_p", "_v", "_why", "_f")
