"""Exact decimals carried as canonical text.

Text up to 100 characters is the interchange form. Row-level work stays in JVM
expressions (pattern tests, limb sums); the arbitrary-width arithmetic helpers
are Arrow-batched and meant for aggregated, metric-sized frames.
"""

from __future__ import annotations

import decimal as pydec

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The decimal text form.
DECIMAL_PATTERN = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?\z"
NEGATIVE_ZERO = r"^-0(\.0+)?\z"
MAX_LENGTH = 100

LIMB = 18
LIMBS_PER_SIDE = 6


def is_decimal_shape(s: Column) -> Column:
    """Pattern and length only; negative zero still passes."""
    return s.rlike(DECIMAL_PATTERN) & (F.length(s) <= MAX_LENGTH)


def is_decimal(s: Column) -> Column:
    """True for a decimal text that is not a negative zero; null stays false."""
    return F.coalesce(is_decimal_shape(s) & ~s.rlike(NEGATIVE_ZERO), F.lit(False))


def normalize_decimal(s: Column) -> Column:
    """Strip trailing fraction zeros and fold a negative zero."""
    bare = F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*[1-9])0+\z", "$1"), r"\.0+\z", "")
    return F.when(bare == "-0", F.lit("0")).otherwise(bare)


def is_canonical(s: Column) -> Column:
    return F.coalesce(is_decimal_shape(s) & (normalize_decimal(s) == s), F.lit(False))


def significant_digits(s: Column) -> Column:
    """Digits as written: trailing fraction zeros count, leading zeros do not."""
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return F.greatest(F.lit(1), F.length(F.regexp_replace(digits, r"^0+", "")))


def _integer_digits(s: Column) -> Column:
    return F.regexp_extract(s, r"^-?([0-9]+)", 1)


def _fraction_digits(s: Column) -> Column:
    return F.regexp_extract(s, r"\.([0-9]+)\z", 1)


def order_key(s: Column) -> Column:
    """Text whose byte order is the numeric order of the decimal texts."""
    magnitude = F.concat(
        F.lpad(_integer_digits(s), MAX_LENGTH, "0"), F.rpad(_fraction_digits(s), MAX_LENGTH, "0")
    )
    negative = s.startswith("-") & ~s.rlike(NEGATIVE_ZERO)
    flipped = F.concat(F.lit("0"), F.translate(magnitude, "0123456789", "9876543210"))
    return F.when(negative, flipped).otherwise(F.concat(F.lit("1"), magnitude))


def compare_decimal(a: Column, b: Column) -> Column:
    ka, kb = order_key(a), order_key(b)
    return F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0)


def is_zero(s: Column) -> Column:
    return s.rlike(r"^-?0(\.0+)?\z")


def is_integer(s: Column) -> Column:
    return is_decimal_shape(s) & ~normalize_decimal(s).contains(".")


def abs_decimal(s: Column) -> Column:
    return F.regexp_replace(s, r"^-", "")


def fraction_scale(s: Column) -> Column:
    return F.length(_fraction_digits(s))


def format_scale(s: Column, scale: Column) -> Column:
    """Pad the fraction to ``scale`` digits; never rounds a digit away."""
    have = fraction_scale(s)
    whole = F.regexp_extract(s, r"^(-?[0-9]+)", 1)
    padded = F.concat(whole, F.lit("."), F.rpad(_fraction_digits(s), scale.cast("int"), "0"))
    return F.when((have >= scale) | (scale == 0), s).otherwise(padded)


def digits_at_scale(s: Column, scale: int) -> Column:
    """The digits of ``|s| * 10 ** scale``; for values whose minimal form has no more fraction digits."""
    plain = normalize_decimal(s)
    return F.concat(_integer_digits(plain), F.rpad(_fraction_digits(plain), scale, "0"))


def remainder_of_digits(digits: Column, divisor: int) -> Column:
    """Remainder of a whole number of any length, nine digits at a time (``divisor`` up to 18 digits)."""
    limbs = F.ceil(F.length(digits) / 9).cast("int")
    padded = F.lpad(digits, limbs * 9, "0")
    parts = F.transform(F.sequence(F.lit(0), limbs - 1), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)).cast("decimal(38,0)"))
    wide = lambda x: x.cast("decimal(38,0)")
    step = lambda rest, part: wide((wide(rest * F.lit(10**9).cast("decimal(10,0)")) + part) % F.lit(divisor).cast("decimal(18,0)"))
    return F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), step)


def is_multiple_of(s: Column, step: str) -> Column:
    """Exact multiple test on the digits, for decimal texts of any length."""
    unit = pydec.Decimal(step).normalize()
    scale = max(0, -unit.as_tuple().exponent)
    fits = fraction_scale(normalize_decimal(s)) <= scale
    whole = remainder_of_digits(digits_at_scale(s, scale), int(unit.scaleb(scale))) == 0
    return F.coalesce(is_decimal_shape(s) & F.when(is_decimal_shape(s) & fits, whole).otherwise(False), F.lit(False))


def hundredth(s: Column) -> Column:
    """A decimal text with its point moved two places to the left."""
    whole = F.lpad(_integer_digits(s), F.greatest(F.length(_integer_digits(s)), F.lit(3)), "0")
    moved = F.concat(F.substring(whole, F.lit(1), F.length(whole) - 2), F.lit("."), F.substring(whole, F.length(whole) - 1, F.lit(2)), _fraction_digits(s))
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return normalize_decimal(F.concat(sign, moved))


def quantize_money(value: Column, places: int) -> Column:
    """Half-up rounding of a DecimalType value to ``places`` fraction digits."""
    return F.round(value, places).cast(f"decimal(38,{places})")


def results_agree(a: Column, b: Column) -> Column:
    """Scale-tolerant equality; two nulls agree, a null and a value do not."""
    both = a.isNotNull() & b.isNotNull()
    same = is_decimal(a) & is_decimal(b) & (normalize_decimal(a) == normalize_decimal(b))
    return F.when(both, same).otherwise(a.isNull() & b.isNull())


# --- exact sums -----------------------------------------------------------


def with_exact_parts(df: DataFrame, text: Column, ok: Column, prefix: str) -> DataFrame:
    """Stage the whole-number parts of a decimal text for an exact sum.

    Values of up to 18 digits on each side of the point become two longs. Wider
    ones keep all their digits, padded to 108 on each side. Rows where ``ok`` is
    false have neither.
    """
    i, f, w = f"{prefix}_i", f"{prefix}_f", f"{prefix}_w"
    staged = df.withColumn(w, F.when(ok, text))
    whole, fraction = _integer_digits(F.col(w)), _fraction_digits(F.col(w))
    staged = staged.withColumn(i, whole).withColumn(f, fraction)
    narrow = (F.length(i) <= LIMB) & (F.length(f) <= LIMB)
    sign = F.when(F.col(w).startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    width = LIMB * LIMBS_PER_SIDE
    digits = F.concat(F.lpad(i, width, "0"), F.rpad(f, width, "0"))
    return staged.withColumns(
        {
            w: F.when(~narrow, digits),
            i: F.when(narrow, F.col(i).cast("long") * sign),
            f: F.when(narrow, F.rpad(f, LIMB, "0").cast("long") * sign),
            f"{prefix}_s": sign,
        }
    )


def limb_aggregates(prefix: str, out: str) -> list[Column]:
    """Partial-aggregable exact sum over the columns ``with_exact_parts`` staged.

    Twelve 18-digit limbs are summed on their own, six before and six after the
    point; ordinary values only touch the two next to the point. ``combine_limbs``
    rebuilds the total on the aggregated row. 10^20 rows fit before a limb's sum
    could overflow, which would raise, never wrap.
    """
    near = {LIMBS_PER_SIDE - 1: f"{prefix}_i", LIMBS_PER_SIDE: f"{prefix}_f"}
    sums = []
    for p in range(2 * LIMBS_PER_SIDE):
        limb = f"cast(substring({prefix}_w, {p * LIMB + 1}, {LIMB}) as bigint) * {prefix}_s"
        if p in near:
            limb = f"coalesce({near[p]}, {limb})"
        sums.append(F.expr(f"sum(cast({limb} as decimal(28,0))) as {out}{p}"))
    return sums


def combine_limbs(prefix: str) -> Column:
    """Exact canonical total from the columns ``limb_aggregates`` made."""
    return _join_limbs(F.expr("array(" + ", ".join(f"cast({prefix}{i} as string)" for i in range(2 * LIMBS_PER_SIDE)) + ")"))


def _context(precision: int) -> pydec.Context:
    return pydec.Context(
        prec=precision, rounding=pydec.ROUND_HALF_UP, Emin=-999_999, Emax=999_999, traps=[pydec.InvalidOperation]
    )


_WIDE = _context(400)


def plain(value: pydec.Decimal) -> str:
    """Canonical text of a Python decimal: no exponent, minimal scale, no -0."""
    if value == 0:
        return "0"
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


@F.pandas_udf(T.StringType())
def _join_limbs(limbs: pd.Series) -> pd.Series:
    def total(parts) -> str | None:
        if parts is None or all(p is None for p in parts):
            return None
        acc = pydec.Decimal(0)
        for i, part in enumerate(parts):
            exponent = LIMB * (LIMBS_PER_SIDE - 1 - i)
            acc = _WIDE.add(acc, _WIDE.scaleb(pydec.Decimal(part or 0), exponent))
        return plain(acc)

    return limbs.map(total)


# --- arbitrary-width arithmetic on aggregated rows -------------------------


def _pairwise(a: pd.Series, b: pd.Series, op) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        return op(pydec.Decimal(x), pydec.Decimal(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.StringType())
def dec_add(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, lambda x, y: plain(_WIDE.add(x, y)))


@F.pandas_udf(T.StringType())
def dec_sub(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, lambda x, y: plain(_WIDE.subtract(x, y)))


@F.pandas_udf(T.StringType())
def dec_mul(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairwise(a, b, lambda x, y: plain(_WIDE.multiply(x, y)))


@F.pandas_udf(T.StringType())
def dec_div(a: pd.Series, b: pd.Series) -> pd.Series:
    """Quotient at 40 significant digits, half-up; null for a zero divisor."""
    forty = _context(40)
    return _pairwise(a, b, lambda x, y: None if y == 0 else plain(forty.divide(x, y)))


@F.pandas_udf(T.StringType())
def dec_quantize(value: pd.Series, places: pd.Series) -> pd.Series:
    """A decimal text with exactly ``places`` fraction digits, rounded half-up."""

    def one(x, p):
        return None if x is None or pd.isna(p) else format(pydec.Decimal(x).quantize(pydec.Decimal(1).scaleb(-int(p)), context=_WIDE), "f")

    return pd.Series([one(x, p) for x, p in zip(value, places)], dtype=object)


def ratio6(num: Column, den: Column) -> Column:
    """Ratio rounded half-up to six places as a double; null for a zero divisor.

    Both sides are whole numbers (cents, counts). The quotient is taken as an
    integer number of millionths, so every engine reproduces it bit for bit.
    """
    a, b = F.abs(num.cast("decimal(38,0)")), F.abs(den.cast("decimal(38,0)"))
    divisor = F.when(b != 0, b * 2)
    millionths = F.call_function("div", (a * 2_000_000 + b).cast("decimal(38,0)"), divisor.cast("decimal(38,0)"))
    sign = F.when((num < 0) != (den < 0), F.lit(-1)).otherwise(F.lit(1))
    return (millionths * sign).cast("double") / F.lit(1e6)
