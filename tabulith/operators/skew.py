"""Joins that survive one key owning a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.operators.ordinals import null_safe_join

HOT_SHARE = 256
SALTS = 64


def hot_keys(groups: DataFrame, keys: Sequence[str], count: str, total: Column | None = None) -> DataFrame:
    """Keys with more than 1/256 of the counted rows: at most 256 of them exist.

    ``total`` may give the row count where it is cheaper than adding up ``groups``.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).scalar()
    return groups.filter(F.col(count) * HOT_SHARE > total).select(*keys)


def salted_join(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to one ``groups`` row per key, splitting the ``hot`` keys.

    ``hot`` comes from ``hot_keys``, so its size is bounded whatever the data and
    it is broadcast to both sides. Rows of a hot key are spread over 64 salts by a
    hash of ``spread``; the matching group row is copied per salt. Cold keys keep
    salt 0 and join as usual.
    """
    keys = list(keys)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    zero = F.lit(0).cast("long")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(SALTS))
    tagged = null_safe_join(rows, marked, keys, "left")
    tagged = tagged.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(zero)).drop("_hot")
    every = F.sequence(zero, F.lit(SALTS - 1).cast("long"))
    copied = null_safe_join(groups, marked, keys, "left")
    copied = copied.withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(zero)))).drop("_hot")
    return null_safe_join(tagged, copied, [*keys, "_salt"], how).drop("_salt")
