"""Running totals over a whole table without a single-task sort.

Row numbers are whole numbers, so their high bits form a fixed tree: rows fall
in blocks of 65,536 consecutive numbers, blocks in super-blocks of 65,536
blocks. Every window below is partitioned by such a node, hence holds at most
65,536 entries no matter how many rows a key owns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BITS = 16


def block_of(row: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(row.cast("long"), bits)


def _block_offsets(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``_node`` (keys and block): its own total and that of every earlier block."""
    blocks = (
        tagged.groupBy("_node")
        .agg(F.sum("_v").alias("_inside"))
        .withColumn("_block", F.col("_node._block"))
        .withColumn("_parent", F.struct(*[F.col(f"_node.{k}").alias(k) for k in keys], block_of(F.col("_block")).alias("_super")))
    )
    before = W.partitionBy("_parent").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_inside").over(before), F.lit(0)))
    supers = blocks.groupBy("_parent").agg(F.sum("_inside").alias("_sv"))
    family = [F.col(f"_parent.{k}") for k in keys] or [F.lit(0)]
    earlier = W.partitionBy(*family).orderBy("_parent._super").rowsBetween(W.unboundedPreceding, -1)
    supers = supers.withColumn("_earlier", F.coalesce(F.sum("_sv").over(earlier), F.lit(0))).drop("_sv")
    return blocks.join(supers, "_parent").select(
        "_node", "_inside", (F.col("_before") + F.col("_earlier")).alias("_offset")
    )


def _tagged(df: DataFrame, order: str, value: Column, keys: Sequence[str]) -> DataFrame:
    node = F.struct(*[F.col(k).alias(k) for k in keys], block_of(F.col(order)).alias("_block"))
    return df.withColumn("_v", value).withColumn("_node", node)


def running_total(
    df: DataFrame,
    order: str,
    value: Column,
    out: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: the total of ``value`` over this row and every earlier one.

    ``order`` must be a whole-number column, unique within ``keys``. The window,
    the block totals and the join back share one partitioning, so the rows are
    shuffled once.
    """
    keys = list(keys)
    tagged = _tagged(df, order, value, keys)
    inside = W.partitionBy("_node").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.withColumn("_local", F.sum("_v").over(inside))
    joined = local.join(_block_offsets(tagged, keys).drop("_inside"), "_node")
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).select(*df.columns, out)


def with_ordinal(df: DataFrame, order: str, keys: Sequence[str] = (), out: str = "ordinal") -> DataFrame:
    """Add the 1-based position of each row in ``order`` within ``keys``."""
    return running_total(df, order, F.lit(1).cast("long"), out, keys)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns where null matches null; keeps the left copy.

    The keys are compared as one struct: its fields may be null, the struct never
    is, so this stays an ordinary hash-partitioned join.
    """
    l = left.withColumn("_on", F.struct(*[F.col(c).alias(c) for c in on]))
    r = right.withColumn("_on", F.struct(*[F.col(c).alias(c) for c in on])).drop(*on)
    return l.join(r, "_on", how).drop("_on")


def page_blocks(df: DataFrame, order: str) -> DataFrame:
    """Row counts per block with running offsets: what ``page`` needs to find its blocks."""
    return _block_offsets(_tagged(df.select(order), order, F.lit(1).cast("long"), []), [])


def page(df: DataFrame, order: str, offset: int, size: int, blocks: DataFrame | None = None) -> DataFrame:
    """Rows ``offset`` .. ``offset + size - 1`` in ``order`` (unique whole numbers).

    Only per-block counts are ranked. Every block kept holds at least one row of
    the page, so at most ``size`` blocks survive; that short list is broadcast and
    the other rows are dropped where they are read, before any sort.
    """
    tagged = _tagged(df, order, F.lit(1).cast("long"), [])
    touched = (page_blocks(df, order) if blocks is None else blocks).filter(
        (F.col("_offset") < offset + size) & (F.col("_offset") + F.col("_inside") > offset)
    )
    kept = tagged.join(F.broadcast(touched), "_node")
    position = F.col("_offset") + F.row_number().over(W.partitionBy("_node").orderBy(order))
    ranked = kept.withColumn("_position", position)
    return ranked.filter(F.col("_position").between(offset + 1, offset + size)).select(*df.columns)


def systematic_sample(df: DataFrame, order: str, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Evenly spaced rows per key: positions ``floor(i * n / size)`` for i < size.

    Keys with at most ``size`` rows keep them all.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = null_safe_join(with_ordinal(df, order, keys, "_ordinal"), counts, keys) if keys else (
        with_ordinal(df, order, keys, "_ordinal").withColumn("_n", counts.select("_n").scalar())
    )
    k = F.col("_ordinal") - 1
    step = F.col("_n") / F.lit(float(size))
    guess = F.ceil(k / step)
    # One of the neighbours of k / step is the only index that can land on k.
    lands = F.lit(False)
    for i in (guess - 1, guess, guess + 1):
        lands = lands | ((i >= 0) & (i < size) & (F.floor(i * step) == k))
    return ranked.filter((F.col("_n") <= size) | lands).drop("_ordinal", "_n")
