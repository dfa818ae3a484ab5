"""Row spans: sorted, disjoint, non-adjacent inclusive ranges of source rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import span_token
from tabulith.operators.ordinals import BLOCK_BITS, block_of, null_safe_join, running_total
from tabulith.session import cut_lineage

LEVELS = (BLOCK_BITS, 2 * BLOCK_BITS, 62)


def _merge_adjacent(items: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Merge touching spans whose starts share one 2^bits block."""
    items = items.withColumn("_node", F.shiftright("start", bits))
    ordered = W.partitionBy(*keys, "_node").orderBy("start")
    opens = F.coalesce(F.col("start") != F.lag("end").over(ordered) + 1, F.lit(True))
    chained = items.withColumn("_open", opens.cast("long"))
    running = ordered.rowsBetween(W.unboundedPreceding, 0)
    chained = chained.withColumn("_chain", F.sum("_open").over(running))
    return (
        chained.groupBy(*keys, "_node", "_chain")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(*keys, "start", "end")
    )


def to_spans(df: DataFrame, row: str, keys: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """Compress the rows of each key to spans: (keys, start, end).

    Gaps are never merged. Islands are built inside blocks of 65,536 row numbers
    and only those that touch a block edge go on to the next level, so no window
    ever sees more than 131,072 entries, however long a key's run is.
    Set ``distinct=False`` when rows are known to be unique per key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(row).cast("long").alias("start"))
    if distinct:
        rows = rows.distinct()
    level = rows.withColumn("end", F.col("start"))
    done: list[DataFrame] = []
    for i, bits in enumerate(LEVELS):
        merged = _merge_adjacent(level, keys, bits)
        if i + 1 == len(LEVELS):
            done.append(merged)
            break
        if i == 0:  # read by every level after it
            merged = cut_lineage(merged)
        edge = (F.lit(1).cast("long") * (1 << bits)).cast("long")
        touches = (F.pmod(F.col("start"), edge) == 0) | (F.pmod(F.col("end") + 1, edge) == 0)
        done.append(merged.filter(~touches))
        level = merged.filter(touches)
    return reduce(DataFrame.unionByName, done)


def span_summary(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of spans and of rows per key."""
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start") + 1).alias("row_count")
    )


def oversized(spans: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Selections that must not be expanded: malformed spans or too many rows.

    The check is arithmetic on the bounds, so nothing is expanded to find out.
    """
    bad = (F.col("start") > F.col("end")) | (F.col("start") < 1) | F.col("start").isNull() | F.col("end").isNull()
    checked = spans.groupBy(*keys).agg(
        F.bool_or(bad).alias("malformed"),
        F.sum((F.col("end") - F.col("start") + 1).cast("decimal(38,0)")).alias("row_count"),
    )
    reason = F.when(F.col("malformed"), "span-invalid").when(F.col("row_count") > max_rows, "span-overflow")
    return checked.withColumn("reason", reason).filter("reason is not null").select(*keys, "reason")


# Rows and spans meet in cells of 64 row numbers: a span is cut into at most one
# piece per cell, and a row is compared with the few pieces of its own cell.
JOIN_BITS = 6


def _pieces(spans: DataFrame, bits: int) -> DataFrame:
    """Cut each span at the edges of 2^bits cells: (_cell, _lo, _hi) per piece.

    Cells are listed block by block, so no array grows with a span's length.
    """
    coarse = max(bits, BLOCK_BITS)
    cut = spans.withColumn("_block", F.explode(F.sequence(block_of(F.col("start"), coarse), block_of(F.col("end"), coarse))))
    low = F.shiftleft(F.col("_block"), coarse)
    cut = cut.withColumn("_lo", F.greatest(F.col("start"), low)).withColumn(
        "_hi", F.least(F.col("end"), low + ((1 << coarse) - 1))
    )
    if bits == coarse:
        return cut.withColumnRenamed("_block", "_cell")
    fine = cut.withColumn("_cell", F.explode(F.sequence(block_of(F.col("_lo"), bits), block_of(F.col("_hi"), bits))))
    first = F.shiftleft(F.col("_cell"), bits)
    return fine.withColumn("_lo", F.greatest("_lo", first)).withColumn(
        "_hi", F.least(F.col("_hi"), first + ((1 << bits) - 1))
    ).drop("_block")


def expand_spans(spans: DataFrame, out: str = "source_row") -> DataFrame:
    """One row per covered source row; arrays never exceed one block."""
    return _pieces(spans, BLOCK_BITS).withColumn(out, F.explode(F.sequence("_lo", "_hi"))).drop("_cell", "_lo", "_hi")


def join_spans(rows: DataFrame, spans: DataFrame, row: str = "source_row") -> DataFrame:
    """Range join ``row`` in [start, end] as an equi-join on the row's cell."""
    s = _pieces(spans, JOIN_BITS)
    r = rows.withColumn("_cell", block_of(F.col(row), JOIN_BITS))
    inside = (r["_cell"] == s["_cell"]) & r[row].between(s["_lo"], s["_hi"])
    return r.join(s, inside).drop("_cell", "_lo", "_hi")


SIDE = 31


def combine(a: DataFrame, b: DataFrame | None, keys: Sequence[str], op: str, shared: bool = False) -> DataFrame:
    """Set algebra on spans: ``union``, ``intersect`` or ``difference`` (a without b) per key, as canonical spans.

    The ends of all spans are swept in their order: how many spans of either side are
    open is a running total over the blocks of row numbers, and the result opens and
    closes where the wanted relation of the two turns true or false. The n-th opening
    belongs to the n-th closing. Spans may overlap, touch and repeat; no window holds
    more than a block and no row is expanded. With ``shared`` the side ``b`` has no
    keys and stands against every key of ``a`` (its parts within a key's reach only).
    """
    keys = list(keys)
    if b is not None and shared:
        b = _near(a, b, keys)

    def ends(spans: DataFrame, weight: int) -> DataFrame:
        edge = lambda at, step: F.struct(at.cast("long").alias("at"), F.lit(step).cast("long").alias("step"))
        return spans.select(*keys, F.explode(F.array(edge(F.col("start"), weight), edge(F.col("end") + 1, -weight))).alias("e")).select(*keys, "e.*")

    # Both depths in one number: a's in the low bits, b's above them.
    swept = ends(a, 1) if b is None else ends(a, 1).unionByName(ends(b, 1 << SIDE))
    # A running total reads its rows twice, so the ends, and later the turns, are written first.
    at = cut_lineage(swept.groupBy(*keys, "at").agg(F.sum("step").alias("step")).filter("step <> 0"))
    depth = running_total(at, "at", F.col("step"), "depth", keys)
    in_a = lambda d: d.bitwiseAND(F.lit((1 << SIDE) - 1)) > 0
    in_b = lambda d: F.shiftright(d, SIDE) > 0
    test = {"union": lambda d: in_a(d) | in_b(d), "intersect": lambda d: in_a(d) & in_b(d), "difference": lambda d: in_a(d) & ~in_b(d)}[op]
    turns = cut_lineage(depth.select(*keys, "at", test(F.col("depth") - F.col("step")).alias("_was"), test(F.col("depth")).alias("_is")).filter("_was <> _is"))
    paired = running_total(turns, "at", F.col("_is").cast("long"), "_nth", keys)
    return paired.groupBy(*keys, "_nth").agg(F.min("at").alias("start"), (F.max("at") - 1).alias("end")).drop("_nth")


def _near(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of ``b`` that lie in a block some key of ``a`` has spans in, once per such key."""
    reach = F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("end")))).alias("_block")
    asked = a.select(*keys, reach).distinct()
    cut = b.select("start", "end", reach)
    low = F.shiftleft(F.col("_block"), BLOCK_BITS)
    parts = cut.select("_block", F.greatest("start", low).alias("start"), F.least("end", low + ((1 << BLOCK_BITS) - 1)).alias("end"))
    return asked.join(parts, "_block").select(*keys, "start", "end")


def check_spans(spans: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Violations of canonical form: (key, rule, start).

    ``spans`` holds (key, ordinal, start, end) as declared and ``declared`` the
    stated ``row_count`` per key. The neighbour is found by an equi-join on the
    previous ordinal, so a key with many spans is still spread out.
    """
    prev = spans.select(key, (F.col("ordinal") + 1).alias("ordinal"), F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    pairs = spans.join(prev, [key, "ordinal"], "left")
    tests: list[tuple[str, Column]] = [
        ("span.inverted", F.col("start") > F.col("end")),
        ("span.before-first-row", F.col("start") < 1),
        ("span.unsorted", F.col("start") < F.col("_ps")),
        ("span.overlap", F.col("start") <= F.col("_pe")),
        ("span.adjacent", F.col("start") == F.col("_pe") + 1),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda x: x.isNotNull())
    per_span = pairs.select(key, F.explode(found).alias("rule"), "start")
    lengths = spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("_n"))
    counts = (
        declared.join(lengths, key, "left")
        .filter(~F.coalesce(F.col("_n"), F.lit(0)).eqNullSafe(F.col("row_count")))
        .select(key, F.lit("span.row-count").alias("rule"), F.lit(None).cast("long").alias("start"))
    )
    return per_span.unionByName(counts)


def first_tokens(spans: DataFrame, key: str, k: int) -> DataFrame:
    """First ``k`` distinct span tokens per key and how many more there are.

    Spark keeps only ``k`` rows per key on each map task before the shuffle.
    """
    distinct = spans.select(key, "start", "end").distinct()
    rank = F.row_number().over(W.partitionBy(key).orderBy("start", "end"))
    head = distinct.withColumn("_rn", rank).filter(F.col("_rn") <= k)
    item = F.struct("_rn", span_token(F.col("start"), F.col("end")).alias("t"))
    joined = head.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), " · ").alias("tokens")
    )
    totals = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(joined, totals, [key]).select(
        key, "tokens", F.greatest(F.col("n") - k, F.lit(0)).alias("more")
    )
