"""From a figure back to the rows, cells and ledger entries behind it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.operators.ordinals import running_total, with_ordinal
from tabulith.operators.spans import combine, expand_spans, join_spans, to_spans
from tabulith.policy import POLICY
from tabulith.session import cut_lineage


class PageError(ValueError):
    """The requested page is not one a reader may ask for."""


def selection_rows(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of a table that a selection's spans cover."""
    return join_spans(rows, spans)


def absent_rows(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Spanned source rows the table does not hold: (key, source_row)."""
    return expand_spans(spans).select(key, "source_row").join(rows.select("source_row"), "source_row", "left_anti")


def absent_sample(rows: DataFrame, spans: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Per selection: how many rows are absent and the first ``k`` of them."""
    missing = absent_rows(rows, spans, key)
    counts = missing.groupBy(key).agg(F.count(F.lit(1)).alias("absent"))
    head = (
        with_ordinal(missing, "source_row", [key], "_n")
        .filter(F.col("_n") <= k)
        .groupBy(key)
        .agg(F.array_join(F.sort_array(F.collect_list("source_row")), ", ").alias("examples"))
    )
    return counts.join(head, key)


def selection_index(spans: DataFrame, keys: Sequence[str] = (), present: DataFrame | None = None) -> DataFrame:
    """(keys, start, end, first): a selection's spans with the number of their first row, as a written table.

    The lengths of the spans are added up in their order, so the directory answers
    which span holds the n-th row and how many rows lie before a span. It is sorted by
    ``first``: a reader of a few rows reads one row group of it. With ``present``, the
    spans of the rows a table holds, absent rows are left out.
    """
    keys = list(keys)
    if present is not None:
        spans = combine(spans, present, keys, "intersect", shared=True)
    length = F.col("end") - F.col("start") + 1
    numbered = running_total(cut_lineage(spans.select(*keys, "start", "end")), "start", length, "_upto", keys)
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = numbered.select(*keys, "start", "end", (F.col("_upto") - length + 1).alias("first"))
    return cut_lineage(placed.repartitionByRange(parts, *keys, "first").sortWithinPartitions(*keys, "first"))


#: Row ranges of a page that are pushed into the scan; nearer ones are taken together.
PAGE_RANGES = 16


def page_ranges(index: DataFrame, offset: int, size: int) -> tuple[list[tuple[int, int]], int]:
    """(row ranges, total): the row numbers of one page of an index of one selection, and all its rows.

    Every span that is read holds a row of the page, so there are at most ``size`` of them.
    """
    total = index.agg(F.coalesce(F.max(F.col("first") + F.col("end") - F.col("start")), F.lit(0))).first()[0]
    last = F.col("first") + F.col("end") - F.col("start")
    touched = index.filter((F.col("first") <= offset + size) & (last > offset)).select("start", "end", "first").collect()
    ranges = []
    for start, end, first in sorted(tuple(r) for r in touched):
        low, high = max(start, start + offset + 1 - first), min(end, start + offset + size - first)
        ranges.append((low, high))
    return ranges, total


def _within(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """A predicate on a stored column that prunes row groups and then keeps exactly the wanted rows."""
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)[: PAGE_RANGES - 1]
    cuts = [0, *sorted(gaps), len(ranges)]
    coarse = [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    near = reduce(Column.__or__, [key.between(lo, hi) for lo, hi in coarse], F.lit(False))
    if len(coarse) == len(ranges):
        return near
    return near & key.isin([n for lo, hi in ranges for n in range(lo, hi + 1)])


def evidence_page(rows: DataFrame, index: DataFrame, offset: int, size: int, key: str = "source_row", shift: int = 0) -> DataFrame:
    """One page of the rows behind a selection, with total and next offset.

    ``index`` is the ``selection_index`` of one selection; ``key`` the stored column that
    is the row number less ``shift``. The page's row numbers are read off the index and
    pushed into the scan of ``rows``: nothing is joined or shuffled. Beyond the end the
    page is empty.
    """
    if offset < 0:
        raise PageError(f"offset must not be negative: {offset}")
    if not 1 <= size <= POLICY.max_page:
        raise PageError(f"page size must be 1..{POLICY.max_page}: {size}")
    ranges, total = page_ranges(index, offset, size)
    page = rows.filter(_within(F.col(key), [(lo - shift, hi - shift) for lo, hi in ranges]))
    following = offset + sum(hi - lo + 1 for lo, hi in ranges)
    number = (F.col(key).cast("long") + shift).alias("source_row")
    return page.select(
        number, *[c for c in rows.columns if c not in (key, "source_row")], F.lit(total).cast("long").alias("total"),
        F.lit(following if following < total else None).cast("int").alias("next_offset"),
    )


def issues_by_cell(ledger: DataFrame) -> DataFrame:
    """(source_row, field, issues): ids per touched cell, a handful each."""
    return ledger.filter(F.col("field").isNotNull()).groupBy("source_row", "field").agg(
        F.sort_array(F.collect_list("issue_id")).alias("issues")
    )


def evidence_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows with the ledger entries on them and the values before normalization.

    Entries per source row are bounded by the table's width.
    """
    entry = F.when(
        F.col("field").isNotNull() & F.col("original").isNotNull(),
        F.struct(F.col("field").alias("f"), F.col("original").alias("o")),
    )
    per_row = ledger.groupBy("source_row").agg(
        F.array_sort(F.collect_list("issue_id")).alias("transforms"),
        F.array_sort(F.collect_set(entry)).alias("_pairs"),
    )
    joined = rows.join(per_row, "source_row", "left")
    return joined.withColumn(
        "original_values", F.to_json(F.map_from_entries(F.col("_pairs")))
    ).drop("_pairs")


def issues_in_selection(ledger: DataFrame, spans: DataFrame) -> DataFrame:
    """Ledger entries whose physical row lies in a selection."""
    return join_spans(ledger, spans)


def excluded_contributors(ledger: DataFrame, selected: DataFrame) -> DataFrame:
    """Resolved duplicates whose kept copy is among the selected rows (semi-join)."""
    dup = ledger.filter((F.col("kind") == "duplicate") & (F.col("status") == "resolved"))
    return dup.join(
        selected.select(F.col("source_row").alias("_kept")), F.col("canonical_row") == F.col("_kept"), "left_semi"
    )


def build_selection(rows: DataFrame, eligible, selection_id: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(selection, spans) of the eligible rows: one head row and its span table."""
    chosen = rows.filter(eligible)
    spans = to_spans(chosen, "source_row", distinct=False).withColumn("selection_id", F.lit(selection_id))
    head = chosen.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(selection_id).alias("selection_id"), "row_count", F.lit(field).alias("field"),
        F.lit("shared-valid").alias("mask_policy"),
    )
    return head, spans


# --- caveats ---------------------------------------------------------------


def metric_caveats(metrics: DataFrame) -> DataFrame:
    """(metric_id, message_key, tone): why undefined, then each warning."""
    reason = F.when(
        (F.col("status") == "undefined") & F.col("reason").isNotNull(),
        F.array(F.struct(F.col("reason").alias("message_key"), F.lit("warning").alias("tone"))),
    )
    warned = F.transform("warnings", lambda w: F.struct(w.alias("message_key"), F.lit("info").alias("tone")))
    empty = F.filter(warned, lambda _: F.lit(False))
    all_ = F.concat(F.coalesce(reason, empty), warned)
    return metrics.select("metric_id", F.explode(all_).alias("c")).select("metric_id", "c.message_key", "c.tone")


def selection_caveats(ledger: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, message_key) for open issues inside a selection."""
    open_ = issues_in_selection(ledger.filter(F.col("status").isin("unresolved", "proposed")), spans)
    flags = open_.groupBy(key).agg(
        F.bool_or(F.col("kind").isin("missing", "malformed")).alias("m"),
        F.bool_or(F.col("kind") == "formula-cache").alias("f"),
    )
    keys = F.array(
        F.when(F.col("m"), "limitations.missingRetained"),
        F.when(F.col("f"), "limitations.cache"),
        F.when(~F.col("m") & ~F.col("f"), "quality.unresolved"),
    )
    return flags.select(key, F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("message_key"))


def subject_caveats(findings: DataFrame) -> DataFrame:
    """(finding_id, message_key, tone): partial scope first, then limitations."""
    partial = F.when(
        ~F.col("complete"), F.array(F.struct(F.col("coverage_note").alias("message_key"), F.lit("warning").alias("tone")))
    )
    limits = F.transform("limitations", lambda w: F.struct(w.alias("message_key"), F.lit("info").alias("tone")))
    empty = F.filter(limits, lambda _: F.lit(False))
    return findings.select("finding_id", F.explode(F.concat(F.coalesce(partial, empty), limits)).alias("c")).select(
        "finding_id", "c.message_key", "c.tone"
    )


def resolve_references(findings: DataFrame, metrics: DataFrame, proofs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, dangling): a finding's metric and proof ids joined to their rows."""
    wanted = findings.select("finding_id", F.posexplode("metric_ids").alias("ordinal", "metric_id"))
    found = wanted.join(metrics, "metric_id").join(
        proofs.select("proof_id"), F.col("provenance_id") == F.col("proof_id"), "left"
    )
    dangling = wanted.join(metrics, "metric_id", "left_anti").select("finding_id", "metric_id")
    return found, dangling
