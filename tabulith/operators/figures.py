"""Any number of scoped figures from one scan, and the rows behind each of them.

A row's part in every figure follows from three things: the interval of days it falls
in (the starts and ends of all scopes cut the calendar into intervals), its region
(one class for all regions that no scope names) and which of the checked fields hold
a decimal (words of bits). Rows of the same three are a cell. One map-side
aggregation adds up every field per day, region and bits; figures are then read off
the cells that their scope covers. Spans are made once per cell, where every row has
exactly one place, and a figure's selection is the union of its cells' spans.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import LIMB, LIMBS_PER_SIDE, combine_limbs, format_scale, fraction_scale, is_decimal, with_exact_parts
from tabulith.functions.text import row_id
from tabulith.operators.expressions import selection_leaves
from tabulith.operators.scope import Scope
from tabulith.operators.spans import combine, join_spans, span_summary, to_spans
from tabulith.session import cut_lineage

WORD = 60
ANY, OTHER = "*", ""


@dataclass(frozen=True)
class SumSpec:
    """One wanted figure: a field summed over a scope under a shared mask."""

    id: str
    field: str
    scope: Scope
    mask: tuple[str, ...] = ()

    @property
    def needs(self) -> set[str]:
        return {self.field, *self.mask}


class Cells:
    """How the scopes of some figures cut the rows of a table."""

    def __init__(self, specs: Sequence[SumSpec], date: Column | None, region: Column | None):
        self.specs = list(specs)
        self.dated = [date is not None and s.scope.start is not None and s.scope.end is not None for s in self.specs]
        days = [tuple(map(datetime.date.fromisoformat, (s.scope.start, s.scope.end))) if d else None for s, d in zip(self.specs, self.dated, strict=True)]
        one = datetime.timedelta(days=1)
        self.cuts = sorted({edge for d in days if d and d[0] <= d[1] for edge in (d[0], d[1] + one)})
        place = {c: i + 1 for i, c in enumerate(self.cuts)}
        #: first and last interval of each scope; -1 holds rows without a date
        self.runs = [(-1, len(self.cuts)) if d is None else (place[d[0]], place[d[1] + one] - 1) if d[0] <= d[1] else (1, 0) for d in days]
        self.fields = sorted({s.field for s in self.specs})
        self.checked = sorted(set().union(*[s.needs for s in self.specs]))
        self.named = sorted({r for s in self.specs for r in s.scope.regions})
        self.date, self.region = date, region

    def rows(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Rows that some scope may hold, with their day, region class and bits."""
        day = F.lit(None).cast("date") if self.date is None else self.date
        place = F.lit(OTHER)
        if self.region is not None and self.named:
            place = F.when(self.region.isin(*self.named), F.concat(F.lit("="), self.region)).otherwise(OTHER)
        staged = rows.select(*keep, *[F.col(f"`{f}`").alias(f) for f in self.checked if f not in keep], day.alias("_day"), place.alias("_place"), *[is_decimal(F.col(f"`{f}`")).alias(f"_ok_{f}") for f in self.checked])
        if all(self.dated):
            staged = staged.filter(F.col("_day").between(F.lit(self.cuts[0]), F.lit(self.cuts[-1])) if self.cuts else F.lit(False))
        bit = lambda i, f: F.when(F.col(f"_ok_{f}"), F.lit(1 << i % WORD)).otherwise(0).cast("long")
        words = [self.checked[i : i + WORD] for i in range(0, len(self.checked), WORD)]
        packed = F.array(*[reduce(Column.bitwiseOR, [bit(i, f) for i, f in enumerate(w)]) for w in words])
        return staged.withColumn("_bits", packed)

    def interval(self) -> Column:
        """Number of the interval a day falls in."""
        cuts = F.array(*[F.lit(c) for c in self.cuts]) if self.cuts else F.array().cast("array<date>")
        return F.when(F.col("_day").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("_day"))))

    def table(self, spark) -> DataFrame:
        """(i, interval, _place, field, needs): the cells that each figure covers, by interval and region class."""
        at = {f: i for i, f in enumerate(self.checked)}
        n_words = -(-len(self.checked) // WORD)
        rows = []
        for i, (s, (first, last)) in enumerate(zip(self.specs, self.runs, strict=True)):
            words = [0] * n_words
            for f in s.needs:
                words[at[f] // WORD] |= 1 << at[f] % WORD
            places = [f"={r}" for r in sorted(set(s.scope.regions))] if s.scope.regions else [ANY]
            if s.scope.regions and self.region is None:
                places = []
            rows.append((i, first, last, places, self.fields.index(s.field), words))
        wanted = spark.createDataFrame(rows, "i int, first int, last int, places array<string>, field int, needs array<bigint>").filter("first <= last")
        return wanted.select("i", F.explode(F.sequence("first", "last")).alias("interval"), "places", "field", "needs").select(
            "i", "interval", F.explode("places").alias("_place"), "field", "needs"
        )


def _eligible() -> Column:
    return F.forall(F.zip_with("_bits", "needs", lambda have, need: have.bitwiseAND(need) == need), lambda ok: ok)


def scoped_sums(rows: DataFrame, specs: Sequence[SumSpec], date: Column | None, region: Column | None) -> DataFrame:
    """(metric_id, value, eligible_rows, total_rows, scale) for every spec, from one scan.

    Neither the scan nor the aggregation grows with the number of figures. Values are
    exact decimal texts padded to the widest input scale; missing or non-decimal cells
    are not eligible, never zero. Ordinary values need two sums a field; wider ones are
    grouped by their digits and added up limb by limb behind the aggregation.
    """
    spark = rows.sparkSession
    schema = "i int, metric_id string"
    if not specs:
        return spark.createDataFrame([], "metric_id string, value string, eligible_rows long, total_rows long, scale int")
    cells = Cells(specs, date, region)
    wanted = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f).alias("text"), F.col(f"_ok_{f}").alias("ok")) for k, f in enumerate(cells.fields)])
    staged = cells.rows(rows).select("_day", "_place", "_bits", F.explode(wanted).alias("x")).select("_day", "_place", "_bits", "x.*")
    staged = with_exact_parts(staged, F.col("text"), F.col("ok"), "_x")
    wide = F.when(F.col("_x_w").isNotNull(), F.concat(F.when(F.col("_x_s") < 0, "-").otherwise("+"), F.col("_x_w")))
    groups = staged.groupBy("_day", "_place", "_bits", "field", wide.alias("_w")).agg(
        F.count("*").alias("_n"), *[F.sum(F.col(f"_x_{p}").cast("decimal(28,0)")).alias(f"_{p}") for p in ("i", "f")],
        F.max(F.when(F.col("ok"), fraction_scale(F.col("text")))).alias("_s"),
    )

    # From here on rows are as few as days, regions and patterns of missing cells.
    def limb(p: int) -> str:
        near = {LIMBS_PER_SIDE - 1: "_i", LIMBS_PER_SIDE: "_f"}.get(p, "cast(0 as decimal(28,0))")
        far = f"cast(concat(substring(_w, 1, 1), substring(_w, {p * LIMB + 2}, {LIMB})) as decimal(19,0)) * _n"
        return f"cast(if(_w is null, coalesce({near}, 0), {far}) as decimal(38,0))"

    limbs = range(2 * LIMBS_PER_SIDE)
    known = groups.select(cells.interval().alias("interval"), F.explode(F.array(F.lit(ANY), "_place")).alias("_place"), "_bits", "field", "_n", "_s", F.expr(f"array({', '.join(map(limb, limbs))})").alias("_limbs"))
    met = cells.table(spark).join(known, ["interval", "_place", "field"]).withColumn("e", _eligible())
    counted = met.groupBy("i").agg(
        *[F.expr(f"sum(if(e, _limbs[{p}], null)) as v{p}") for p in limbs],
        F.expr("sum(if(e, _n, 0)) as eligible_rows"), F.sum("_n").alias("total_rows"), F.expr("max(if(e, _s, 0)) as scale"),
    )
    # A spec no row fell in still has a figure: zero over zero rows.
    declared = spark.createDataFrame(list(enumerate(s.id for s in specs)), schema)
    full = declared.join(counted, "i", "left").withColumn("_x", F.coalesce(combine_limbs("v"), F.lit("0")))
    scale = F.coalesce("scale", F.lit(0))
    return full.select(
        "metric_id", format_scale(F.col("_x"), scale).alias("value"), F.coalesce("eligible_rows", F.lit(0)).alias("eligible_rows"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"), scale.alias("scale"),
    )


# --- the rows behind a figure ------------------------------------------------


def selection_spans(rows: DataFrame, specs: Sequence[SumSpec], date: Column | None, region: Column | None, row: str = "source_row") -> DataFrame:
    """(selection_id, field, start, end): the eligible rows of every figure as canonical spans.

    Rows are compressed once, per cell; a figure then unites its cells' spans.
    """
    cells = Cells(specs, date, region)
    placed = cells.rows(rows, row).select(row, cells.interval().alias("interval"), "_place", "_bits")
    per_cell = cut_lineage(to_spans(placed, row, ["interval", "_place", "_bits"], distinct=False))
    known = per_cell.select("interval", F.explode(F.array(F.lit(ANY), "_place")).alias("_place"), "_bits", "start", "end")
    mine = cells.table(rows.sparkSession).join(known, ["interval", "_place"]).filter(_eligible())
    names = rows.sparkSession.createDataFrame([(i, f"{s.id}-rows", s.field) for i, s in enumerate(cells.specs)], "i int, selection_id string, field string")
    return combine(mine.select("i", "start", "end"), None, ["i"], "union").join(names, "i").select("selection_id", "field", "start", "end")


@dataclass(frozen=True)
class Evidence:
    """Everything a reader needs to take a table's figures apart again; each part is a DataFrame."""

    figures: DataFrame  #: metric_id, value, eligible_rows, total_rows, scale, warnings, provenance_id, status
    proofs: DataFrame  #: proof_id, expression, selection_id
    spans: DataFrame  #: selection_id, field, start, end
    excluded: DataFrame  #: selection_id, row_id: resolved duplicates whose kept row contributes


def evidence_of(
    rows: DataFrame, specs: Sequence[SumSpec], date: Column | None, region: Column | None, ledger: DataFrame, sheet_id: str = "S0", row: str = "source_row"
) -> Evidence:
    """Figures with their proofs, selections, excluded rows and warnings.

    Excluded rows are copies that normalization left out and whose kept row counts in
    the figure; a figure over a field with repaired formula caches carries a warning.
    """
    spark = rows.sparkSession
    sums = scoped_sums(rows, specs, date, region)
    spans = cut_lineage(selection_spans(rows, specs, date, region, row))
    copies = ledger.filter("kind = 'duplicate' and status = 'resolved'").select(F.col("canonical_row").alias("kept"), F.col("source_row").alias("copy"))
    # A kept row meets the spans once, however many copies it has.
    counted = join_spans(copies.select("kept").distinct(), spans, "kept").select("selection_id", "kept")
    excluded = cut_lineage(copies.join(counted, "kept").select("selection_id", row_id(F.lit(sheet_id), F.col("copy")).alias("row_id")))
    cached = ledger.filter("kind = 'formula-cache' and status = 'resolved'").select("field").distinct().withColumn("cached", F.lit(True))
    json = [(s.id, s.field, f'{{"op":"sum","selection_id":"{s.id}-rows","field":"{s.field}"}}') for s in specs]
    named = spark.createDataFrame(json, "metric_id string, field string, expression string")
    warned = F.when(F.col("cached"), F.array(F.lit("limitations.cache"))).otherwise(F.array().cast("array<string>"))
    figures = sums.join(named.select("metric_id", "field"), "metric_id").join(F.broadcast(cached), "field", "left").select(
        "metric_id", "value", "eligible_rows", "total_rows", "scale", warned.alias("warnings"), F.concat("metric_id", F.lit("-proof")).alias("provenance_id"), F.lit("defined").alias("status")
    )
    proofs = named.select(F.concat("metric_id", F.lit("-proof")).alias("proof_id"), "expression", F.concat("metric_id", F.lit("-rows")).alias("selection_id"))
    return Evidence(figures, proofs, spans, excluded)


def selection_heads(evidence: Evidence) -> DataFrame:
    """(selection_id, spans, row_count, excluded_rows): one row a figure, empty selections too."""
    counts = span_summary(evidence.spans, ["selection_id"])
    left_out = evidence.excluded.groupBy("selection_id").agg(F.countDistinct("row_id").alias("excluded_rows"))
    heads = evidence.proofs.select("selection_id").join(counts, "selection_id", "left").join(left_out, "selection_id", "left")
    return heads.select("selection_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("spans", "row_count", "excluded_rows")])


def selection_values(rows: DataFrame, evidence: Evidence) -> DataFrame:
    """The leaves of the proofs: each selection's field added up again from the rows its spans name."""
    pairs = evidence.proofs.select("selection_id", F.get_json_object("expression", "$.field").alias("field"))
    fields = sorted(r.field for r in pairs.select("field").distinct().collect())
    leaves = selection_leaves(rows, evidence.spans, fields).join(pairs, ["selection_id", "field"], "left_semi")
    empty = pairs.join(evidence.spans, "selection_id", "left_anti").select(
        "selection_id", "field", F.lit(0).cast("long").alias("declared"), F.lit("0").alias("value"), F.lit(None).cast("string").alias("reason")
    )
    return leaves.unionByName(empty)


# --- checks of a selection ---------------------------------------------------


def selection_violations(selections: DataFrame, spans: DataFrame, rows: DataFrame, sources: DataFrame, fields: DataFrame, excluded: DataFrame, sheet_id: str = "S0") -> DataFrame:
    """(selection_id, rule, detail) of selections that do not describe their table.

    ``selections``: selection_id, source_ref, field, row_count; ``sources``: source_ref;
    ``fields``: field; ``excluded``: selection_id, row_id. A spanned row that the table
    does not hold, an unknown source or field, a row count that the spans do not give,
    and an excluded row that contributes are violations. Rows are held against spans
    as sets of intervals, never one by one; an excluded row id of another sheet is told too.
    """
    text = lambda c: c.cast("string").alias("detail")
    refs = selections.join(sources, "source_ref", "left_anti").select("selection_id", F.lit("selection.sourceRef").alias("rule"), text(F.col("source_ref")))
    unknown = selections.join(fields, "field", "left_anti").select("selection_id", F.lit("selection.fieldId").alias("rule"), text(F.col("field")))
    counted = span_summary(spans, ["selection_id"]).select("selection_id", F.col("row_count").alias("found"))
    counts = selections.join(counted, "selection_id", "left").filter(~F.coalesce("found", F.lit(0)).eqNullSafe(F.col("row_count")))
    counts = counts.select("selection_id", F.lit("selection.rowCount").alias("rule"), text(F.coalesce("found", F.lit(0))))
    present = cut_lineage(to_spans(rows, "source_row", distinct=False))
    absent = combine(spans, present, ["selection_id"], "difference", shared=True)
    gone = absent.groupBy("selection_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"), F.min("start").alias("first"))
    gone = gone.select("selection_id", F.lit("selection.row.missing").alias("rule"), F.concat_ws(" from ", "n", "first").alias("detail"))
    out = excluded.withColumn("start", F.regexp_extract("row_id", f"^{sheet_id}:R([0-9]+)\\z", 1).try_cast("long")).withColumn("end", F.col("start"))
    both = combine(spans, to_spans(out.filter("start is not null"), "start", ["selection_id"]), ["selection_id"], "intersect")
    inside = both.groupBy("selection_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    inside = inside.select("selection_id", F.lit("selection.exclusion.contributing").alias("rule"), text(F.col("n")))
    foreign = out.filter("start is null").select("selection_id", F.lit("selection.exclusion.id").alias("rule"), text(F.col("row_id")))
    return refs.unionByName(unknown).unionByName(counts).unionByName(gone).unionByName(inside).unionByName(foreign)


def require_selections(wanted: DataFrame, proofs: DataFrame) -> DataFrame:
    """(selection_id, proof_id, error): the first proof that declares each wanted selection; an unknown one is an error row."""
    declared = proofs.filter("selection_id is not null").groupBy("selection_id").agg(F.min("proof_id").alias("proof_id"))
    found = wanted.select("selection_id").distinct().join(declared, "selection_id", "left")
    return found.withColumn("error", F.when(F.col("proof_id").isNull(), F.lit("unknown-selection")))
