"""The rules of a bundle of documents, checked as a typed graph of references.

A bundle is an analysis with everything that belongs to it. It comes as three tables:
its objects (figures, proofs, selections, issues, findings, charts, series, slides,
sheets, rows, columns, sources) with the few properties that rules read, the
references between them as edges with a role, and one head row with the identities
the bundle was made from. Any number of bundles is checked at once: dangling
references and targets in the wrong state are one join of all edges with all
objects, repeated ids one aggregation, rules on a single object one narrow pass.
A scenario's bundle names a ``parent``; what it does not hold itself is looked up
there, by the second of two joins that only unresolved references reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import compare_decimal, is_decimal
from tabulith.operators.scenario import change_problem
from tabulith.policy import POLICY
from tabulith.session import cut_lineage

#: Role of a reference, the kind it must name, the rule it breaks when nothing is there.
ROLES = (
    ("metric.provenance", "proof", "metric.provenance.missing"),
    ("expression.selection", "selection", "expression.selectionId.missing"),
    ("expression.metric", "metric", "expression.metricId.missing"),
    ("expression.issue", "issue", "expression.issueIds.missing"),
    ("proof.transform", "issue", "transformId.missing"),
    ("selection.source", "source", "selection.sourceRef"),
    ("selection.field", "column", "selection.fieldId"),
    ("row.source", "source", "row.sourceRefId"),
    ("issue.source", "source", "issue.sourceRefId"),
    ("issue.field", "column", "issue.fieldId"),
    ("issue.row", "row", "issue.canonicalRow"),
    ("grain.column", "column", "grain.column"),
    ("finding.metric", "metric", "finding.metricId"),
    ("finding.proof", "proof", "finding.provenanceId"),
    ("finding.issue", "issue", "finding.qualityIssueId"),
    ("finding.chart", "chart", "finding.chartId"),
    ("chart.metric", "metric", "chart.metricId"),
    ("chart.proof", "proof", "chart.provenanceId"),
    ("chart.point", "series", "chart.point.series"),
    ("slide.metric", "metric", "slide.metricId"),
    ("slide.finding", "finding", "slide.findingId"),
    ("slide.chart", "chart", "slide.chartId"),
    ("scenario.requires", "metric", "scenario.requiresMetric"),
)
#: The status a target must have ("=" is that of the object that refers to it), and the rule otherwise.
STATES = (
    ("metric.provenance", "=", "metric.proofStatus"),
    ("proof.transform", "resolved", "transformId.resolved"),
    ("scenario.requires", "defined", "scenario.requiresMetric"),
)
#: Kinds whose ids a scenario shares with its parent, so they must not collide.
SHARED = ("metric", "proof", "selection")


@dataclass(frozen=True)
class Bundles:
    """``objects``: bundle, kind, id, status, value, reason, props (text by name);
    ``edges``: bundle, role, id, target; ``heads``: bundle, parent, props."""

    objects: DataFrame
    edges: DataFrame
    heads: DataFrame


def reference_violations(b: Bundles) -> DataFrame:
    """(bundle, rule, object_id) of references to nothing, or to an object in the wrong state."""
    spark = b.objects.sparkSession
    roles = spark.createDataFrame(ROLES, "role string, to_kind string, missing string").join(
        spark.createDataFrame(STATES, "role string, wanted string, wrong string"), "role", "left"
    )
    nodes = b.objects.select("bundle", F.col("kind").alias("to_kind"), F.col("id").alias("target"), F.coalesce("status", F.lit("")).alias("found")).dropDuplicates(["bundle", "to_kind", "target"])
    own = b.objects.select("bundle", "id", F.col("kind").alias("from_kind"), F.col("status").alias("own")).dropDuplicates(["bundle", "from_kind", "id"])
    # A table of two dozen rows, whatever the bundles.
    typed = b.edges.join(F.broadcast(roles), "role").withColumn("from_kind", F.split("role", r"\.")[0])
    stated = typed.filter("wanted = '='").join(own, ["bundle", "from_kind", "id"], "left").withColumn("wanted", F.col("own")).drop("own")
    typed = typed.filter("wanted is null or wanted <> '='").unionByName(stated)
    met = cut_lineage(typed.join(nodes, ["bundle", "to_kind", "target"], "left"))
    parents = b.heads.filter("parent is not null").select("bundle", "parent")
    above = nodes.select(F.col("bundle").alias("parent"), "to_kind", "target", F.col("found").alias("above"))
    lost = met.filter("found is null").join(parents, "bundle", "left").join(above, ["parent", "to_kind", "target"], "left")
    lost = lost.select(*[c for c in met.columns if c != "found"], F.col("above").alias("found"))
    told = met.filter("found is not null").unionByName(lost)
    rule = F.when(F.col("found").isNull(), F.col("missing")).when(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("found")), F.col("wrong"))
    return told.withColumn("rule", rule).filter("rule is not null").select("bundle", "rule", F.col("id").alias("object_id"))


def id_violations(b: Bundles) -> DataFrame:
    """Repeated ids of one kind, and ids of a scenario that its parent has too."""
    series = F.when(F.col("kind") == "series", "chart.series.unique").otherwise("id.unique").alias("rule")
    held = b.objects.groupBy("bundle", "kind", "id").agg(F.count("*").alias("n"))
    twice = held.filter("n > 1").select("bundle", series, F.col("id").alias("object_id"))
    shared = held.filter(F.col("kind").isin(*SHARED)).drop("n")
    inner = shared.join(b.heads.filter("parent is not null").select("bundle", "parent"), "bundle")
    both = inner.join(shared.withColumnRenamed("bundle", "parent"), ["parent", "kind", "id"], "left_semi")
    return twice.unionByName(both.select("bundle", F.lit("id.unique").alias("rule"), F.col("id").alias("object_id")))


def _prop(name: str) -> Column:
    return F.try_element_at("props", F.lit(name))


def _whole(name: str) -> Column:
    return _prop(name).try_cast("long")


def object_violations(b: Bundles) -> DataFrame:
    """Rules that one object and the head of its bundle decide."""
    heads = b.heads.select("bundle", F.col("props").alias("head"))
    o = b.objects.join(heads, "bundle")
    head = lambda name: F.try_element_at("head", F.lit(name))
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    defined, undefined = F.col("status") == "defined", F.col("status") == "undefined"
    differs = lambda name: _prop(name).isNotNull() & head(name).isNotNull() & (_prop(name) != head(name))
    row = _whole("source_row")
    tests = {
        "status.defined.value": is_("metric", "proof") & defined & ~is_decimal(F.col("value")),
        "status.defined.reason": is_("metric", "proof") & defined & F.col("reason").isNotNull(),
        "status.undefined.value": is_("metric", "proof") & undefined & F.col("value").isNotNull(),
        "status.undefined.reason": is_("metric", "proof") & undefined & (F.coalesce("reason", F.lit("")) == ""),
        "metric.rows": is_("metric") & (_whole("eligible") > _whole("total")),
        "policy.version": is_("proof", "table") & (_prop("version") != POLICY.version),
        "normalizationRevision.mismatch": is_("proof", "snapshot") & differs("revision"),
        "sourceHash.mismatch": is_("source", "export") & differs("source_hash"),
        "finding.rank": is_("finding") & (~is_decimal(_prop("coverage")) | ~is_decimal(_prop("magnitude"))),
        "chart.domain": is_("chart") & is_decimal(_prop("min")) & is_decimal(_prop("max")) & (compare_decimal(_prop("min"), _prop("max")) > 0),
        "column.sourceColumn": is_("column") & ~_whole("source_column").between(head("first_column").try_cast("long"), head("last_column").try_cast("long")),
        "row.id.binding": is_("row") & (F.col("id") != F.concat(head("sheet_id"), F.lit(":R"), _prop("source_row"))),
        "row.sourceRow.range": is_("row") & (~row.between(head("first_row").try_cast("long"), head("last_row").try_cast("long")) | (row == head("header_row").try_cast("long"))),
        "row.values.columns": is_("row") & differs("columns"),
        "sheet.name.length": is_("sheet") & (F.length(_prop("name")) > 31),
        "sheet.name.chars": is_("sheet") & _prop("name").rlike(r"[\[\]:*?/\\]|^\z"),
        "sheet.name.formula": is_("sheet") & _prop("name").rlike(r"^[=+\-@']"),
        "sheet.name.control": is_("sheet") & _prop("name").rlike(r"[\x00-\x1F\x7F]"),
        "export.analysisId": is_("export") & differs("analysis_id"),
        "export.table": is_("export") & differs("table_hash"),
        "scenario.status": is_("scenario") & (defined & F.col("reason").isNotNull() | (F.col("status") == "unavailable") & (F.coalesce("reason", F.lit("")) == "")),
        "scenario.costChange": is_("scenario") & (change_problem(_prop("cost_change")) == "not-a-decimal"),
        "scenario.bounds": is_("scenario") & (change_problem(_prop("cost_change")) == "out-of-range"),
        "scenario.step": is_("scenario") & (change_problem(_prop("cost_change")) == "off-step"),
        "scenario.definitionId": is_("scenario") & differs("definition_id"),
        "scenario.baseline": is_("scenario") & differs("baseline_id"),
        "scenario.scope": is_("scenario") & differs("scope"),
    }
    hits = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return o.select("bundle", F.col("id").alias("object_id"), F.explode(hits).alias("rule")).select("bundle", "rule", "object_id")


def count_violations(b: Bundles, sheets: int = 5, slides: int = 5) -> DataFrame:
    """Exports: how many sheets and slides, and a scenario slide where a scenario is committed, nowhere else."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    per = b.objects.groupBy("bundle").agg(
        kind("export").alias("exports"), kind("sheet").alias("sheets"), kind("slide").alias("slides"),
        F.count_if((F.col("kind") == "slide") & (_prop("kind") == "scenario")).alias("scenario_slides"),
        F.count_if((F.col("kind") == "scenario") & (F.col("status") == "defined")).alias("committed"),
    ).filter("exports > 0")
    one = F.when(F.col("committed") > 0, 1).otherwise(0)
    tests = {"sheets.count": F.col("sheets") != sheets, "slides.count": F.col("slides") != slides + one, "slides.scenario": F.col("scenario_slides") != one}
    hits = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return per.select("bundle", F.explode(hits).alias("rule"), F.col("bundle").alias("object_id"))


def scenario_violations(b: Bundles) -> DataFrame:
    """What a scenario's baseline figures forbid: other currencies, revenue not above zero or a negative cost under a defined scenario."""
    s = b.objects.filter("kind = 'scenario'").join(b.heads.select("bundle", "parent"), "bundle")
    s = s.select("bundle", "parent", "id", "status", _prop("revenue_id").alias("revenue_id"), _prop("cost_id").alias("cost_id"))
    figures = b.objects.filter("kind = 'metric'").select(F.col("bundle").alias("parent"), F.col("id").alias("_id"), F.col("value").alias("_value"), _prop("currency").alias("_currency"))
    side = lambda n: figures.select("parent", F.col("_id").alias(f"{n}_id"), F.col("_value").alias(n), F.col("_currency").alias(f"{n}_currency"))
    both = s.join(side("revenue"), ["parent", "revenue_id"], "left").join(side("cost"), ["parent", "cost_id"], "left")
    zero = F.lit("0")
    disabled = is_decimal(F.col("revenue")) & is_decimal(F.col("cost")) & ((compare_decimal(F.col("revenue"), zero) <= 0) | (compare_decimal(F.col("cost"), zero) < 0))
    tests = {"scenario.unitCompatible": F.col("revenue_currency") != F.col("cost_currency"), "scenario.disabled": disabled & (F.col("status") == "defined")}
    hits = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return both.select("bundle", F.explode(hits).alias("rule"), F.col("id").alias("object_id"))


def violations(b: Bundles) -> DataFrame:
    """(bundle, rule, object_id): everything that keeps a bundle from being published."""
    b = Bundles(cut_lineage(b.objects), cut_lineage(b.edges), cut_lineage(b.heads))
    out = reference_violations(b)
    for part in (id_violations, object_violations, count_violations, scenario_violations):
        out = out.unionByName(part(b))
    return out.distinct()
