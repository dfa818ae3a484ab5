"""Bundles made from orders, with one fault planted for each rule, and what the checks tell of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import bundle as U
from tabulith.policy import POLICY
from tabulith.queries.registry import query
from tabulith.sources.tables import scan

BUNDLES = 40
#: rule, prefix of the object that breaks it, and which orders carry the fault: key % modulus = remainder, every n-th order only
PLANTED = (
    ("metric.provenance.missing", "m", 83, 1, 1), ("metric.proofStatus", "m", 89, 2, 1), ("expression.selectionId.missing", "p", 97, 3, 1),
    ("expression.metricId.missing", "p", 101, 4, 1), ("expression.issueIds.missing", "p", 103, 5, 1), ("transformId.missing", "p", 107, 6, 1),
    ("transformId.resolved", "p", 109, 7, 1), ("selection.sourceRef", "s", 113, 8, 1), ("selection.fieldId", "s", 127, 9, 1),
    ("row.sourceRefId", "S0:R", 131, 10, 1), ("issue.sourceRefId", "q", 137, 11, 1), ("issue.fieldId", "q", 139, 12, 1), ("issue.canonicalRow", "q", 149, 13, 1),
    ("finding.metricId", "f", 7, 1, 10), ("finding.provenanceId", "f", 7, 2, 10), ("finding.qualityIssueId", "f", 7, 3, 10), ("finding.chartId", "f", 7, 4, 10),
    ("finding.rank", "f", 7, 5, 10), ("chart.metricId", "c", 11, 1, 10), ("chart.provenanceId", "c", 11, 2, 10), ("chart.point.series", "c", 11, 3, 10),
    ("chart.domain", "c", 11, 4, 10), ("status.defined.value", "m", 151, 14, 1), ("status.defined.reason", "m", 157, 15, 1), ("status.undefined.value", "m", 163, 16, 1),
    ("status.undefined.reason", "m", 167, 17, 1), ("metric.rows", "m", 173, 18, 1), ("policy.version", "p", 179, 19, 1), ("normalizationRevision.mismatch", "p", 181, 20, 1),
    ("row.sourceRow.range", "S0:R", 191, 21, 1), ("row.values.columns", "S0:R", 193, 22, 1), ("id.unique", "q", 197, 23, 1), ("chart.series.unique", "c", 11, 5, 10),
)
_BY_RULE = {rule: (prefix, modulus, rest, every) for rule, prefix, modulus, rest, every in PLANTED}
#: Faults of a whole bundle: the rule, the object, the bundles (number % modulus = remainder).
WHOLE = (
    ("column.sourceColumn", "amount", 5, 0), ("grain.column", "T", 5, 1), ("sourceHash.mismatch", "R1", 5, 2), ("sheet.name.length", "sheet-1", 7, 0),
    ("sheet.name.chars", "sheet-2", 7, 1), ("sheet.name.formula", "sheet-3", 7, 2), ("sheet.name.control", "sheet-4", 7, 3), ("sheets.count", None, 7, 4),
    ("slides.count", None, 7, 5), ("slides.scenario", None, 7, 5), ("export.analysisId", "export", 9, 0), ("export.table", "export", 9, 1),
    ("slide.metricId", "slide-1", 9, 2), ("slide.findingId", "slide-1", 9, 3), ("slide.chartId", "slide-1", 9, 4),
)
#: Faults of a scenario over a bundle, likewise.
SCENARIO = (
    ("scenario.status", 11, 0), ("scenario.costChange", 11, 1), ("scenario.bounds", 11, 2), ("scenario.step", 11, 3), ("scenario.definitionId", 11, 4), ("scenario.baseline", 11, 5),
    ("scenario.scope", 11, 6), ("scenario.requiresMetric", 11, 7), ("scenario.unitCompatible", 11, 8), ("scenario.disabled", 11, 9),
)


def _parts(spark: SparkSession, folder: str) -> U.Bundles:
    k = F.col("k")
    orders = scan(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("k"), (F.col("o_custkey") % BUNDLES).alias("b"))
    none = F.lit(None).cast("string")
    text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x)
    props = lambda **p: F.create_map(*[x for n, v in p.items() for x in (F.lit(n), text(v))]) if p else F.create_map().cast("map<string,string>")

    def bad(rule: str) -> Column:
        _, modulus, rest, every = _BY_RULE[rule]
        return (k % modulus == rest) & (k % every == 0)

    def named(prefix: str) -> Column:
        return F.concat(F.lit(prefix), k.cast("string"))

    def obj(kind, id_, status=none, value=none, reason=none, p=None, when=None):
        row = F.struct(F.lit(kind).alias("kind"), id_.alias("id"), text(status).alias("status"), text(value).alias("value"), text(reason).alias("reason"), (p if p is not None else props()).alias("props"))
        return row if when is None else F.when(when, row)

    def edge(role, id_, target, when=None):
        row = F.struct(F.lit(role).alias("role"), id_.alias("id"), target.alias("target"))
        return row if when is None else F.when(when, row)

    def flat(df, key, items):
        return df.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")

    tenth = k % 10 == 0
    undefined = bad("status.undefined.value") | bad("status.undefined.reason")
    status = F.when(undefined, "undefined").otherwise("defined")
    value = F.when(bad("status.defined.value"), F.lit("1e5")).when(undefined & ~bad("status.undefined.value"), none).otherwise(k.cast("string"))
    reason = F.when(bad("status.defined.reason"), "metric.notComputable").when(undefined & ~bad("status.undefined.reason"), "metric.notComputable")
    fixed = {"m": named("m"), "p": named("p"), "s": named("s"), "q": named("q"), "f": named("f"), "c": named("c"), "row": named("S0:R")}
    p_status = F.when(bad("metric.proofStatus"), F.when(undefined, "defined").otherwise("undefined")).otherwise(status)
    p_value, p_reason = F.when(p_status == "defined", F.lit("1")), F.when(p_status == "undefined", F.lit("metric.notComputable"))
    issue = obj("issue", fixed["q"], F.when(bad("transformId.resolved"), "unresolved").otherwise("resolved"))
    objects = [
        obj("metric", fixed["m"], status, value, reason, props(eligible=F.when(bad("metric.rows"), "9").otherwise("5"), total="5", currency="USD")),
        obj("proof", fixed["p"], p_status, p_value, p_reason, props(version=F.when(bad("policy.version"), "0.9.0").otherwise(POLICY.version), revision=F.when(bad("normalizationRevision.mismatch"), "r0").otherwise("r1"))),
        obj("selection", fixed["s"]), issue, F.when(bad("id.unique"), issue),
        obj("row", fixed["row"], p=props(source_row=F.when(bad("row.sourceRow.range"), F.lit(10**12)).otherwise(k).cast("string"), columns=F.when(bad("row.values.columns"), "amount").otherwise("amount,region"))),
        obj("finding", fixed["f"], p=props(coverage="1", magnitude=F.when(bad("finding.rank"), "NaN").otherwise("0.25")), when=tenth),
        obj("chart", fixed["c"], p=props(min=F.when(bad("chart.domain"), "12").otherwise("0"), max="10"), when=tenth),
        obj("series", named("c"), when=tenth), obj("series", named("c"), when=tenth & bad("chart.series.unique")),
    ]
    gone = F.lit("gone")
    to = lambda rule, target: F.when(bad(rule), gone).otherwise(target)
    edges = [
        edge("metric.provenance", fixed["m"], to("metric.provenance.missing", fixed["p"])), edge("expression.selection", fixed["p"], to("expression.selectionId.missing", fixed["s"])),
        edge("expression.metric", fixed["p"], to("expression.metricId.missing", fixed["m"])), edge("expression.issue", fixed["p"], to("expression.issueIds.missing", fixed["q"])),
        edge("proof.transform", fixed["p"], to("transformId.missing", fixed["q"])), edge("selection.source", fixed["s"], to("selection.sourceRef", F.lit("R1"))),
        edge("selection.field", fixed["s"], to("selection.fieldId", F.lit("amount"))), edge("row.source", fixed["row"], to("row.sourceRefId", F.lit("R1"))),
        edge("issue.source", fixed["q"], to("issue.sourceRefId", F.lit("R1"))), edge("issue.field", fixed["q"], to("issue.fieldId", F.lit("region"))),
        edge("issue.row", fixed["q"], to("issue.canonicalRow", fixed["row"])), edge("finding.metric", fixed["f"], to("finding.metricId", fixed["m"]), tenth),
        edge("finding.proof", fixed["f"], to("finding.provenanceId", fixed["p"]), tenth), edge("finding.issue", fixed["f"], to("finding.qualityIssueId", fixed["q"]), tenth),
        edge("finding.chart", fixed["f"], to("finding.chartId", fixed["c"]), tenth), edge("chart.metric", fixed["c"], to("chart.metricId", fixed["m"]), tenth),
        edge("chart.proof", fixed["c"], to("chart.provenanceId", fixed["p"]), tenth), edge("chart.point", fixed["c"], to("chart.point.series", named("c")), tenth),
    ]
    name = lambda col, suffix="": F.concat(F.lit("b"), F.col(col).cast("string"), F.lit(suffix)).alias("bundle")
    per_order = flat(orders.withColumn("bundle", name("b")), "bundle", objects)
    per_edge = flat(orders.withColumn("bundle", name("b")), "bundle", edges)

    # --- what a bundle has once
    n = F.col("b")
    one = {rule: n % modulus == rest for rule, _, modulus, rest in WHOLE}
    own = orders.groupBy("b").agg(F.min("k").alias("k")).withColumn("bundle", name("b"))
    sheet = {1: F.when(one["sheet.name.length"], "x" * 32), 2: F.when(one["sheet.name.chars"], "a/b"), 3: F.when(one["sheet.name.formula"], "=sum"), 4: F.when(one["sheet.name.control"], "a\u0007b")}
    once = [
        obj("source", F.lit("R1"), p=props(source_hash=F.when(one["sourceHash.mismatch"], "other").otherwise("hash"))),
        obj("column", F.lit("amount"), p=props(source_column=F.when(one["column.sourceColumn"], "99").otherwise("1"))), obj("column", F.lit("region"), p=props(source_column="2")),
        obj("export", F.lit("export"), p=props(analysis_id=F.when(one["export.analysisId"], "old").otherwise("analysis"), table_hash=F.when(one["export.table"], "old").otherwise("table"), source_hash="hash")),
        *[obj("sheet", F.lit(f"sheet-{i}"), p=props(name=F.coalesce(sheet[i], F.lit(f"Sheet {i}")) if i in sheet else F.lit("Sheet 5")), when=None if i < 5 else ~one["sheets.count"]) for i in range(1, 6)],
        *[obj("slide", F.lit(f"slide-{i}"), p=props(kind="figures")) for i in range(1, 6)], obj("slide", F.lit("slide-6"), p=props(kind="scenario"), when=one["slides.count"]),
    ]
    spare = lambda rule, target: F.when(one[rule], gone).otherwise(target)
    once_edges = [
        edge("slide.metric", F.lit("slide-1"), spare("slide.metricId", fixed["m"])), edge("slide.finding", F.lit("slide-1"), gone, one["slide.findingId"]), edge("slide.chart", F.lit("slide-1"), gone, one["slide.chartId"]),
        edge("grain.column", F.lit("T"), spare("grain.column", F.lit("region"))),
    ]
    head = props(
        revision="r1", source_hash="hash", sheet_id="S0", first_row="0", last_row=str(10**11), header_row="-1", columns="amount,region", first_column="1", last_column="9", analysis_id="analysis", table_hash="table",
        definition_id="operating-cost-v1", baseline_id="analysis", scope="1998-06",
    )

    # --- a scenario over every bundle, which refers to its parent's figures
    sc = {rule: n % modulus == rest for rule, modulus, rest in SCENARIO}
    over = own.withColumn("bundle", name("b", "-scenario"))
    change = F.when(sc["scenario.costChange"], "8%").when(sc["scenario.bounds"], "0.4").when(sc["scenario.step"], "0.0805").otherwise("0.08")
    cost = F.when(sc["scenario.unitCompatible"], "euro").otherwise("cost")
    scenario = [
        obj("scenario", F.lit("scenario"), "defined", none, F.when(sc["scenario.status"], "scenario.zeroRevenue"),
            props(cost_change=change, definition_id=F.when(sc["scenario.definitionId"], "other").otherwise("operating-cost-v1"), baseline_id=F.when(sc["scenario.baseline"], "old").otherwise("analysis"),
                  scope=F.when(sc["scenario.scope"], "1998-05").otherwise("1998-06"), revenue_id=F.when(sc["scenario.disabled"], "zero").otherwise("revenue"), cost_id=cost)),
        obj("metric", F.lit("scenario-cost"), "defined", "1", none, props(currency="USD")), obj("proof", F.lit("scenario-proof"), "defined", "1", none, props(version=POLICY.version, revision="r1")),
    ]
    scenario_edges = [
        edge("metric.provenance", F.lit("scenario-cost"), F.lit("scenario-proof")), edge("expression.metric", F.lit("scenario-proof"), F.lit("cost")),
        edge("scenario.requires", F.lit("scenario"), F.when(sc["scenario.requiresMetric"], gone).otherwise("revenue")),
    ]
    known = [obj("metric", F.lit(i), "defined", v, none, props(currency=c)) for i, v, c in (("revenue", "100", "USD"), ("cost", "75", "USD"), ("zero", "0", "USD"), ("euro", "75", "EUR"))]
    known_edges = [edge("metric.provenance", F.lit(i), F.lit("base")) for i in ("revenue", "cost", "zero", "euro")]
    known.append(obj("proof", F.lit("base"), "defined", "1", none, props(version=POLICY.version, revision="r1")))
    return U.Bundles(
        per_order.unionByName(flat(own, "bundle", once + known)).unionByName(flat(over, "bundle", scenario)),
        per_edge.unionByName(flat(own, "bundle", once_edges + known_edges)).unionByName(flat(over, "bundle", scenario_edges)),
        own.select("bundle", none.alias("parent"), head.alias("props")).unionByName(over.select("bundle", name("b").alias("parent"), head.alias("props"))),
    )


_O = f"o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_custkey % {BUNDLES} AS b FROM orders), n AS (SELECT DISTINCT b FROM o)"
#: A figure whose proof is gone cannot differ from its status, and one whose issue is gone cannot find it unresolved.
_HIDDEN = {"metric.proofStatus": "metric.provenance.missing", "transformId.resolved": "transformId.missing"}


def _planted(rule: str) -> str:
    _, modulus, rest, every = _BY_RULE[rule]
    return f"(k % {modulus} = {rest} AND k % {every} = 0)"


def _orders_sql(rule: str) -> str:
    prefix = _BY_RULE[rule][0]
    test = _planted(rule)
    undefined = f"({_planted('status.undefined.value')} OR {_planted('status.undefined.reason')})"
    if rule in ("status.defined.value", "status.defined.reason"):
        test += f" AND NOT {undefined}"
    if rule == "status.undefined.value":  # the faulty value of a defined figure stays where the figure is undefined for another reason
        test = f"{test} OR ({_planted('status.undefined.reason')} AND {_planted('status.defined.value')})"
    if rule == "status.undefined.reason":
        test += f" AND NOT {_planted('status.defined.reason')}"
    if rule in ("metric.proofStatus", "transformId.resolved"):
        test += f" AND NOT {_planted(_HIDDEN[rule])}"
    return f"SELECT 'b' || b AS bundle, '{rule}' AS rule, '{prefix}' || k AS object_id FROM o WHERE {test}"


@query(
    "bundle_checks",
    "V4 V8 V11 V12 V13 C2 K9",
    f"WITH {_O} "
    + " UNION ALL ".join(
        [_orders_sql(rule) for rule, *_ in PLANTED]
        + [f"SELECT 'b' || b, 'row.id.binding', 'S0:R' || k FROM o WHERE {_planted('row.sourceRow.range')}"]
        + [f"SELECT 'b' || b, '{rule}', {repr(id_) if id_ else chr(39) + 'b' + chr(39) + ' || b'} FROM n WHERE b % {m} = {r}" for rule, id_, m, r in WHOLE]
        + [f"SELECT 'b' || b || '-scenario', '{rule}', 'scenario' FROM n WHERE b % {m} = {r}" for rule, m, r in SCENARIO]
    ),
)
def bundle_checks(spark: SparkSession, folder: str) -> DataFrame:
    return U.violations(_parts(spark, folder))
