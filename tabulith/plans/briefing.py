"""The briefing: figures, proofs, findings and chart points of every entity.

One scan of the fact gives two periods for every entity and for the whole scope;
everything after that works on one row per entity.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import abs_decimal, dec_div, order_key, ratio6
from tabulith.operators import metrics as M
from tabulith.operators.scope import Scope, complete_periods
from tabulith.policy import POLICY
from tabulith.session import cut_lineage
from tabulith.sources.tables import money_text

WHOLE = "all"
MONEY = ("revenue", "target", "cost")
COUNTS = ("orders", "downtime")


@dataclass(frozen=True)
class Briefing:
    """The parts of one analysis; each is a DataFrame."""

    figures: DataFrame
    metrics: DataFrame
    proofs: DataFrame
    findings: DataFrame


def figures(fact: DataFrame, current: Scope, previous: Scope, entity: str = "region") -> DataFrame:
    """Two-period totals per entity plus one ``all`` row, from a single scan.

    Metrics, findings and charts all read this frame, so the few rows are written
    before they branch.
    """
    per_entity = M.two_periods(fact, entity, current, previous, (*MONEY, *COUNTS), "rows")
    names = [c for c in per_entity.columns if c != entity]
    rolled = per_entity.rollup(entity).agg(*[F.sum(c).alias(c) for c in names])
    return cut_lineage(rolled.withColumn(entity, F.coalesce(entity, F.lit(WHOLE))).withColumnRenamed(entity, "entity"))


def _slug(entity: Column) -> Column:
    return F.regexp_replace(F.lower(entity), " ", "-")


def _json_metric(id_: Column) -> Column:
    return F.concat(F.lit('{"op":"metric","metric_id":"'), id_, F.lit('"}'))


def _json_binary(op: str, left: Column, right: Column) -> Column:
    return F.concat(F.lit(f'{{"op":"{op}","left":'), left, F.lit(',"right":'), right, F.lit("}"))


def metric_frame(figs: DataFrame, current: Scope, previous: Scope) -> DataFrame:
    """Long metrics with their defining expression, one row per entity and figure."""
    base = _slug(F.col("entity"))
    name = lambda suffix: F.concat(base, F.lit(f"-{suffix}"))
    null = F.lit(None).cast("string")
    items: list[Column] = []

    def item(ordinal, suffix, label, unit, value, reason, num, den, rows, period, expression):
        items.append(
            F.struct(
                F.lit(ordinal).alias("ordinal"), name(suffix).alias("metric_id"), F.lit(label).alias("label"),
                F.lit(unit).alias("unit"), value.alias("plain"), reason.cast("string").alias("reason"),
                num.cast("string").alias("num"), den.cast("string").alias("den"), F.col(rows).alias("eligible_rows"),
                F.col(rows).alias("total_rows"), F.lit(period.start).alias("scope_start"), F.lit(period.end).alias("scope_end"),
                expression.alias("expression"),
            )
        )

    def total(ordinal, suffix, field, period, which):
        column = F.col(f"{field}_{which}")
        value = money_text(column) if field in MONEY else column.cast("string")
        expression = F.concat(
            F.lit('{"op":"sum","selection_id":"'), name(suffix), F.lit(f'-rows","field":"{field}"}}')
        )
        unit = "currency" if field in MONEY else ("minutes" if field == "downtime" else "count")
        item(ordinal, suffix, f"metric.{field}", unit, value, null, null, null, f"rows_{which}", period, expression)

    total(1, "current-revenue", "revenue", current, "cur")
    total(2, "current-target", "target", current, "cur")
    total(3, "previous-orders", "orders", previous, "prev")
    total(4, "current-orders", "orders", current, "cur")
    total(5, "previous-downtime", "downtime", previous, "prev")
    total(6, "current-downtime", "downtime", current, "cur")
    total(7, "current-cost", "cost", current, "cur")

    def change(ordinal, suffix, label, cur, prev, cur_id, prev_id, ok, why):
        expression = _json_binary(
            "divide",
            _json_binary("subtract", _json_metric(name(cur_id)), _json_metric(name(prev_id))),
            _json_metric(name(prev_id)),
        )
        item(ordinal, suffix, label, "ratio", null, F.when(~ok, F.lit(why)), F.when(ok, F.col(cur) - F.col(prev)),
             F.when(ok, F.col(prev)), "rows_cur", current, expression)

    change(8, "target-gap", "metric.targetGap", "revenue_cur", "target_cur", "current-revenue", "current-target",
           F.col("target_cur") > 0, "metric.targetNonPositive")
    change(9, "orders-change", "metric.ordersChange", "orders_cur", "orders_prev", "current-orders", "previous-orders",
           F.col("orders_prev") != 0, "metric.notComputable")
    change(10, "downtime-change", "metric.downtimeChange", "downtime_cur", "downtime_prev", "current-downtime",
           "previous-downtime", F.col("downtime_prev") != 0, "metric.notComputable")
    contribution = F.col("revenue_cur") - F.col("cost_cur")
    item(11, "contribution", "metric.contribution", "currency", money_text(contribution), null, null, null, "rows_cur",
         current, _json_binary("subtract", _json_metric(name("current-revenue")), _json_metric(name("current-cost"))))
    ok = F.col("revenue_cur") > 0
    item(12, "margin", "metric.margin", "ratio", null, F.when(~ok, F.lit("metric.revenueNonPositive")),
         F.when(ok, contribution), F.when(ok, F.col("revenue_cur")), "rows_cur", current,
         _json_binary("divide", _json_metric(name("contribution")), _json_metric(name("current-revenue"))))

    long = figs.select("entity", F.explode(F.array(*items)).alias("m")).select("entity", "m.*")
    # Quotients only exist on this aggregated frame: 40 digits, half-up.
    valued = long.withColumn("value", F.coalesce("plain", dec_div("num", "den"))).withColumn(
        "ratio", F.when(F.col("num").isNotNull(), ratio6(F.col("num").cast("decimal(38,0)"), F.col("den").cast("decimal(38,0)")))
    )
    return valued.withColumn("status", F.when(F.col("reason").isNull(), "defined").otherwise("undefined")).withColumn(
        "provenance_id", F.concat("metric_id", F.lit("-proof"))
    ).withColumn("warnings", F.array().cast("array<string>")).withColumn("scope_region", F.col("entity")).drop("plain", "num", "den")


def proof_frame(metrics: DataFrame) -> DataFrame:
    """One proof per metric: its expression, result, and own selection for a sum."""
    own = F.when(F.col("expression").startswith('{"op":"sum"'), F.concat("metric_id", F.lit("-rows")))
    return metrics.select(
        F.col("provenance_id").alias("proof_id"), "expression", F.col("value").alias("result"), "status", "reason",
        own.alias("selection_id"),
    )


def _share(policy_value: Decimal, amount: Column) -> Column:
    return F.lit(policy_value) * amount.cast("decimal(30,0)")


def divergence(f: dict[str, Column], complete: Column) -> Column:
    """Revenue well below target while orders clearly rise, on enough rows."""
    gap = F.col("revenue_cur") - F.col("target_cur")
    rise = F.col("orders_cur") - F.col("orders_prev")
    return (
        complete
        & (F.col("target_cur") > 0)
        & (F.col("orders_prev") > 0)
        & (gap.cast("decimal(30,0)") <= -_share(POLICY.target_gap, F.col("target_cur")))
        & (rise.cast("decimal(30,0)") >= _share(POLICY.orders_increase, F.col("orders_prev")))
        & (F.col("rows_cur") >= POLICY.min_comparison_rows)
    )


def material_change(prior_total: Column, complete: Column) -> Column:
    """Downtime change that is large for the entity and for the whole prior scope."""
    delta = F.abs(F.col("downtime_cur") - F.col("downtime_prev")).cast("decimal(30,0)")
    return (
        complete
        & (F.col("downtime_prev") > 0)
        & (delta >= _share(POLICY.period_change, F.col("downtime_prev")))
        & (delta >= _share(POLICY.materiality_share, prior_total))
        & (F.col("rows_cur") >= POLICY.min_comparison_rows)
        & (F.col("rows_prev") >= POLICY.min_comparison_rows)
    )


def both_complete(fact: DataFrame, current: Scope, previous: Scope, calendar: DataFrame, confirmed: bool = True) -> Column:
    """Whether both periods have rows on every scheduled day, as one scalar."""
    named = fact.sparkSession.createDataFrame([("current", current.start, current.end), ("previous", previous.start, previous.end)], "period string, start string, end string")
    periods = named.select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    return complete_periods(fact, calendar, periods, confirmed).agg(F.bool_and("complete").alias("c")).scalar()


FINDING_SCHEMA = (
    "finding_id", "rule_id", "kind", "severity", "entity", "class_priority", "coverage", "magnitude", "rank_magnitude", "metric_ids",
    "chart_id", "limitations", "complete", "coverage_note",
)


def entity_findings(figs: DataFrame, complete: Column | bool = True) -> DataFrame:
    """Divergence and period-change findings of every entity at once."""
    complete = F.lit(complete) if isinstance(complete, bool) else complete
    prior = figs.filter(F.col("entity") == WHOLE).select("downtime_prev").scalar()
    rows = figs.filter(F.col("entity") != WHOLE).withColumns({"_prior": prior, "_complete": complete})
    complete = F.col("_complete")
    base = _slug(F.col("entity"))
    ids = lambda *s: F.array(*[F.concat(base, F.lit(f"-{x}")) for x in s])

    def finding(test, prefix, rule, kind, priority, magnitude, rank, metric_ids, chart):
        return F.when(
            test,
            F.struct(
                F.concat(F.lit(f"finding-{prefix}-"), base).alias("finding_id"), F.lit(rule).alias("rule_id"),
                F.lit(kind).alias("kind"), F.lit("attention").alias("severity"), F.col("entity").alias("entity"),
                F.lit(priority).alias("class_priority"), F.lit("1").alias("coverage"), magnitude.alias("magnitude"), rank.alias("rank_magnitude"),
                metric_ids.alias("metric_ids"), F.concat(F.lit(f"{chart}-"), base).alias("chart_id"),
                F.array(F.lit("limitations.noCausality")).alias("limitations"), F.lit(True).alias("complete"),
                F.lit("coverage.confirmed").alias("coverage_note"),
            ),
        )

    gap = F.abs(ratio6(F.col("revenue_cur") - F.col("target_cur"), F.col("target_cur")))
    change = ratio6(F.col("downtime_cur") - F.col("downtime_prev"), F.col("downtime_prev"))
    # Ranks are compared as decimals of 40 digits; the six places above are for showing.
    exact = lambda a, b: dec_div((F.col(a) - F.col(b)).cast("string"), F.col(b).cast("string"))
    rows = rows.withColumns({"_gap": abs_decimal(exact("revenue_cur", "target_cur")), "_change": exact("downtime_cur", "downtime_prev")})
    found = F.filter(
        F.array(
            finding(divergence({}, complete), "target", "target-orders-v1", "divergence", 1, gap, F.col("_gap"),
                    ids("current-revenue", "current-target", "target-gap", "orders-change"), "chart-target"),
            finding(material_change(F.col("_prior"), complete), "downtime", "downtime-mom-v1", "period-change", 2, change, F.col("_change"),
                    ids("previous-downtime", "current-downtime", "downtime-change"), "chart-downtime"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.select(F.explode(found).alias("f")).select("f.*")


def quality_findings(ledger: DataFrame) -> DataFrame:
    """At most one finding from a ledger: its size, and whether fixes are pending."""
    counts = ledger.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.col("status") == "proposed"), F.lit(False)).alias("pending"),
        F.coalesce(F.bool_or(F.col("kind") == "missing"), F.lit(False)).alias("missing"),
    ).filter("n > 0")
    limits = F.when(F.col("missing"), F.array(F.lit("limitations.missingRetained"))).otherwise(F.array().cast("array<string>"))
    return counts.select(
        F.lit("finding-quality").alias("finding_id"), F.lit("quality-ledger-v1").alias("rule_id"), F.lit("quality").alias("kind"),
        F.lit("attention").alias("severity"), F.lit(WHOLE).alias("entity"), F.lit(3).alias("class_priority"), F.lit("1").alias("coverage"),
        F.col("n").cast("double").alias("magnitude"), F.col("n").cast("string").alias("rank_magnitude"),
        F.array(*[F.lit(f"quality-{k}") for k in ("duplicate", "category", "missing")]).alias("metric_ids"),
        F.lit("chart-quality").alias("chart_id"), limits.alias("limitations"), F.lit(True).alias("complete"),
        F.when(F.col("pending"), "finding.quality.body.pending").otherwise("finding.quality.body").alias("coverage_note"),
    )


def descriptive_finding(metrics: DataFrame) -> DataFrame:
    """The fallback finding that only lists the totals it describes.

    ``metrics`` is the figure list of one scope, a dozen rows.
    """
    return metrics.filter(F.col("entity") == WHOLE).agg(
        F.array_sort(F.collect_list("metric_id")).alias("metric_ids")
    ).select(
        F.lit("finding-descriptive").alias("finding_id"), F.lit("generic-descriptive-v1").alias("rule_id"),
        F.lit("descriptive").alias("kind"), F.lit("neutral").alias("severity"), F.lit(WHOLE).alias("entity"),
        F.lit(4).alias("class_priority"), F.lit("1").alias("coverage"), F.lit(0.0).alias("magnitude"), F.lit("0").alias("rank_magnitude"), "metric_ids",
        F.lit(None).cast("string").alias("chart_id"), F.array().cast("array<string>").alias("limitations"),
        F.lit(True).alias("complete"), F.lit("coverage.confirmed").alias("coverage_note"),
    )


def top_findings(findings: DataFrame, cap: int = POLICY.finding_cap) -> DataFrame:
    """Class, coverage, magnitude, id, decimals of any length; a top-k that never sorts the whole input."""
    return findings.orderBy(
        F.col("class_priority"), order_key(F.col("coverage")).desc(), order_key(F.col("rank_magnitude")).desc(), "finding_id"
    ).limit(cap)


def headline_metrics(metrics: DataFrame, ranked: DataFrame, cap: int, lead: int = 2) -> DataFrame:
    """Figures the first ``lead`` findings claim, then the rest in table order."""
    claimed = top_findings(ranked, lead).select(F.explode("metric_ids").alias("metric_id")).distinct().withColumn("_c", F.lit(0))
    joined = metrics.join(claimed, "metric_id", "left")
    return joined.orderBy(F.coalesce("_c", F.lit(1)), "entity", "ordinal").limit(cap).drop("_c")


def quality_metrics(ledger: DataFrame) -> DataFrame:
    from tabulith.operators.ledger import counts_by_kind

    counts = counts_by_kind(ledger)
    return counts.select(
        F.concat(F.lit("quality-"), "kind").alias("metric_id"), F.concat(F.lit("quality."), "kind").alias("label"),
        F.col("issues").cast("string").alias("value"), F.lit("count").alias("unit"),
    )


def downtime_chart(figs: DataFrame) -> DataFrame:
    """Two-point series per entity with its axis ceiling; values pair with metric ids."""
    base = _slug(F.col("entity"))
    top = F.greatest(F.abs("downtime_cur"), F.abs("downtime_prev")).cast("string")
    return figs.filter(F.col("entity") != WHOLE).select(
        F.concat(F.lit("chart-downtime-"), base).alias("chart_id"),
        F.lit("ltr").alias("chronology"),
        M.domain_ceiling(top).alias("domain_max"),
        F.posexplode(
            F.array(
                F.struct(F.lit("previous").alias("key"), F.col("downtime_prev").cast("string").alias("value"),
                         F.concat(base, F.lit("-previous-downtime")).alias("metric_id")),
                F.struct(F.lit("current").alias("key"), F.col("downtime_cur").cast("string").alias("value"),
                         F.concat(base, F.lit("-current-downtime")).alias("metric_id")),
            )
        ).alias("pos", "p"),
    ).select("chart_id", "chronology", "domain_max", "pos", "p.*")


def emphasised_points(points: DataFrame, findings: DataFrame) -> DataFrame:
    """(chart_id, key): the point a chart's finding is about.

    Time series mark the last claimed point, categories the first; a chart whose
    finding claims none of its points stays unmarked.
    """
    claims = findings.select("chart_id", F.explode("metric_ids").alias("metric_id"))
    hit = points.join(claims, ["chart_id", "metric_id"])
    return hit.groupBy("chart_id", "chronology").agg(
        F.max_by("key", "pos").alias("_last"), F.min_by("key", "pos").alias("_first")
    ).select("chart_id", F.when(F.col("chronology") == "ltr", F.col("_last")).otherwise(F.col("_first")).alias("key"))


def brief(fact: DataFrame, current: Scope, previous: Scope, ledger: DataFrame | None = None, calendar: DataFrame | None = None) -> Briefing:
    """The whole analysis of one fact and, optionally, its quality ledger.

    Findings that compare periods are withheld unless both cover ``calendar`` (date, period);
    without one, each has to have a row. ``fact`` is read twice, for the figures and the days.
    """
    figs = figures(fact, current, previous)
    metrics = metric_frame(figs, current, previous)
    days = calendar if calendar is not None else fact.select("date").limit(0)
    found = entity_findings(figs, both_complete(fact, current, previous, days)).unionByName(descriptive_finding(metrics))
    if ledger is not None:
        found = found.unionByName(quality_findings(ledger))
    return Briefing(figs, metrics, proof_frame(metrics), found)
