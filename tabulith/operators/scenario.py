"""What-if runs: one cost factor applied after aggregation, many factors at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import compare_decimal, dec_add, dec_div, dec_mul, dec_quantize, dec_sub, fraction_scale, is_decimal, is_multiple_of, ratio6
from tabulith.functions.text import scenario_id
from tabulith.policy import POLICY
from tabulith.session import cut_lineage


class ScenarioError(ValueError):
    """A cost change that is malformed, out of range or off the step."""


def change_problem(change: Column) -> Column:
    """Why a cost change text is refused, or null; values are never clamped."""
    below = compare_decimal(change, F.lit(str(POLICY.scenario_min))) < 0
    above = compare_decimal(change, F.lit(str(POLICY.scenario_max))) > 0
    return (
        F.when(~is_decimal(change), "not-a-decimal")
        .when(below | above, "out-of-range")
        .when(~is_multiple_of(change, str(POLICY.scenario_step)), "off-step")
    )


def assert_change(change: str) -> str:
    """Driver-side form of the same rules for a single call."""
    try:
        value = Decimal(change)
    except ArithmeticError as error:
        raise ScenarioError(f"not a decimal: {change!r}") from error
    if not POLICY.scenario_min <= value <= POLICY.scenario_max:
        raise ScenarioError(f"{change} is outside [{POLICY.scenario_min}, {POLICY.scenario_max}]")
    if value % POLICY.scenario_step != 0:
        raise ScenarioError(f"{change} is not a multiple of {POLICY.scenario_step}")
    return change


def unavailable_reason(revenue: Column, cost: Column, revenue_currency: Column, cost_currency: Column) -> Column:
    return (
        F.when(revenue <= 0, "scenario.zeroRevenue")
        .when(cost < 0, "scenario.negativeCost")
        .when(revenue_currency != cost_currency, "scenario.unavailable")
    )


def sweep(
    baseline: DataFrame,
    changes: Sequence[str],
    revenue: str = "revenue",
    cost: str = "cost",
    currencies: tuple[str, str] = ("USD", "USD"),
) -> DataFrame:
    """Scenario figures per baseline row and cost change.

    ``baseline`` holds whole cents per scope; the change list is exploded beside
    each row. Scenario cost is rounded half-up to the cent, margins and the margin
    delta (percentage points) follow from the rounded cost.
    """
    for change in changes:
        assert_change(change)
    listed = F.explode(F.array(*[F.lit(c) for c in changes]))
    rows = baseline.withColumn("cost_change", listed)
    rev, cst = F.col(revenue), F.col(cost)
    factor = F.lit(1).cast("decimal(4,3)") + F.col("cost_change").cast("decimal(4,3)")
    scenario_cost = F.round(cst.cast("decimal(30,0)") * factor, 0).cast("long")
    reason = unavailable_reason(rev, cst, F.lit(currencies[0]), F.lit(currencies[1]))
    out = rows.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "defined").otherwise("unavailable")
    )
    ok = F.col("reason").isNull()
    out = out.withColumn("scenario_cost", F.when(ok, scenario_cost))
    out = out.withColumn("contribution", F.when(ok, rev - F.col("scenario_cost")))
    out = out.withColumn("margin", F.when(ok, ratio6(F.col("contribution"), rev)))
    # Both margins share the revenue, so their difference is one exact ratio.
    return out.withColumn("margin_delta_pp", F.when(ok, ratio6((cst - F.col("scenario_cost")) * 100, rev)))


def margin_chart(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two points per run, baseline and scenario margin, on a fixed 1.5x domain."""
    base = ratio6(F.col("revenue") - F.col("cost"), F.col("revenue"))
    points = F.array(
        F.struct(F.lit("baseline").alias("point"), base.alias("value")),
        F.struct(F.lit("scenario").alias("point"), F.col("margin").alias("value")),
    )
    usable = swept.filter((F.col("status") == "defined") & (F.col("revenue") > F.col("cost")))
    ceiling = ratio6((F.col("revenue") - F.col("cost")) * 3, F.col("revenue") * 2)
    return usable.select(*keys, "cost_change", ceiling.alias("domain_max"), F.explode(points).alias("p")).select(
        *keys, "cost_change", "p.point", "p.value", "domain_max"
    )


def baseline_margin(metrics: DataFrame, scope: DataFrame) -> DataFrame:
    """First defined ratio metric with exactly the analysis scope, per analysis."""
    same = metrics.filter((F.col("status") == "defined") & (F.col("unit") == "ratio")).join(
        scope, ["scope_start", "scope_end", "scope_region"], "left_semi"
    )
    return same.groupBy("scope_region").agg(F.min_by("metric_id", "ordinal").alias("metric_id"))


# --- scenarios with figures and proofs of their own ----------------------------


@dataclass(frozen=True)
class Scenarios:
    """``results``: scenario_id, snapshot, cost_change, status, reason; ``metrics`` and ``proofs``
    in the namespace of their scenario; ``problems``: runs that could not be made."""

    results: DataFrame
    metrics: DataFrame
    proofs: DataFrame
    problems: DataFrame


def _json(op: str, left: Column, right: Column) -> Column:
    return F.concat(F.lit(f'{{"op":"{op}","left":'), left, F.lit(',"right":'), right, F.lit("}"))


def _ref(id_: Column) -> Column:
    return F.concat(F.lit('{"op":"metric","metric_id":"'), id_, F.lit('"}'))


def _number(text: Column) -> Column:
    return F.concat(F.lit('{"op":"literal","value":"'), text, F.lit('"}'))


def run_scenarios(metrics: DataFrame, runs: DataFrame) -> Scenarios:
    """Every run as four figures with proofs, made from one template; nothing is raised, what cannot run is a row.

    ``metrics``: snapshot, metric_id, value, status, unit, currency; ``runs``: snapshot,
    revenue_id, cost_id, margin_id (null: no delta), cost_change. Required baseline
    figures are joins that report: ``missing-metric``, ``undefined-metric``, or what is
    wrong with the change. Money keeps the wider scale of the two figures, half-up;
    margins are quotients of 40 digits. A figure's id is its name behind the id of the
    scenario, so all runs and their baseline stand in one namespace.
    """
    side = lambda n: metrics.select("snapshot", F.col("metric_id").alias(f"{n}_id"), F.col("value").alias(n), F.col("status").alias(f"{n}_status"), F.col("currency").alias(f"{n}_currency"))
    named = runs.withColumn("scenario_id", scenario_id(F.col("snapshot"), F.col("cost_change")))
    met = cut_lineage(named.join(side("revenue"), ["snapshot", "revenue_id"], "left").join(side("cost"), ["snapshot", "cost_id"], "left"))
    missing = F.col("revenue_status").isNull() | F.col("cost_status").isNull()
    vague = (F.col("revenue_status") != "defined") | (F.col("cost_status") != "defined") | F.col("revenue").isNull() | F.col("cost").isNull()
    problem = F.coalesce(change_problem(F.col("cost_change")), F.when(missing, "missing-metric").when(vague, "undefined-metric"))
    told = met.withColumn("problem", problem)
    problems = told.filter("problem is not null").select("scenario_id", "snapshot", "cost_change", "problem")
    zero = F.lit("0")
    reason = (
        F.when(compare_decimal(F.col("revenue"), zero) <= 0, "scenario.zeroRevenue")
        .when(compare_decimal(F.col("cost"), zero) < 0, "scenario.negativeCost")
        .when(F.col("revenue_currency") != F.col("cost_currency"), "scenario.unavailable")
    )
    able = cut_lineage(told.filter("problem is null").drop("problem").withColumn("reason", reason))
    results = able.select("scenario_id", "snapshot", "cost_change", F.when(F.col("reason").isNull(), "defined").otherwise("unavailable").alias("status"), "reason")

    scale = F.greatest(fraction_scale(F.col("revenue")), fraction_scale(F.col("cost")))
    go = able.filter("reason is null").withColumn("scenario_cost", dec_quantize(dec_mul("cost", dec_add(F.lit("1"), F.col("cost_change"))), scale))
    go = go.withColumn("contribution", dec_quantize(dec_sub("revenue", "scenario_cost"), scale)).withColumn("margin", dec_div("contribution", "revenue"))
    delta = dec_mul(dec_sub(F.col("margin"), dec_div(dec_sub("revenue", "cost"), F.col("revenue"))), F.lit("100"))
    go = cut_lineage(go.withColumn("delta", F.when(F.col("margin_id").isNotNull(), delta)))
    own = lambda name: F.concat("scenario_id", F.lit(f":{name}"))
    factor = _json("add", _number(F.lit("1")), _number(F.col("cost_change")))
    figures = (
        ("scenario-cost", "currency", "cost_currency", "scenario_cost", _json("multiply", _ref(F.col("cost_id")), factor)),
        ("scenario-contribution", "currency", "revenue_currency", "contribution", _json("subtract", _ref(F.col("revenue_id")), _ref(own("scenario-cost")))),
        ("scenario-margin", "ratio", None, "margin", _json("divide", _ref(own("scenario-contribution")), _ref(F.col("revenue_id")))),
        ("scenario-margin-delta-pp", "percentage-point", None, "delta", _json("multiply", _json("subtract", _ref(own("scenario-margin")), _ref(F.col("margin_id"))), _number(F.lit("100")))),
    )
    rows = F.array(
        *[
            F.struct(
                own(name).alias("metric_id"), F.lit(unit).alias("unit"), (F.col(currency) if currency else F.lit(None).cast("string")).alias("currency"), F.col(value).alias("value"),
                F.concat(own(name), F.lit("-proof")).alias("provenance_id"), expression.alias("expression"),
            )
            for name, unit, currency, value, expression in figures
        ]
    )
    long = cut_lineage(go.select("scenario_id", "snapshot", F.explode(rows).alias("m")).select("scenario_id", "snapshot", "m.*").filter("value is not null"))
    stated = long.select("scenario_id", "snapshot", "metric_id", "value", F.lit("defined").alias("status"), "unit", "currency", "provenance_id")
    proofs = long.select("scenario_id", F.col("provenance_id").alias("proof_id"), "expression", F.col("value").alias("result"), F.lit("defined").alias("status"))
    return Scenarios(results, stated, proofs, problems)
