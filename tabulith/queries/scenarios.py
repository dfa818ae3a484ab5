"""Scenario runs as figures and proofs in one namespace with their baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import bundle as U
from tabulith.operators import expressions as X
from tabulith.operators import proofs as P
from tabulith.operators import scenario as SC
from tabulith.operators.figures import selection_values
from tabulith.plans import briefing as B
from tabulith.queries.briefing import BASE, CHANGES, FIGS, figures, metrics
from tabulith.queries.figures import briefing_evidence
from tabulith.queries.registry import CURRENT, long_division_sql, money_sql, query, ratio_sql
from tabulith.session import cut_lineage


def _baselines(spark: SparkSession, folder: str) -> DataFrame:
    """The figures of the briefing, one snapshot an entity; Europe's cost is kept in another currency."""
    m = cut_lineage(metrics(spark, folder))
    slug = F.regexp_replace(F.lower("entity"), " ", "-")
    euro = (F.col("entity") == "EUROPE") & F.col("metric_id").endswith("-current-cost")
    return m.withColumn("snapshot", slug).withColumn("currency", F.when(euro, "EUR").when(F.col("unit") == "currency", "USD"))


def _runs(spark: SparkSession, folder: str, base: DataFrame, changes=CHANGES) -> DataFrame:
    """Every change over every snapshot; the delta goes to the first defined ratio of the snapshot's own scope."""
    scope = figures(spark, folder).select(F.lit(CURRENT[0]).alias("scope_start"), F.lit(CURRENT[1]).alias("scope_end"), F.col("entity").alias("scope_region"))
    margins = SC.baseline_margin(base, scope).select(F.regexp_replace(F.lower("scope_region"), " ", "-").alias("snapshot"), F.col("metric_id").alias("margin_id"))
    listed = base.select("snapshot").distinct().join(margins, "snapshot", "left").withColumn("cost_change", F.explode(F.array(*[F.lit(c) for c in changes])))
    own = lambda s: F.concat("snapshot", F.lit(s))
    return listed.select("snapshot", own("-current-revenue").alias("revenue_id"), own("-current-cost").alias("cost_id"), "margin_id", "cost_change")


def scenarios(spark: SparkSession, folder: str) -> tuple[DataFrame, SC.Scenarios]:
    base = _baselines(spark, folder)
    return base, SC.run_scenarios(base, _runs(spark, folder, base))


_RUNS = f"""{BASE}, r AS (SELECT replace(lower(region), ' ', '-') AS slug, * FROM s),
 ids AS (SELECT *, 'scenario-' || slug || '-cost' || replace(replace(cost_change, '-', 'm'), '.', '') AS scenario_id FROM r),
 ok AS (SELECT * FROM ids WHERE slug <> 'europe')"""


@query(
    "scenario_figures",
    "C1 U1 C4 F10",
    f"""WITH {_RUNS}, nd AS (SELECT scenario_id || ':scenario-margin' AS id, CAST(revenue - scenario_cost AS HUGEINT) AS n, CAST(revenue AS HUGEINT) AS d FROM ok),
 {long_division_sql()} SELECT id AS metric_id, value FROM out
UNION ALL SELECT scenario_id || ':scenario-cost', {money_sql('CAST(scenario_cost AS DECIMAL(30,0)) * 0.01')} FROM ok
UNION ALL SELECT scenario_id || ':scenario-contribution', {money_sql('CAST(revenue - scenario_cost AS DECIMAL(30,0)) * 0.01')} FROM ok""",
)
def scenario_figures(spark, folder):
    return scenarios(spark, folder)[1].metrics.filter("unit <> 'percentage-point'").select("metric_id", "value")


@query(
    "scenario_deltas",
    "C1 C4",
    f"WITH {_RUNS} SELECT scenario_id, {ratio_sql('(cost - scenario_cost) * 100', 'revenue')} AS delta_pp FROM ok",
)
def scenario_deltas(spark, folder):
    """Percentage points against the baseline's margin; 40 digits are kept, six compared."""
    m = scenarios(spark, folder)[1].metrics.filter("unit = 'percentage-point'")
    return m.select("scenario_id", F.round(F.col("value").cast("decimal(38,30)"), 6).cast("double").alias("delta_pp"))


@query(
    "scenario_results",
    "C1 C3 F17",
    f"""WITH {_RUNS} SELECT scenario_id, slug AS snapshot, cost_change, CASE WHEN slug = 'europe' THEN 'unavailable' ELSE 'defined' END AS status,
 CASE WHEN slug = 'europe' THEN 'scenario.unavailable' END AS reason FROM ids""",
)
def scenario_results(spark, folder):
    return scenarios(spark, folder)[1].results


@query(
    "scenario_requirements",
    "J11 C2 V12",
    f"""WITH {FIGS}, c AS (SELECT UNNEST(['0.08', '0.4', '0.0805', '8%']) AS cost_change)
SELECT slug AS snapshot, cost_change, CASE WHEN cost_change = '0.4' THEN 'out-of-range' WHEN cost_change = '0.0805' THEN 'off-step' WHEN cost_change = '8%' THEN 'not-a-decimal'
  WHEN slug = 'asia' THEN 'missing-metric' ELSE 'undefined-metric' END AS problem FROM f, c WHERE cost_change <> '0.08' OR slug IN ('asia', 'africa')""",
)
def scenario_requirements(spark, folder):
    """Asia has lost its revenue figure, Africa's cost is undefined; changes that no run may take."""
    base = _baselines(spark, folder)
    vague = F.col("metric_id") == "africa-current-cost"
    damaged = base.filter("metric_id <> 'asia-current-revenue'").withColumn("status", F.when(vague, "undefined").otherwise(F.col("status")))
    return SC.run_scenarios(damaged, _runs(spark, folder, base, ("0.08", "0.4", "0.0805", "8%"))).problems.select("snapshot", "cost_change", "problem")


@query(
    "namespace_union",
    "U1 C1",
    f"""WITH {_RUNS} SELECT slug AS snapshot, scenario_id || ':' || UNNEST(['scenario-cost', 'scenario-contribution', 'scenario-margin', 'scenario-margin-delta-pp']) AS metric_id FROM ok
UNION ALL SELECT DISTINCT slug, slug || '-' || UNNEST(['current-revenue', 'current-target', 'previous-orders', 'current-orders', 'previous-downtime', 'current-downtime', 'current-cost', 'target-gap', 'orders-change', 'downtime-change', 'contribution', 'margin']) FROM ids""",
)
def namespace_union(spark, folder):
    """Baseline and scenario figures side by side; ids that both have would be told by ``scenario_checks``."""
    base, run = scenarios(spark, folder)
    return base.select("snapshot", "metric_id").unionByName(run.metrics.select("snapshot", "metric_id"))


@query(
    "delta_baselines",
    "E14 C4",
    f"WITH {_RUNS} SELECT scenario_id || ':scenario-margin-delta-pp-proof' AS proof_id, slug || '-target-gap' AS baseline FROM ok",
)
def delta_baselines(spark, folder):
    return X.delta_baseline(scenarios(spark, folder)[1].proofs)


@query(
    "scenario_checks",
    "V12 U4 V13",
    f"""WITH {_RUNS} SELECT scenario_id AS bundle, 'id.unique' AS rule, slug || '-margin' AS object_id FROM ok WHERE cost_change = '0.08'
UNION ALL SELECT scenario_id, 'expression.metricId.missing', scenario_id || ':scenario-contribution-proof' FROM ok WHERE cost_change = '0.30' AND slug = 'asia'""",
)
def scenario_checks(spark, folder):
    """Real runs as bundles over their snapshots; runs of 0.08 took an id of the baseline, Asia lost its revenue."""
    base, run = scenarios(spark, folder)
    none = F.lit(None).cast("string")
    props = F.create_map().cast("map<string,string>").alias("props")

    def rows(df, bundle, kind, id_, value):
        return df.select(F.col(bundle).alias("bundle"), F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.lit("defined").alias("status"), F.col(value).alias("value"), none.alias("reason"), props)

    clash = run.results.filter("status = 'defined' and cost_change = '0.08'").select("scenario_id", F.concat("snapshot", F.lit("-margin")).alias("id"), F.lit("1").alias("value"))
    lost = run.results.filter("status = 'defined' and cost_change = '0.30' and snapshot = 'asia'").select("scenario_id")
    # A snapshot of its own for the run that lost a figure.
    parent = F.when((F.col("cost_change") == "0.30") & (F.col("snapshot") == "asia"), "asia-lost").otherwise(F.col("snapshot"))
    snapshots = base.filter("status = 'defined'").select("snapshot", "metric_id", F.coalesce("value", F.lit("0")).alias("value"))
    thin = snapshots.filter("snapshot = 'asia' and metric_id <> 'asia-current-revenue'").withColumn("snapshot", F.lit("asia-lost"))
    objects = rows(snapshots.unionByName(thin), "snapshot", "metric", "metric_id", "value").unionByName(rows(run.metrics, "scenario_id", "metric", "metric_id", "value"))
    objects = objects.unionByName(rows(run.proofs, "scenario_id", "proof", "proof_id", "result")).unionByName(rows(clash, "scenario_id", "metric", "id", "value"))
    used = P.operand_rows(run.proofs.join(lost, "scenario_id", "left_anti").unionByName(run.proofs.join(lost, "scenario_id", "left_semi").filter("proof_id like '%contribution-proof'")))
    owner = run.proofs.select("proof_id", F.col("scenario_id").alias("bundle"))
    references = used.filter("kind = 'metric'").join(owner, "proof_id").select("bundle", F.lit("expression.metric").alias("role"), F.col("proof_id").alias("id"), F.col("a").alias("target"))
    backed = run.metrics.select(F.col("scenario_id").alias("bundle"), F.lit("metric.provenance").alias("role"), F.col("metric_id").alias("id"), F.col("provenance_id").alias("target"))
    heads = run.results.select(F.col("scenario_id").alias("bundle"), parent.alias("parent"), props)
    return U.violations(U.Bundles(objects, references.unionByName(backed), heads))


@query(
    "scenario_recomputed",
    "E2 V10 C1",
    f"""WITH {_RUNS}, x AS (SELECT *, CAST(cost AS HUGEINT) * CAST(1000 + CAST(CAST(cost_change AS DECIMAL(4,3)) * 1000 AS INTEGER) AS HUGEINT) AS exact FROM ok)
SELECT scenario_id || ':scenario-cost' AS metric_id, exact = CAST(scenario_cost AS HUGEINT) * 1000 AS agrees FROM x
UNION ALL SELECT scenario_id || ':scenario-contribution', exact = CAST(scenario_cost AS HUGEINT) * 1000 FROM x""",
)
def scenario_recomputed(spark, folder):
    """Proofs of the runs evaluated through those of their baseline, down to the rows; money that was rounded differs from its proof."""
    rows, e = briefing_evidence(spark, folder)
    base, run = scenarios(spark, folder)
    base = base.withColumn("currency", F.lit("USD"))
    stated = base.select("metric_id", "value", "status", "provenance_id").unionByName(run.metrics.select("metric_id", "value", "status", "provenance_id"))
    proofs = B.proof_frame(base).select("proof_id", "expression").unionByName(run.proofs.select("proof_id", "expression"))
    again = P.evaluate_proofs(stated, proofs, selection_values(rows, e))
    wrong = P.arithmetic_violations(stated, again).select("metric_id", F.lit(True).alias("wrong"))
    money = run.metrics.filter("unit = 'currency'").select("metric_id")
    return money.join(wrong, "metric_id", "left").select("metric_id", F.col("wrong").isNull().alias("agrees"))
