"""The closed metric grammar: figures defined as data (``proofs`` evaluates them).

A definition is a nested dict. Operators: ``literal`` (value), ``metric``
(metric_id), ``sum`` (selection_id, field), ``count-rows`` (selection_id),
``count-issues`` (set_id), ``add``, ``subtract``, ``multiply``, ``divide`` (left,
right). Text is never evaluated as code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import combine_limbs, is_decimal, limb_aggregates, with_exact_parts
from tabulith.operators.spans import join_spans

Expression = Mapping[str, object]


def literal(value: str) -> dict:
    return {"op": "literal", "value": value}


def metric(metric_id: str) -> dict:
    return {"op": "metric", "metric_id": metric_id}


def total(selection_id: str, field: str) -> dict:
    return {"op": "sum", "selection_id": selection_id, "field": field}


def binary(op: str, left: Expression, right: Expression) -> dict:
    return {"op": op, "left": left, "right": right}


def selection_leaves(rows: DataFrame, spans: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per selection: exact sums of ``fields``, rows present, declared and non-decimal.

    One range join and one map-side aggregation serve every leaf of a document.
    """
    covered = join_spans(rows.select("source_row", *fields), spans.select("selection_id", "start", "end"))
    aggs = [F.count(F.lit(1)).alias("present")]
    for i, f in enumerate(fields):
        ok = is_decimal(F.col(f"`{f}`"))
        covered = with_exact_parts(covered, F.col(f"`{f}`"), ok, f"_x{i}")
        aggs += limb_aggregates(f"_x{i}", f"s{i}_")
        aggs.append(F.count_if(~ok).alias(f"bad{i}"))
    sums = covered.groupBy("selection_id").agg(*aggs)
    declared = spans.groupBy("selection_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("declared"))
    found = declared.join(sums, "selection_id", "left")
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.coalesce(combine_limbs(f"s{i}_"), F.lit("0")).alias("value"),
                F.coalesce(F.col(f"bad{i}"), F.lit(0)).alias("bad"),
            )
            for i, f in enumerate(fields)
        ]
    )
    exploded = found.select("selection_id", "declared", F.coalesce("present", F.lit(0)).alias("present"), F.explode(cells).alias("c"))
    reason = F.when(F.col("present") < F.col("declared"), "row.missing").when(F.col("c.bad") > 0, "operand.notDecimal")
    return exploded.select(
        "selection_id", F.col("c.field").alias("field"), "declared",
        F.when(reason.isNull(), F.col("c.value")).alias("value"), reason.alias("reason"),
    )


def issue_set_counts(members: DataFrame, ledger: DataFrame) -> DataFrame:
    """(set_id, value, reason) for issue sets: repeats and unknown ids are undefined."""
    known = ledger.select("issue_id").distinct().withColumn("_known", F.lit(True))
    per_id = members.groupBy("set_id", "issue_id").agg(F.count(F.lit(1)).alias("_c"))
    joined = per_id.join(known, "issue_id", "left")
    sums = joined.groupBy("set_id").agg(
        F.max("_c").alias("_repeat"), F.count_if(F.col("_known").isNull()).alias("_unknown"), F.count(F.lit(1)).alias("_n")
    )
    reason = F.when(F.col("_repeat") > 1, "issueIds.duplicate").when(F.col("_unknown") > 0, "issueIds.missing")
    return sums.select("set_id", F.when(reason.isNull(), F.col("_n").cast("string")).alias("value"), reason.alias("reason"))


# --- expressions stored as JSON text ---------------------------------------


def _ids(expression: Column, field: str) -> Column:
    return F.regexp_extract_all(expression, F.lit(f'"{field}":"([^"]*)"'), F.lit(1))


def operands(proofs: DataFrame) -> DataFrame:
    """(proof_id, operand, value): every reference and literal an expression uses."""
    e = F.col("expression")

    def tag(kind: str, field: str) -> Column:
        return F.transform(_ids(e, field), lambda v: F.struct(F.lit(kind).alias("operand"), v.alias("value")))

    tagged = F.concat(
        tag("metric", "metric_id"), tag("selection", "selection_id"), tag("issue-set", "set_id"), tag("literal", "value")
    )
    return proofs.select("proof_id", F.explode(tagged).alias("o")).select("proof_id", "o.*").distinct()


def dangling_references(proofs: DataFrame, metrics: DataFrame, selections: DataFrame) -> DataFrame:
    """Operands that name no declared metric or selection."""
    refs = operands(proofs)
    m = refs.filter("operand = 'metric'").join(metrics.select(F.col("metric_id").alias("value")), "value", "left_anti")
    s = refs.filter("operand = 'selection'").join(
        selections.select(F.col("selection_id").alias("value")), "value", "left_anti"
    )
    return m.unionByName(s).select("proof_id", "operand", "value")


def delta_baseline(proofs: DataFrame) -> DataFrame:
    """(proof_id, baseline): the non-scenario leg of ``(scenario - baseline) * 100``."""
    pattern = (
        r'^\{"op":"multiply","left":\{"op":"subtract","left":\{"op":"metric","metric_id":"(scenario-[^"]*)"\},'
        r'"right":\{"op":"metric","metric_id":"([^"]*)"\}\},"right":\{"op":"literal","value":"100"\}\}\z'
    )
    baseline = F.regexp_extract("expression", pattern, 2)
    ok = (baseline != "") & ~baseline.startswith("scenario-")
    return proofs.select("proof_id", F.when(ok, baseline).alias("baseline")).filter("baseline is not null")
