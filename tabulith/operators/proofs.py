"""A proof graph as tables: figures that refer to figures, evaluated level by level.

A proof is an expression stored as JSON text. Its operands become edge rows, and
every figure is evaluated once all figures it refers to are: a level is one join of
the edges with the figures that just got a value, and one aggregation by the figure
that waits for them. Results are kept, so a figure that many others share is worked
out once. Figures that still wait when a level brings nothing new are on a cycle or
depend on one; each of them takes the reason of the first operand it cannot evaluate,
followed from figure to figure, and those that lead back to themselves are the cycle.
"""

from __future__ import annotations

import decimal as pydec
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.decimals import DECIMAL_PATTERN, MAX_LENGTH, NEGATIVE_ZERO, plain, results_agree
from tabulith.operators.expressions import Expression
from tabulith.session import cut_lineage

KNOWN = "array<struct<key:string,value:string,reason:string>>"
# Types as objects: DDL text would need a session when this module is imported.
_texts = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
OPERANDS, OUTCOME = T.ArrayType(_texts("kind", "a", "b")), _texts("value", "reason", "waits_for")

_SHAPE, _MINUS_ZERO = re.compile(DECIMAL_PATTERN.replace(r"\z", r"\Z")), re.compile(NEGATIVE_ZERO.replace(r"\z", r"\Z"))
_EXACT, _FORTY = pydec.Context(prec=400, rounding=pydec.ROUND_HALF_UP), pydec.Context(prec=40, rounding=pydec.ROUND_HALF_UP)
_BINARY = {"add": _EXACT.add, "subtract": _EXACT.subtract, "multiply": _EXACT.multiply, "divide": _FORTY.divide}


def proof_rows(spark, definitions: dict[str, Expression]) -> DataFrame:
    """(proof_id, expression) of a dict of definitions, as JSON text."""
    rows = [(k, json.dumps(v, separators=(",", ":"))) for k, v in definitions.items()]
    return spark.createDataFrame(rows, "proof_id string, expression string")


def _key(expression: dict) -> str | None:
    """The operand an expression node stands for; None for literals and arithmetic."""
    match expression.get("op"):
        case "metric":
            return f"metric|{expression['metric_id']}|"
        case "sum":
            return f"sum|{expression['selection_id']}|{expression['field']}"
        case "count-rows":
            return f"count-rows|{expression['selection_id']}|"
        case "count-issues":
            return f"count-issues|{expression['set_id']}|"
    return None


@F.pandas_udf(OPERANDS)
def _operands(expressions: pd.Series) -> pd.Series:
    def found(text: str | None) -> list[dict]:
        keys, todo = set(), [json.loads(text)] if text else []
        while todo:
            node = todo.pop()
            if (key := _key(node)) is not None:
                keys.add(key)
            todo += [node[side] for side in ("left", "right") if side in node]
        return [dict(zip(("kind", "a", "b"), k.split("|"), strict=True)) for k in sorted(keys)]

    return expressions.map(found)


def operand_rows(proofs: DataFrame, id_: str = "proof_id") -> DataFrame:
    """(id, kind, a, b): every figure, selection field, row count and issue set an expression uses, once."""
    return proofs.select(id_, F.explode(_operands("expression")).alias("o")).select(id_, "o.*")


def _evaluate(node: dict, known: dict) -> tuple[str | None, str | None, str | None]:
    """(value, reason, operand it waits for) of an expression; the left side's failure comes first."""
    if (key := _key(node)) is not None:
        return (*known[key], None) if key in known else (None, None, key)
    if node["op"] == "literal":
        text = node["value"]
        good = len(text) <= MAX_LENGTH and _SHAPE.search(text) and not _MINUS_ZERO.search(text)
        return (text, None, None) if good else (None, "literal.invalid", None)
    if node["op"] not in _BINARY:
        return None, "operator.unknown", None
    sides = [_evaluate(node[side], known) for side in ("left", "right")]
    for side in sides:
        if side[0] is None:
            return side
    left, right = (pydec.Decimal(side[0]) for side in sides)
    if node["op"] == "divide" and right == 0:
        return None, "divideByZero", None
    return plain(_BINARY[node["op"]](left, right)), None, None


@F.pandas_udf(OUTCOME)
def _outcomes(expressions: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = [
        _evaluate(json.loads(e), {k["key"]: (k.get("value"), k.get("reason")) for k in json.loads(o)}) if e else (None, None, None)
        for e, o in zip(expressions, known, strict=True)
    ]
    return pd.DataFrame(rows, columns=["value", "reason", "waits_for"], dtype=object)


def _outcome(known: Column) -> Column:
    return _outcomes("expression", F.to_json(known))


def evaluate_proofs(metrics: DataFrame, proofs: DataFrame, leaves: DataFrame, issue_counts: DataFrame | None = None) -> DataFrame:
    """(metric_id, value, reason) of every figure, recomputed through its proof.

    ``metrics``: metric_id, provenance_id, status; ``proofs``: proof_id, expression;
    ``leaves``: selection_id, field, declared, value, reason (``selection_leaves``);
    ``issue_counts``: set_id, value, reason. Stated values are never read. A figure that
    is stated as undefined stays so; one whose proof is absent is ``proof.missing``.
    """
    key = lambda kind, a, b: F.concat_ws("|", F.lit(kind), a, F.coalesce(b, F.lit("")))
    none = F.lit(None).cast("string")
    named = metrics.select("metric_id", F.col("provenance_id").alias("proof_id"), "status")
    figures = cut_lineage(
        named.join(proofs.select("proof_id", "expression"), "proof_id", "left").select(
            "metric_id", F.when(F.col("status") == "defined", F.col("expression")).alias("expression"),
            F.when(F.col("status") != "defined", "metric.undefined").when(F.col("expression").isNull(), "proof.missing").alias("reason"),
        )
    )
    used = cut_lineage(operand_rows(figures, "metric_id").withColumn("key", key(F.col("kind"), F.col("a"), F.col("b"))))

    # Leaves first: what needs no other figure.
    fields = leaves.select(F.col("selection_id").alias("a"), F.col("field").alias("b"), "value", "reason")
    sizes = leaves.groupBy(F.col("selection_id").alias("a")).agg(F.max("declared").cast("string").alias("size"))
    sums = used.filter("kind = 'sum'").join(fields, ["a", "b"], "left").join(sizes, "a", "left").select(
        "metric_id", "key", "value", F.when(F.col("size").isNull(), "selection.missing").when(F.col("value").isNull(), F.coalesce("reason", F.lit("fieldId.missing"))).alias("reason")
    )
    rows = used.filter("kind = 'count-rows'").join(sizes, "a", "left").select(
        "metric_id", "key", F.col("size").alias("value"), F.when(F.col("size").isNull(), "selection.missing").alias("reason")
    )
    counted = used.filter("kind = 'count-issues'")
    if issue_counts is None:
        issues = counted.select("metric_id", "key", none.alias("value"), F.lit("issueIds.missing").alias("reason"))
    else:
        sets = issue_counts.select(F.col("set_id").alias("a"), "value", "reason", F.lit(True).alias("there"))
        issues = counted.join(sets, "a", "left").select("metric_id", "key", "value", F.when(F.col("there").isNull(), "issueIds.missing").otherwise(F.col("reason")).alias("reason"))
    references = used.filter("kind = 'metric'").select("metric_id", "key", F.col("a").alias("child"))
    declared = figures.select(F.col("metric_id").alias("child"), F.lit(True).alias("there"))
    references = cut_lineage(references.join(declared, "child", "left"))
    unknown = references.filter("there is null").select("metric_id", "key", none.alias("value"), F.lit("metric.missing").alias("reason"))
    edges = references.filter("there").select("metric_id", "key", "child")

    arrived = sums.unionByName(rows).unionByName(issues).unionByName(unknown)
    gathered = arrived.groupBy("metric_id").agg(F.collect_list(F.struct("key", "value", "reason")).alias("known"))
    needs = edges.groupBy("metric_id").agg(F.count("*").alias("needs"))
    state = figures.join(gathered, "metric_id", "left").join(needs, "metric_id", "left").select(
        "metric_id", "expression", "reason", F.coalesce("known", F.array().cast(KNOWN)).alias("known"), F.coalesce("needs", F.lit(0)).alias("needs")
    )
    ready = F.col("reason").isNotNull() | (F.col("needs") == 0)
    state = cut_lineage(_step(state, ready))
    valued = []
    while not state.filter("fresh").isEmpty():
        fresh = state.filter("fresh").select("metric_id", "value", "reason")
        valued.append(fresh)
        news = edges.join(fresh.withColumnRenamed("metric_id", "child"), "child").groupBy("metric_id").agg(
            F.collect_list(F.struct("key", "value", "reason")).alias("news")
        )
        waiting = state.filter("not fresh").join(news, "metric_id", "left").select(
            "metric_id", "expression", F.lit(None).cast("string").alias("reason"), F.concat("known", F.coalesce("news", F.array().cast(KNOWN))).alias("known"),
            (F.col("needs") - F.coalesce(F.size("news"), F.lit(0))).alias("needs"),
        )
        state = cut_lineage(_step(waiting, F.col("needs") == 0))
    if not state.isEmpty():
        valued.append(_cycles(state))
    out = valued[0] if valued else figures.select("metric_id", none.alias("value"), "reason").limit(0)
    for part in valued[1:]:
        out = out.unionByName(part)
    return out


def _step(state: DataFrame, ready: Column) -> DataFrame:
    """Evaluate the figures whose operands are all there."""
    there = state.withColumn("fresh", ready).withColumn("o", _outcome(F.col("known")))
    given = F.col("fresh") & F.col("reason").isNull()
    return there.select(
        "metric_id", "expression", "known", "needs", "fresh", F.when(given, F.col("o.value")).alias("value"), F.when(given, F.col("o.reason")).otherwise(F.col("reason")).alias("reason")
    )


def _cycles(waiting: DataFrame) -> DataFrame:
    """Figures on or behind a cycle: undefined, for the reason that the first operand they cannot evaluate leads to."""
    o = waiting.withColumn("o", _outcome(F.col("known")))
    child = F.split("o.waits_for", r"\|")[1]
    open_ = cut_lineage(o.select("metric_id", F.col("o.reason").alias("reason"), child.alias("child")))
    settled, done = open_.filter("reason is not null").select("metric_id", "reason"), []
    while not settled.isEmpty():
        done.append(settled)
        led = settled.select(F.col("metric_id").alias("child"), F.col("reason").alias("found"))
        open_ = open_.filter("reason is null").join(led, "child", "left").select("metric_id", F.col("found").alias("reason"), "child")
        open_ = cut_lineage(open_)
        settled = open_.filter("reason is not null").select("metric_id", "reason")
    out = open_.filter("reason is null").select("metric_id", F.lit("metric.cycle").alias("reason"))
    for part in done:
        out = out.unionByName(part)
    return out.select("metric_id", F.lit(None).cast("string").alias("value"), "reason")


def arithmetic_violations(stated: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(metric_id, rule): stated figures that their proof does not give, and undefined ones that it does."""
    again = recomputed.select("metric_id", F.col("value").alias("_v"), F.col("reason").alias("_r"))
    joined = stated.filter("status = 'defined'").join(again, "metric_id", "left")
    rule = F.when(F.col("_v").isNull(), "metric.evaluate").when(~results_agree(F.col("value"), F.col("_v")), "metric.value.mismatch")
    return joined.withColumn("rule", rule).filter("rule is not null").select("metric_id", "rule", F.coalesce("_r", F.lit("")).alias("reason"))
