"""Operators that must stay exact under skew, long runs and sparse ids."""

from __future__ import annotations

import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulith.operators import ledger as L
from tabulith.operators import metrics, ordinals, quantiles, skew, spans
from tabulith.table import sheet_from_table


def compress(rows):
    out = []
    for r in sorted(set(rows)):
        if out and out[-1][1] + 1 == r:
            out[-1][1] = r
        else:
            out.append([r, r])
    return [tuple(x) for x in out]


@settings(max_examples=3, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from([1, 65_500, 131_000, 2**32 - 40, 2**32 + 9]), st.integers(0, 90)), min_size=1, max_size=150
    )
)
def test_spans_round_trip(spark, seeds):
    rows = [a + b for a, b in seeds]
    df = spark.createDataFrame([(r,) for r in rows], "r long")
    found = spans.to_spans(df, "r")
    assert sorted((x["start"], x["end"]) for x in found.collect()) == compress(rows)
    back = sorted(x["source_row"] for x in spans.expand_spans(found).collect())
    assert back == sorted(set(rows))


def test_a_run_over_many_blocks_is_one_span(spark):
    df = spark.range(10, 10 + 5 * 65_536).select(F.col("id").alias("r"))
    assert [(x["start"], x["end"]) for x in spans.to_spans(df, "r", distinct=False).collect()] == [(10, 10 + 5 * 65_536 - 1)]


def test_ordinals_pages_and_samples(spark):
    rng = random.Random(5)
    rows = sorted(rng.sample(range(1, 400_000), 6_000))
    df = spark.createDataFrame([(r,) for r in rows], "r long")
    got = [x["ordinal"] for x in ordinals.with_ordinal(df, "r").orderBy("r").collect()]
    assert got == list(range(1, len(rows) + 1))
    assert sorted(x["r"] for x in ordinals.page(df, "r", 4_321, 50).collect()) == rows[4_321:4_371]
    assert ordinals.page(df, "r", 6_000, 10).collect() == []
    picked = sorted(x["r"] for x in ordinals.systematic_sample(df, "r", 2_000).collect())
    assert picked == [rows[int(i * (len(rows) / 2_000))] for i in range(2_000)]


def test_quantiles_match_type7_with_ties_and_a_hot_value(spark):
    rng = random.Random(7)
    values = [("a", Decimal(rng.randint(0, 500)) / 100) for _ in range(2_000)] + [("a", Decimal("1.25"))] * 1_500
    values += [("b", Decimal(3))] + [("c", Decimal(v)) for v in range(1, 101)]
    df = spark.createDataFrame(values, "k string, v decimal(10,2)")
    got = {(r["k"], r["p"]): r["quantile"] for r in quantiles.quantiles(df, ["k"], "v", ("0.25", "0.5", "0.75", "0.1")).collect()}
    for k in "abc":
        data = sorted(v for kk, v in values if kk == k)
        for p in ("0.25", "0.5", "0.75", "0.1"):
            h = (len(data) - 1) * Decimal(p)
            j = int(h)
            upper = data[min(j + 1, len(data) - 1)]
            assert got[(k, p)] == data[j] + (h - j) * (upper - data[j]), (k, p)
    assert got[("c", "0.25")] == Decimal("25.75")


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    joined = skew.salted_join(rows, groups, ["k"], skew.hot_keys(groups, ["k"], "n"), ["id"])
    assert joined.count() == 30_000
    assert joined.filter("k = 'hot'").agg(F.count(F.lit(1)), F.max("first")).first()[:] == (10_000, 0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_salted_join_matches_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id long, k string")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert skew.salted_join(rows, groups, ["k"], skew.hot_keys(groups, ["k"], "n"), ["id"]).count() == 2


def test_duplicates_of_a_hot_row(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("w"))
    found = L.duplicate_rows(sheet_from_table(df, "id", ("v", "w")))
    assert found.count() == 1_499
    assert found.select("canonical_row").distinct().collect()[0][0] == 2


def test_null_and_empty_are_different_cells(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, None)], "id long, v string")
    assert [r["source_row"] for r in L.duplicate_rows(sheet_from_table(df, "id", ("v",))).collect()] == [4]


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_largest_remainder(spark, total, weights):
    df = spark.createDataFrame([("k", i, w, total) for i, w in enumerate(weights)], "k string, i long, w long, t long")
    got = [r["share"] for r in metrics.largest_remainder(df, ["k"], "w", "t", "i").orderBy("i").collect()]
    den = sum(weights)
    want = [total * w // den for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % den), i))
    for i in order[: total - sum(want)]:
        want[i] += 1
    assert got == want and sum(got) == total


def test_span_checks(spark):
    declared = [("ok", 1, 2, 4), ("ok", 2, 9, 9), ("bad", 1, 5, 3), ("bad", 2, 4, 8), ("adj", 1, 1, 2), ("adj", 2, 3, 4), ("zero", 1, 0, 1)]
    df = spark.createDataFrame(declared, "k string, ordinal long, start long, end long")
    counts = spark.createDataFrame([("ok", 4), ("bad", 5), ("adj", 4), ("zero", 2)], "k string, row_count long")
    got = {(r["k"], r["rule"]) for r in spans.check_spans(df, counts, "k").collect()}
    assert got == {
        ("bad", "span.inverted"), ("bad", "span.unsorted"), ("bad", "span.adjacent"), ("bad", "span.row-count"),
        ("adj", "span.adjacent"), ("zero", "span.before-first-row"),
    }


def test_huge_span_is_refused_before_expansion(spark):
    df = spark.createDataFrame([("x", 1, 2**31 - 1), ("y", 1, 10), ("z", 9, 3)], "k string, start long, end long")
    got = {r["k"]: r["reason"] for r in spans.oversized(df, ["k"], 50_000).collect()}
    assert got == {"x": "span-overflow", "z": "span-invalid"}
