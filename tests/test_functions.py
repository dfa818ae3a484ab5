"""Scalar laws checked on generated values in one DataFrame per law."""

from __future__ import annotations

import decimal
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulith.functions import decimals as D
from tabulith.functions import numbers as NU
from tabulith.functions import text as T
from tabulith.operators.metrics import domain_ceiling

decimals = st.builds(
    lambda neg, i, f: ("-" if neg and (int(i) or int(f or 0)) else "") + i + (f".{f}" if f else ""),
    st.booleans(),
    st.integers(0, 10**40).map(str),
    st.one_of(st.just(""), st.text("0123456789", min_size=1, max_size=30)),
)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(decimals, decimals), min_size=20, max_size=60))
def test_exact_arithmetic_and_order(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select(
        "a", "b", D.dec_add("a", "b").alias("s"), D.dec_mul("a", "b").alias("m"), D.dec_div("a", "b").alias("q"),
        D.compare_decimal(F.col("a"), F.col("b")).alias("c"), D.normalize_decimal(F.col("a")).alias("n"),
        D.is_decimal(F.col("a")).alias("ok"),
    ).collect()
    for r in out:
        x, y = Fraction(r["a"]), Fraction(r["b"])
        assert r["ok"]
        assert Fraction(r["s"]) == x + y and Fraction(r["m"]) == x * y and Fraction(r["n"]) == x
        assert r["c"] == (x > y) - (x < y)
        if y == 0:
            assert r["q"] is None
        else:
            ctx = decimal.Context(prec=40, rounding=decimal.ROUND_HALF_UP)
            assert decimal.Decimal(r["q"]) == ctx.divide(decimal.Decimal(r["a"]), decimal.Decimal(r["b"]))


@settings(max_examples=3, deadline=None)
@given(st.lists(decimals, min_size=1, max_size=80))
def test_limb_sum_is_exact_in_any_order(spark, values):
    def total(vs):
        df = spark.createDataFrame([(v,) for v in vs], "v string").repartition(3)
        parts = D.with_exact_parts(df, F.col("v"), D.is_decimal(F.col("v")), "p")
        return parts.agg(*D.limb_aggregates("p", "x")).select(D.combine_limbs("x").alias("t")).first()["t"]

    assert Fraction(total(values)) == sum(map(Fraction, values))
    assert total(values) == total(list(reversed(values)))


def test_decimal_shapes(spark):
    cases = {
        "0": True, "-0": False, "-0.00": False, "007": False, "1e5": False, "1.": False, ".5": False, "+1": False,
        "12.50": True, "-3": True, "9" * 100: True, "9" * 101: False, "1\n": False, "": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", D.is_decimal(F.col("s")).alias("d")).collect()}
    assert got == cases


@pytest.mark.parametrize(
    ("value", "places", "expected"),
    [("2.345", 2, "2.35"), ("-2.345", 2, "-2.35"), ("-0.004", 2, "0.00"), ("-0.006", 2, "-0.01"), ("9.995", 2, "10.00")],
)
def test_money_rounds_half_up(spark, value, places, expected):
    row = spark.range(1).select(D.quantize_money(F.lit(value).cast("decimal(20,3)"), places).cast("string").alias("v"))
    assert row.first()["v"] == expected


def test_ratio6_matches_fractions(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-10**12, 10**12), rng.randint(-10**9, 10**9) or 1) for _ in range(200)] + [(1, 3), (-1, 3), (1, 0)]
    df = spark.createDataFrame(rows, "a long, b long")
    for r in df.select("a", "b", D.ratio6(F.col("a"), F.col("b")).alias("r")).collect():
        if r["b"] == 0:
            assert r["r"] is None
            continue
        ctx = decimal.Context(prec=60, rounding=decimal.ROUND_HALF_UP)
        want = ctx.divide(decimal.Decimal(r["a"]), decimal.Decimal(r["b"])).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP)
        assert abs(r["r"] - float(want)) < 1e-9


def test_localized_numbers(spark):
    cases = {
        "1,234.50": ("1234.5", None), "1.234,50": (None, "ambiguous-number"), "١٢٣٤٫٥٠": ("1234.5", None),
        "١٬٢٣٤": ("1234", None), "1,23": (None, "ambiguous-number"), "12 345": ("12345", None), "−5": ("-5", None),
        "5-": (None, "invalid-number"), "1.2.3": (None, "invalid-number"), "$5": (None, "invalid-number"),
        "": (None, "invalid-number"), "-0.00": ("0", None), "007": ("7", None), ".5": ("0.5", None), "1e3": (None, "invalid-number"),
        "⁦42⁩": ("42", None), "1,234,567": ("1234567", None), "5%": (None, "invalid-number"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: (r["value"], r["reason"]) for r in NU.with_localized(df, "s").collect()}
    assert got == cases


def test_percent_inputs(spark):
    cases = {"8": "0.08", "+8%": None, "-5.5%": "-0.055", "30": "0.3", "30.1": None, "-20": "-0.2", "0.05": None, "0": "0", "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["fraction"] for r in NU.with_percent(df, "s").collect()} == cases


def test_domain_ceiling(spark):
    cases = {"0": "10", "1000000": "1100000", "2": "2.2", "1565": "1800", "0.25": "0.28", "90": "99", "95": "110", "0.004": "0.0044", "-0.00": "10", "-5": "5.5", "17": "19",
             "0.000000000000000002": "0.0000000000000000022", "999999999999999999999999999999.99": "1100000000000000000000000000000", "1e-11": "0.000000000011"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    out = df.select("s", domain_ceiling("s").alias("c"))
    assert {r["s"]: r["c"] for r in out.collect()} == cases


def test_text_keys(spark):
    df = spark.createDataFrame([("  Café ",), (" NORTH",), ("Café",), ("a b",)], "s string")
    assert [r[0] for r in df.select(T.fold_key(F.col("s"))).collect()] == ["café", "north", "café", "a b"]
    labels = spark.createDataFrame([("Total (USD)",), ("  ",), ("المنطقة",), ("__x__",)], "s string")
    assert [r[0] for r in labels.select(T.slug(F.col("s"))).collect()] == ["total_usd", "column", "المنطقة", "x"]
    letters = spark.createDataFrame([(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA")], "n int, w string")
    assert all(r["w"] == r["l"] for r in letters.select("w", T.column_letter(F.col("n")).alias("l")).collect())
