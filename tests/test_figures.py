"""Interval sets, figures in any number, proof graphs, radix quantiles and page directories against brute force."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulith.operators import evidence as E
from tabulith.operators import expressions as X
from tabulith.operators import figures as G
from tabulith.operators import proofs as P
from tabulith.operators import quantiles as Q
from tabulith.operators import spans as S
from tabulith.operators.scope import Scope


def compress(rows):
    out = []
    for r in sorted(rows):
        if out and out[-1][1] + 1 == r:
            out[-1][1] = r
        else:
            out.append([r, r])
    return [tuple(x) for x in out]


def test_interval_sets(spark):
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", None):
        for side in "xy":
            for _ in range(25):
                start = rng.choice([0, 65_500, 131_000, 2**32 - 30]) + rng.randrange(80)
                rows.append((key, side, start, start + rng.choice([0, 1, 7, 40])))
    rows.append(("far", "x", 1, 10**12))
    rows.append(("far", "y", 5, 6))
    spans = spark.createDataFrame(rows, "k string, side string, start long, end long")
    x, y = spans.filter("side = 'x'").drop("side"), spans.filter("side = 'y'").drop("side")
    sets = {(k, s): {n for kk, ss, a, b in rows if (kk, ss) == (k, s) for n in range(a, b + 1)} for k in ("a", "b", None) for s in "xy"}
    for op, test in (("union", set.union), ("intersect", set.intersection), ("difference", set.difference)):
        got = S.combine(x, y, ["k"], op).collect()
        for k in ("a", "b", None):
            assert sorted((r["start"], r["end"]) for r in got if r["k"] == k) == compress(test(sets[k, "x"], sets[k, "y"])), (op, k)
    far = S.combine(x, y, ["k"], "difference").filter("k = 'far'").collect()
    assert sorted((r["start"], r["end"]) for r in far) == [(1, 4), (7, 10**12)]
    shared = S.combine(x.filter("k <> 'far'"), y.filter("k = 'b'").drop("k"), ["k"], "intersect", shared=True).collect()
    assert sorted((r["start"], r["end"]) for r in shared if r["k"] == "a") == compress(sets["a", "x"] & sets["b", "y"])


def _messy(seed, n):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["1", "2.50", "-3.125", "n/a", None, "", "9" * 40 + ".5", "-" + "8" * 30, "0.000000000000000000000000001"])
    day = lambda: rng.choice([None, *(f"2026-{m:02}-{d:02}" for m in (1, 2, 3) for d in (1, 9, 28))])
    return [(i * rng.choice([1, 1, 1, 2]) + 2 * i + 2, day(), rng.choice(["N", "S", "E", None, "="]), *[cell() for _ in range(3)]) for i in range(n)]


@pytest.fixture(scope="module")
def messy(spark):
    rows = _messy(9, 400)
    rows = [(i + 2, *r[1:]) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "source_row long, day string, region string, a string, b string, c string").withColumn("date", F.to_date("day"))


def _specs():
    scopes = [Scope(), Scope("2026-01-01", "2026-01-31"), Scope("2026-01-09", "2026-02-09", ("N",)), Scope("2026-02-28", "2026-02-28", ("S", "E", "=")), Scope(regions=("N", "nowhere")), Scope("2026-03-02", "2026-01-01")]
    out = []
    for i, scope in enumerate(scopes):
        for f, mask in (("a", ()), ("b", ("a",)), ("c", ("a", "b"))):
            out.append(G.SumSpec(f"{i}-{f}", f, scope, mask))
    return out


def _decimal(text):
    return text is not None and text not in ("", "n/a")


def _expected(rows, spec):
    s, at = spec.scope, {"a": 3, "b": 4, "c": 5}
    inside = [r for r in rows if (s.start is None or r[1] is not None and s.start <= r[1] <= s.end) and (not s.regions or r[2] in s.regions)]
    good = [r for r in inside if all(_decimal(r[at[f]]) for f in {spec.field, *spec.mask})]
    values = [Decimal(r[at[spec.field]]) for r in good]
    return inside, good, sum(values, Decimal(0)), max([max(0, -v.as_tuple().exponent) for v in values], default=0)


def test_scoped_sums_and_selections(messy):
    rows, frame = messy
    specs = _specs()
    import decimal

    with decimal.localcontext(prec=200):
        sums = {r["metric_id"]: r for r in G.scoped_sums(frame, specs, F.col("date"), F.col("region")).collect()}
        spans = {}
        for r in G.selection_spans(frame, specs, F.col("date"), F.col("region")).collect():
            spans.setdefault(r["selection_id"], []).append((r["start"], r["end"]))
        for spec in specs:
            inside, good, total, scale = _expected(rows, spec)
            got = sums[spec.id]
            assert (Decimal(got["value"]), got["eligible_rows"], got["total_rows"], got["scale"]) == (total, len(good), len(inside), scale), spec
            assert sorted(spans.get(f"{spec.id}-rows", [])) == compress({r[0] for r in good}), spec


def test_many_fields_need_words_of_bits(spark):
    names = [f"f{i:03}" for i in range(130)]
    rows = [tuple("1" if (i * 7 + j) % 5 else "x" for j in range(130)) for i in range(20)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    specs = [G.SumSpec(n, n, Scope(), (names[(j * 31) % 130],)) for j, n in enumerate(names)]
    got = {r["metric_id"]: r["eligible_rows"] for r in G.scoped_sums(frame, specs, None, None).collect()}
    assert got == {n: sum(r[j] == "1" and r[(j * 31) % 130] == "1" for r in rows) for j, n in enumerate(names)}
    assert {r["eligible_rows"] for r in G.scoped_sums(frame.limit(0), specs[:3], None, None).collect()} == {0}
    assert G.scoped_sums(frame, [], None, None).collect() == []


def test_sums_aggregate_once(messy):
    plan = G.scoped_sums(messy[1], _specs() * 30, F.col("date"), F.col("region"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 + 2  # the rows once; the table of scopes and the names


# --- proof graphs ------------------------------------------------------------


def _walk(definitions, leaves, name, active=(), known=None):
    """(value, reason) by recursion, as a reader would work a figure out."""

    def value(e):
        op = e["op"]
        if op == "literal":
            return Decimal(e["value"]), None
        if op == "metric":
            if e["metric_id"] in active + (name,):
                return None, "metric.cycle"
            if e["metric_id"] not in definitions:
                return None, "metric.missing"
            return _walk(definitions, leaves, e["metric_id"], active + (name,))
        if op == "sum":
            return leaves.get((e["selection_id"], e["field"]), (None, "selection.missing"))
        left, right = value(e["left"]), value(e["right"])
        if left[0] is None:
            return left
        if right[0] is None:
            return right
        if op == "divide":
            return (None, "divideByZero") if right[0] == 0 else (left[0] / right[0], None)
        return {"add": left[0] + right[0], "subtract": left[0] - right[0], "multiply": left[0] * right[0]}[op], None

    return value(definitions[name])


def test_proof_graphs(spark):
    rng = random.Random(11)
    definitions = {}
    names = [f"m{i}" for i in range(40)]

    def expression(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            # Mostly earlier figures, now and then a later one, so some cycles arise.
            pick = rng.choice(names[: len(definitions)] or names) if rng.random() < 0.8 else rng.choice([*names, "unknown"])
            return rng.choice([X.metric(pick), X.literal(str(rng.randrange(5))), X.total(rng.choice(["s"] * 9 + ["lost"]), "f")])
        return X.binary(rng.choice(["add", "subtract", "multiply", "divide"]), expression(depth - 1), expression(depth - 1))

    for n in names:
        definitions[n] = expression(2)
    leaves = spark.createDataFrame([("s", "f", 2, "7", None)], "selection_id string, field string, declared long, value string, reason string")
    stated = spark.createDataFrame([(n, f"{n}-p", "defined") for n in names], "metric_id string, provenance_id string, status string")
    got = {r["metric_id"]: r for r in P.evaluate_proofs(stated, P.proof_rows(spark, {f"{n}-p": e for n, e in definitions.items()}), leaves).collect()}
    assert len(got) == len(names)
    reasons = set()
    for n in names:
        value, reason = _walk(definitions, {("s", "f"): (Decimal(7), None)}, n)
        reasons.add(reason)
        assert got[n]["reason"] == reason, n
        if value is not None:
            assert abs(Decimal(got[n]["value"]) - value) <= abs(value) * Decimal("1e-20"), n
    assert reasons >= {None, "metric.cycle", "divideByZero", "selection.missing"}


# --- quantiles ---------------------------------------------------------------


def _type7(data, p):
    h = (len(data) - 1) * Decimal(p)
    j = int(h)
    return data[j] + (h - j) * (data[min(j + 1, len(data) - 1)] - data[j])


def test_quantiles_of_adversarial_groups(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 50)
    rng = random.Random(2)
    groups = {
        "one length": [10**14 + i for i in range(600)],
        "long prefix": [123456789012345000 + rng.randrange(900) for _ in range(700)],
        "all magnitudes": [s * 10**k + i for k in range(16) for s in (-1, 1) for i in range(12)],
        "nested": [10**16 + 10**k + i for k in range(15) for i in range(40)],
        "hot": [77] * 900 + list(range(100)),
        "zeros": [0] * 50 + [-1, 1],
        "single": [5],
        None: [3, 1, 2],
    }
    rows = [(k, Decimal(v) / 100) for k, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "k string, v decimal(20,2)")
    ps = ("0.25", "0.5", "0.999", "0", "1")
    got = {(r["k"], r["p"]): (r["n"], r["quantile"]) for r in Q.quantiles(frame, ["k"], "v", ps).collect()}
    for k, values in groups.items():
        data = sorted(Decimal(v) / 100 for v in values)
        for p in ps:
            assert got[k, p] == (len(data), _type7(data, p)), (k, p)


def test_quantiles_never_order_a_groups_values(spark, tmp_path):
    spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("decimal(12,2)").alias("v")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows, buckets = Q._first(table, ["k"], "v")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    # The only window over the table's own counts runs over buckets, not values.
    plan = buckets._jdf.queryExecution().optimizedPlan().toString()
    assert "_code" in plan and "orderBy" not in plan and buckets.count() < 2 * 39 * 9_000


def test_apportionment_scans(spark, tmp_path):
    """The rows are scanned three times at most, and the written tables a dozen times in all."""
    from tabulith.operators import metrics as M

    spark.range(5_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 17 + 1).alias("w"), F.lit(1_000_003).cast("long").alias("t")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    shares = M.largest_remainder(rows, ["k"], "w", "t", "o")
    plan = shares._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 12
    got = shares.groupBy("k").agg(F.sum("share").alias("s")).collect()
    assert {r["s"] for r in got} == {1_000_003}


# --- page directories --------------------------------------------------------


def test_pages_read_only_their_ranges(spark, tmp_path):
    rng = random.Random(8)
    held = sorted(rng.sample(range(70_000), 30_000))
    spark.createDataFrame([(r, r * 2) for r in held], "id long, v long").repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    wanted = sorted(rng.sample(range(70_000), 40_000))
    numbers = lambda xs: S.to_spans(spark.createDataFrame([(x + 2,) for x in xs], "r long"), "r")
    index = E.selection_index(numbers(wanted), (), numbers(held))
    both = sorted(set(held) & set(wanted))
    for offset, size in ((0, 1), (0, 500), (9_000, 200), (len(both) - 3, 200), (len(both), 5)):
        page = E.evidence_page(rows, index, offset, size, "id", shift=2)
        got = page.collect()
        assert sorted(r["source_row"] for r in got) == [x + 2 for x in both[offset : offset + size]]
        assert all(r["total"] == len(both) and r["v"] == 2 * (r["source_row"] - 2) for r in got)
        assert {r["next_offset"] for r in got} <= {offset + size if offset + size < len(both) else None}
    plan = E.evidence_page(rows, index, 9_000, 200, "id", shift=2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "PushedFilters: [Or(" in plan.replace("PushedFilters: [And(", "PushedFilters: [")
    with pytest.raises(E.PageError):
        E.evidence_page(rows, index, -1, 5)


# --- publishing --------------------------------------------------------------


def test_publish_or_leave_nothing(spark, tmp_path):
    from tabulith.session import cut_lineage, scratch
    from tabulith.sinks import publish as PU
    from tabulith.sinks.tables import StaleBundle
    from tabulith.table import ColumnInfo

    path = str(tmp_path / "out")
    one = lambda r: spark.createDataFrame([("t", r)], "table_id string, revision string")
    names = ("table_id", "revision")
    texts = spark.createDataFrame(
        [(2, "2026-02-28", "007", "1.50", "x"), (3, "2026-02-30", "9", "-0", None), (4, None, "99999999999999999999", "1e3", "y"), (5, "2026-1-1", "3.0", "12345678901234567890.123", "")],
        "source_row long, d string, n string, v string, t string",
    )
    columns = [ColumnInfo("d", "d", 1, "date"), ColumnInfo("n", "n", 2, "integer"), ColumnInfo("v", "v", 3, "decimal"), ColumnInfo("t", "t", 4)]
    typed = PU.typed_clean(texts, columns)
    with pytest.raises(StaleBundle):
        PU.publish({"clean": typed}, path, one("r1"), one("r2"), names)
    assert not (tmp_path / "out").exists()
    with pytest.raises(FileNotFoundError):
        PU.read_published(spark, path, "clean")
    first = PU.publish({"clean": typed, "few": typed.limit(1)}, path, one("r1"), one("r1"), names)
    rows = {r["source_row"]: r for r in PU.read_published(spark, path, "clean").collect()}
    assert str(rows[2]["d"]) == "2026-02-28" and rows[2]["d__text"] is None and rows[2]["n"] is None and rows[2]["n__text"] == "007"
    assert rows[3]["d"] is None and rows[3]["d__text"] == "2026-02-30" and rows[3]["n"] == 9 and rows[3]["v__text"] == "-0"
    assert rows[4]["d__text"] is None and rows[4]["n__text"] == "99999999999999999999" and rows[4]["v__text"] == "1e3"
    assert str(rows[5]["v"]) == "12345678901234567890.123" and rows[5]["n"] == 3 and str(rows[2]["v"]) == "1.500"
    second = PU.publish({"clean": typed.filter("source_row < 4")}, path, one("r1"), one("r1"), names)
    assert PU.read_published(spark, path, "clean").count() == 2 and PU.read_published(spark, path, "few").count() == 1 and first != second
    broken = {"clean": typed, "bad": typed.withColumn("v", F.raise_error(F.lit("no")))}
    with pytest.raises(Exception, match="no"):
        PU.publish(broken, path, one("r1"), one("r1"), names)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([first, second, "manifest"])
    import os
    from urllib.parse import urlparse

    with scratch(spark) as paths:
        cut_lineage(typed).count()
        assert len(paths) == 1 and os.path.isdir(urlparse(paths[0]).path)
    assert not os.path.exists(urlparse(paths[0]).path)


def test_ledger_scans(spark, tmp_path):
    """The sheet is scanned five times: digests, spellings, variants, blanks, cells."""
    from tabulith.operators import ledger as L
    from tabulith.table import sheet_from_table

    spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 5 == 0, "X ").otherwise("x").alias("b")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [id#")
    ledger = L.quality_ledger(sheet_from_table(table, "id", ("a", "b")))
    # Digests and spellings are tables of their own by now; the rest of the plan reads the sheet three times.
    assert scans(ledger) <= 3
    assert ledger.filter("kind = 'duplicate'").count() == 500 - 14 and ledger.filter("kind = 'category'").count() == 400


def test_a_kept_row_meets_the_spans_once(spark, monkeypatch):
    """However many copies it has: 60 copies of row 2 and 1 of row 3 are two rows to look up."""
    rows = spark.createDataFrame([(2, "1"), (3, "2"), (4, "n/a")], "source_row long, a string")
    copies = [(r, 2) for r in range(10, 70)] + [(70, 3), (71, 4)]
    schema = "source_row long, canonical_row long, kind string, status string, field string"
    ledger = spark.createDataFrame([(r, c, "duplicate", "resolved", None) for r, c in copies], schema)
    met, join = [], G.join_spans
    monkeypatch.setattr(G, "join_spans", lambda r, s, row: met.append(r.count()) or join(r, s, row))
    found = G.evidence_of(rows, [G.SumSpec("x", "a", Scope())], None, None, ledger)
    assert {r["row_id"] for r in found.excluded.collect()} == {f"S0:R{r}" for r in range(10, 71)} and found.excluded.count() == 61
    assert met == [3]


def test_blanks_are_trimmed_at_both_ends(spark):
    from tabulith.functions.text import trim_blanks

    texts = ["\t\u00a0 a b\u3000\ufeff", " \u2003\n", "", "a", "\u200b a", None, "\x0b\x0c\r\u1680x\u200a\u2028\u2029\u202f\u205f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trim_blanks(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["a b", "", "", "a", "\u200b a", None, "x"]


@pytest.mark.parametrize("missing", [None, "weekday", "weekend"])
def test_findings_need_the_scheduled_weekdays(spark, tmp_path, missing):
    """One order a day in both months, twice the minutes in the second; a weekday without one withholds that calendar's findings."""
    import datetime

    from tabulith.queries import QUERIES
    from tabulith.queries.registry import CURRENT, PREVIOUS

    first, last = (datetime.date.fromisoformat(d) for d in (PREVIOUS[0], CURRENT[1]))
    days = [first + datetime.timedelta(d) for d in range((last - first).days + 1)]
    gone = {"weekday": next(d for d in days if d.weekday() < 5), "weekend": next(d for d in days if d.weekday() >= 5), None: None}[missing]
    kept = [(i + 1, d) for i, d in enumerate(days) if d != gone]

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    table("region", [(0, "ASIA")], "r_regionkey int, r_name string")
    table("nation", [(0, "JAPAN", 0)], "n_nationkey int, n_name string, n_regionkey int")
    table("customer", [(1, 0)], "c_custkey long, c_nationkey int")
    table("orders", [(k, 1, "F", 10.0, datetime.datetime(d.year, d.month, d.day), "1-URGENT") for k, d in kept], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    table("lineitem", [(k, 100.0, 0.01, 1.0, 2 if d.isoformat() >= CURRENT[0] else 1) for k, d in kept], "l_orderkey long, l_extendedprice double, l_discount double, l_quantity double, l_linenumber int")
    calendars = ["trading"] if missing == "weekday" else ["trading", "weekdays"]
    of = lambda name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).orderBy("calendar").collect()]
    assert of("emphasised_points") == [("chart-downtime-asia", "current", c) for c in calendars]
    claims = ("asia-current-downtime", "asia-downtime-change", "asia-previous-downtime")
    assert sorted((r[1], r[4]) for r in of("evidence_subject")) == sorted((m, c) for m in claims for c in calendars)
    listed = of("headline_metrics")
    assert [sum(r[2] == c for r in listed) for c in ("trading", "weekdays")] == [8, 8]
    for c in ("trading", "weekdays"):
        assert (set(claims) <= {r[0] for r in listed if r[2] == c}) == (c in calendars)
