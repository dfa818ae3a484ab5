"""The published figures of the operations sample, end to end from its CSV."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sample import COPIES, MISSING, MONTHLY, PERIODS, REGIONS, VARIANTS, as_csv, clean_rows, raw_rows, weekdays
from tabulith.functions.dates import to_real_date
from tabulith.functions.decimals import dec_div, dec_sub
from tabulith.operators import evidence, ledger as L, metrics, normalize as N, profile as P, quantiles, scope
from tabulith.operators.scenario import sweep
from tabulith.operators.scope import Scope
from tabulith.operators.spans import to_spans
from tabulith.plans import briefing as B
from tabulith.session import cut_lineage
from tabulith.sources import cells, delimited
from tabulith.table import ColumnInfo

JUNE, MAY = Scope("2026-06-01", "2026-06-30"), Scope("2026-05-01", "2026-05-31")


@pytest.fixture(scope="module")
def table(spark):
    files = spark.createDataFrame([("sample.csv", as_csv(raw_rows()))], "file_id string, text string")
    delimiter = delimited.choose_delimiter(delimited.delimiter_votes(files))
    records = cut_lineage(delimited.read_records(files.join(delimiter, "file_id").select("file_id", "text", "delimiter")))
    landed = delimited.table_records(records, delimited.header_ordinals(records))
    long = cut_lineage(delimited.to_cells(landed))
    headers = P.column_ids(P.read_headers(long.filter("is_header"))).orderBy("source_column").collect()
    columns = [ColumnInfo(h["id"], h["label"], h["source_column"]) for h in headers]
    sheet = cells.to_sheet(long, columns, header_row=1)
    typed = sheet.with_columns(P.proposed_columns(sheet, P.column_profile(sheet)))
    proposals = cut_lineage(L.quality_ledger(typed))
    done = cut_lineage(N.resolve_ledger(proposals, N.approve_actionable(proposals)))
    rows = cut_lineage(N.apply_approvals(typed, done))
    return typed, done, rows


def test_profile(table):
    sheet, _, _ = table
    types = {c.id: (c.type, c.role) for c in sheet.columns}
    assert types["operation_id"] == ("text", "identifier")
    assert types["date"] == ("date", "date")
    assert types["region"] == ("text", "dimension")
    assert types["site"] == ("text", "identifier")
    assert types["revenue"] == ("decimal", "measure")
    assert types["downtime_minutes"] == ("integer", "measure")


def test_ledger(table):
    _, done, _ = table
    found = {r["issue_id"]: r for r in done.collect()}
    expected = (
        {f"quality-category-{i + 2}" for i in VARIANTS}
        | {f"quality-missing-{i + 2}" for i in MISSING}
        | {f"quality-duplicate-{2402 + j}" for j in range(17)}
    )
    assert set(found) == expected
    assert found["quality-duplicate-2411"]["canonical_row"] == COPIES[9] + 2
    assert found["quality-category-19"]["normalized"] == "North"
    assert {r["status"] for r in found.values() if r["kind"] == "missing"} == {"unresolved"}
    summary = L.quality_summary(table[2], done).first().asDict()
    assert summary == {"raw_rows": 2417, "retained_rows": 2400, "issue_count": 29, "resolved": 24, "unresolved": 5}


def test_clean_rows_equal_the_clean_table(table):
    sheet, _, rows = table
    got = [tuple(r) for r in rows.orderBy("source_row").select(*sheet.ids).collect()]
    assert got == [tuple(v or None for v in r.values()) for r in clean_rows()]


def test_reversal_restores_the_raw_spelling(table):
    _, done, rows = table
    back = N.original_values(rows, done, ["region"]).filter(F.col("source_row").isin(*[i + 2 for i in VARIANTS]))
    raw = raw_rows()
    assert {(r["source_row"], r["region"]) for r in back.collect()} == {(i + 2, raw[i]["region"]) for i in VARIANTS}


def test_month_region_totals(table):
    _, _, rows = table
    money = rows.select(
        F.substring("date", 1, 7).alias("month"), "region",
        *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("revenue", "target_revenue", "operating_cost", "order_volume", "downtime_minutes")],
    )
    got = {
        (r["month"], r["region"]): tuple(int(v) for v in r[2:])
        for r in money.groupBy("month", "region").agg(*[F.sum(c) for c in money.columns[2:]]).collect()
    }
    assert got == MONTHLY


def _sums(table, specs):
    rows = table[2]
    out = metrics.scoped_sums(rows, specs, to_real_date(F.col("date")), F.col("region"))
    return {r["metric_id"]: r for r in out.collect()}


def test_scoped_figures(spark, table):
    north_june = Scope(JUNE.start, JUNE.end, ("North",))
    north_may = Scope(MAY.start, MAY.end, ("North",))
    S = metrics.SumSpec
    got = _sums(
        table,
        [
            S("revenue", "revenue", north_june, ("revenue", "target_revenue")),
            S("target", "target_revenue", north_june, ("revenue", "target_revenue")),
            S("may-downtime", "downtime_minutes", north_may), S("june-downtime", "downtime_minutes", north_june),
            S("may-orders", "order_volume", north_may), S("june-orders", "order_volume", north_june),
            S("june-revenue", "revenue", JUNE, ("revenue", "operating_cost")),
            S("june-cost", "operating_cost", JUNE, ("revenue", "operating_cost")),
            S("empty", "revenue", Scope(JUNE.start, JUNE.end, ("Nowhere",))),
            S("scores", "csat_score", Scope()),
        ],
    )
    assert got["revenue"]["value"] == "881000.00" and got["revenue"]["eligible_rows"] == 100
    assert got["june-revenue"]["value"] == "6000000.00" and got["june-cost"]["value"] == "4500000.00"
    assert (got["empty"]["value"], got["empty"]["total_rows"]) == ("0", 0)
    assert (got["scores"]["eligible_rows"], got["scores"]["total_rows"]) == (2395, 2400)
    pairs = spark.createDataFrame(
        [
            ("gap", got["revenue"]["value"], got["target"]["value"]),
            ("downtime", got["june-downtime"]["value"], got["may-downtime"]["value"]),
            ("orders", got["june-orders"]["value"], got["may-orders"]["value"]),
        ],
        "k string, a string, b string",
    )
    ratios = {r["k"]: r["v"] for r in pairs.select("k", dec_div(dec_sub("a", "b"), "b").alias("v")).collect()}
    assert ratios == {"gap": "-0.119", "downtime": "0.3107202680067001675041876046901172529313", "orders": "0.08"}


def test_keeping_a_copy_changes_the_base(table):
    sheet, done, rows = table
    kept = done.filter("issue_id <> 'quality-duplicate-2411'")
    more = N.apply_approvals(sheet, kept)
    spec = [metrics.SumSpec("d", "downtime_minutes", Scope(MAY.start, MAY.end, ("North",)))]
    value = metrics.scoped_sums(more, spec, to_real_date(F.col("date")), F.col("region")).first()["value"]
    copy = int(raw_rows()[COPIES[9]]["downtime_minutes"])
    assert int(value) == 1194 + copy


@pytest.mark.parametrize(("period", "span"), [("2026-05", (1202, 1301)), ("2026-06", (1802, 1901))])
def test_spans_of_north(table, period, span):
    chosen = table[2].filter((F.col("region") == "North") & F.col("date").startswith(period))
    assert [(r["start"], r["end"]) for r in to_spans(chosen, "source_row").collect()] == [span]


def test_excluded_copy_is_named(table):
    _, done, rows = table
    may_north = rows.filter((F.col("region") == "North") & F.col("date").startswith("2026-05"))
    named = evidence.excluded_contributors(done, may_north.select("source_row")).collect()
    assert [r["source_row"] for r in named] == [2411]


def test_calendar_is_complete(spark, table):
    calendar = spark.createDataFrame([(d, p) for p in PERIODS for d in weekdays(p)], "date string, period string")
    got = scope.period_completeness(table[2], calendar).collect()
    assert len(got) == 4 and all(r["complete"] and r["scheduled"] == 20 for r in got)


def test_outlier_is_the_planted_row(table):
    june = table[2].filter(F.col("date").startswith("2026-06")).select(
        "source_row", "region", F.col("downtime_minutes").cast("decimal(12,0)").alias("v")
    )
    flagged = quantiles.outliers(june, ["region"], "v", "source_row", 30, 3).collect()
    assert [(r["source_row"], int(r["v"])) for r in flagged] == [(2044, 210)]


def _fact(table):
    c = lambda name: F.round(F.col(name).cast("decimal(18,2)") * 100, 0).cast("long")
    return table[2].select(
        to_real_date(F.col("date")).alias("date"), "region", c("revenue").alias("revenue"), c("target_revenue").alias("target"),
        c("operating_cost").alias("cost"), F.col("order_volume").cast("long").alias("orders"),
        F.col("downtime_minutes").cast("long").alias("downtime"), F.lit(1).cast("long").alias("rows"),
    )


def test_findings(table):
    whole = B.brief(_fact(table), JUNE, MAY, table[1])
    top = B.top_findings(whole.findings).collect()
    # East moves by 28 % too, but by less than a twentieth of the prior scope.
    assert [f["finding_id"] for f in top] == ["finding-target-north", "finding-downtime-north", "finding-quality"]
    assert top[0]["magnitude"] == 0.119
    values = {m["metric_id"]: m["value"] for m in whole.metrics.collect()}
    assert values["north-target-gap"] == "-0.119"
    assert values["all-contribution"] == "1500000.00" and values["all-margin"] == "0.25"
    assert values["north-downtime-change"] == "0.3107202680067001675041876046901172529313"


def test_scenario(table):
    base = _fact(table).filter(F.col("date") >= "2026-06-01").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"))
    run = sweep(base, ["0.08", "0"]).orderBy(F.col("cost_change").desc()).collect()
    assert (run[0]["contribution"], run[0]["margin"], run[0]["margin_delta_pp"]) == (114_000_000, 0.19, -6.0)
    assert (run[1]["margin"], run[1]["margin_delta_pp"]) == (0.25, 0.0)


def test_trends_need_four_strict_months(table):
    monthly = _fact(table).groupBy(F.trunc("date", "month").alias("month_start"), "region").agg(
        F.sum("revenue").alias("revenue"), F.sum("rows").alias("rows")
    ).withColumn("complete", F.lit(True))
    got = {r["region"]: r["direction"] for r in metrics.monotonic_trend(monthly, ["region"], "revenue", 4).collect()}
    expected = {}
    for region in REGIONS:
        v = [MONTHLY[(p, region)][0] for p in PERIODS]
        if all(a < b for a, b in zip(v, v[1:])):
            expected[region] = "up"
        if all(a > b for a, b in zip(v, v[1:])):
            expected[region] = "down"
    assert got == expected


def test_revision_tracks_content_and_approvals(table):
    sheet, done, rows = table
    ids = done.filter("status = 'resolved'").select("issue_id")
    of = lambda r, a: N.revision_hash(r, sheet.columns, a, "h").first()["revision"]
    base = of(rows, ids)
    assert base == of(rows.repartition(5), ids.repartition(3))
    assert base != of(rows, ids.filter("issue_id <> 'quality-category-19'"))
    changed = F.when(F.col("source_row") == 900, "x").otherwise(F.col("site"))
    assert base != of(rows.withColumn("site", changed), ids)
