"""Awkward delimited files: what lands, what is refused, what is only flagged."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabulith.functions import decimals as DC
from tabulith.functions import text as TX
from tabulith.functions.dates import to_real_date
from tabulith.operators import ledger as L
from tabulith.operators import scenario as SC
from tabulith.operators import metrics, normalize as N, profile as P
from tabulith.operators.scope import Scope
from tabulith.policy import Limits
from tabulith.session import cut_lineage
from tabulith.sources import cells as CE
from tabulith.sources import delimited as D
from tabulith.sources import landing as LA
from tabulith.table import ColumnInfo

FILES = {
    "quoted": 'id,note\n1,"two\nlines, one field"\n\n2,"say ""hi"""\n',
    "semicolon": "a;b\n1;2\n3;4\n",
    "ambiguous": "a,b;c\n1,2;3\n",
    "single": "only\none\ncolumn\n",
    "title": "Quarterly report\nid,region,amount\n1,North,2\n2,South,3\n",
    "ragged": "a,b,c\n1,2\n3,4,5\n",
    "crlf": "a,b\r\n1,2\r\n",
    "zeros": "id,label\n007,x\n010,y\n",
    "blank-headers": "id,, ,amount\n1,2,3,4\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "file_id string, text string")


def test_delimiters(files):
    got = {r["file_id"]: (r["delimiter"], r["problem"]) for r in D.choose_delimiter(D.delimiter_votes(files)).collect()}
    assert got["semicolon"] == (";", None)
    assert got["ambiguous"] == (None, "csv.ambiguous-delimiter")
    assert got["single"] == (",", None) and got["title"] == (",", None) and got["quoted"] == (",", None)


def test_records_keep_physical_lines(files):
    got = D.read_records(files.filter("file_id = 'quoted'"), ",").orderBy("ordinal").collect()
    assert [(r["start_line"], r["end_line"], r["fields"]) for r in got] == [
        (1, 1, ["id", "note"]), (2, 3, ["1", "two\nlines, one field"]), (5, 5, ["2", 'say "hi"']),
    ]


def test_large_reader_agrees_with_the_file_reader(spark, files, tmp_path):
    chosen = ["quoted", "ragged", "title", "zeros"]
    for name in chosen:
        (tmp_path / f"{name}.csv").write_text(FILES[name])
    large = D.read_large(D.numbered_lines(spark, str(tmp_path)), ",")
    name = F.regexp_extract("file_id", r"([a-z-]+)\.csv$", 1).alias("f")
    got = sorted((r["f"], r["ordinal"], r["start_line"], r["end_line"], r["fields"]) for r in large.select(name, "*").collect())
    small = D.read_records(files.filter(F.col("file_id").isin(*chosen)), ",")
    want = sorted((r["file_id"], r["ordinal"], r["start_line"], r["end_line"], r["fields"]) for r in small.collect())
    assert got == want


def test_large_reader_reads_its_text_twice(spark, tmp_path, monkeypatch):
    """Once for the lines and once for the splits, however many totals follow."""
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n\n2,plain\n')
    plans, cut = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = D.read_large(D.numbered_lines(spark, str(tmp_path)), ",").orderBy("ordinal").collect()
    assert [(r["start_line"], r["end_line"], r["fields"]) for r in got] == [(1, 1, ["id", "note"]), (2, 3, ["1", "two\nlines"]), (5, 5, ["2", "plain"])]
    assert sum(p.count("FileScan text") for p in plans) <= 2


NASTY = {
    "stray": 'id,size,note\n1,5" pipe,ok\n2,b,ok\n3,c,ok\n4,d,ok\n',
    "crlf": 'a,b\r\n"x\r\ny",1\r\n"q ""z"" ",2\r\n',
    "after": 'a,b\n"x"y"z,1\n"p",""\n"",x"\n',
    "open": 'a,b\n1,"never closed\n2,x\n',
    "openend": 'a,b\n1,"never closed\n2,x',
    "bare": "a,b\n1,2",
    "returns": 'a,b\r1,"x\ry"\r\r2,z\r',
    "mixed": 'a,b\n\n"1\n\n2",3\r\n , \nq"\n"r,s""\n",t\n',
    "swaps": 'a,b\n"1,\n",2\n","\n"\n","\n3,4\n',
}


def test_large_reader_loses_nothing(spark, tmp_path):
    rng = random.Random(6)
    texts = dict(NASTY, **{f"r{i}": "".join(rng.choice(['"', '""', ",", "\n", "\r\n", "\r", "a", " b"]) for _ in range(60)) for i in range(40)})
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    large = D.read_large(D.numbered_lines(spark, str(tmp_path)), ",")
    name = F.regexp_extract("file_id", r"([a-z0-9]+)\.csv$", 1).alias("f")
    got = sorted((r["f"], r["ordinal"], r["start_line"], r["end_line"], r["fields"]) for r in large.select(name, "*").collect())
    small = D.read_records(spark.createDataFrame(list(texts.items()), "file_id string, text string"), ",")
    assert got == sorted((r["file_id"], r["ordinal"], r["start_line"], r["end_line"], r["fields"]) for r in small.collect())


def test_an_unclosed_quote_is_never_gathered(spark, tmp_path):
    """The rest of the file is one field: its pieces are its lines, and its record is told, not built."""
    lines = ["a,b", '1,"two', 'lines",x', '2,"never closed', *[f'{i},"" {i}' for i in range(5_000)]]
    text = "\n".join(lines) + "\n"
    (tmp_path / "open.csv").write_text(text)
    numbered = cut_lineage(D.numbered_lines(spark, str(tmp_path)))
    whole = [r["fields"] for r in D.read_records(spark.createDataFrame([("open", text)], "file_id string, text string"), ",").orderBy("ordinal").collect()]
    pieces = D.field_pieces(numbered, ",").collect()
    built = {}
    for r in sorted(pieces, key=lambda r: (r["record"], r["field"], r["line"])):
        built.setdefault(r["record"], {}).setdefault(r["field"], []).append(r["text"])
    assert [["".join(parts) for _, parts in sorted(f.items())] for _, f in sorted(built.items())] == whole
    assert max(len(r["text"]) for r in pieces) < 30
    got = D.read_large(numbered, ",", max_bytes=1_000).orderBy("ordinal").collect()
    assert [(r["start_line"], r["end_line"], r["fields"], r["oversized"]) for r in got] == [
        (1, 1, ["a", "b"], False), (2, 3, ["1", "two\nlines", "x"], False), (4, 5_004, None, True),
    ]


def test_digits_are_not_rounded(spark):
    texts = ["0.0010000000000000000001", "0.001", "1234567890123456789012345", "0.3000000000000000000001", "0.3", "-0.3", "0.30000", "1e3", "0.0005"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    milli = {r.s: r.m for r in df.select("s", DC.is_multiple_of(F.col("s"), "0.001").alias("m")).collect()}
    assert milli == {t: t not in ("0.0010000000000000000001", "0.3000000000000000000001", "1e3", "0.0005") for t in texts}
    ones = {r.s: r.m for r in df.select("s", DC.is_multiple_of(F.col("s"), "7").alias("m")).collect()}
    assert ones["1234567890123456789012345"] == (1234567890123456789012345 % 7 == 0)
    problems = {r.s: r.p for r in df.select("s", SC.change_problem(F.col("s")).alias("p")).collect()}
    assert problems["0.3000000000000000000001"] == "out-of-range" and problems["0.3"] is None and problems["0.0010000000000000000001"] == "off-step"


def test_letters_beyond_three(spark):
    def letters(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 10**12, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert {r.n: r.l for r in df.select("n", TX.column_letter(F.col("n")).alias("l")).collect()} == {n: letters(n) for n in numbers}


def test_header_cells_and_warnings(files):
    r = cut_lineage(D.read_records(files, ","))
    heads = {x["file_id"]: x["header"] for x in D.header_ordinals(r).collect()}
    assert heads["title"] == 2 and heads["ragged"] == 1
    warn = {(x["file_id"], x["warning"].rsplit(".")[-1]) for x in D.ingest_warnings(r).collect()}
    assert {("ragged", "csv-ragged-rows"), ("quoted", "csv-blank-records-skipped")} <= warn
    assert not any(f == "crlf" for f, _ in warn)
    explicit = {x["file_id"]: x["problem"] for x in D.explicit_header(r, F.lit(3)).collect()}
    assert explicit["quoted"] == "csv.header-row-inside-record"
    cells = cut_lineage(D.to_cells(D.table_records(r, D.header_ordinals(r))))
    blank = cells.filter("file_id = 'blank-headers' and is_header").orderBy("column")
    labels = P.column_ids(P.read_headers(blank)).orderBy("source_column").collect()
    assert [(x["label"], x["id"]) for x in labels] == [("id", "id"), ("Column B", "column_b"), ("Column C", "column_c"), ("amount", "amount")]
    issues = L.header_issues(P.column_ids(P.read_headers(blank)), 1).collect()
    assert {i["issue_id"] for i in issues} == {"quality-header-2", "quality-header-3"}
    assert [x["raw"] for x in cells.filter("file_id = 'zeros' and row = 2 and column = 1").collect()] == ["007"]


def test_landing_quarantine(spark):
    rows = [
        ("zip", bytearray(b"PK\x03\x04rest")), ("ole", bytearray(bytes.fromhex("d0cf11e0a1b11ae1") + b"x")),
        ("latin", bytearray("caf\xe9".encode("latin-1"))), ("empty", bytearray(b" \r\n")), ("bom", bytearray(b"\xef\xbb\xbfa,b\n")),
        ("big", bytearray(b"a" * 200)),
    ]
    landed = spark.createDataFrame(rows, "file_id string, content binary")
    got = {r["file_id"]: (r["text"], r["problem"]) for r in LA.decode(landed, Limits(input_bytes=100)).collect()}
    assert got == {
        "zip": (None, "cells-required"), "ole": (None, "unsupported.ole2-container"), "latin": (None, "csv.invalid-utf8"),
        "empty": (None, "csv.empty"), "bom": ("a,b\n", None), "big": (None, "limit.input-bytes"),
    }


EDGE = (
    "id,date,region,revenue,note\n"
    "1,2026-06-01,North,1000000000000001234567890123456.78,=SUM(A1:A2)\n"
    "2,2026-06-02,north ,0,zero\n"
    "3,2026-06-03,South,-5.5,negative\n"
    "4,06/04/2026,South,1,slash\n"
    "5,2026-02-30,South,2,impossible\n"
    "6,2026-06-05,المنطقة,١٢,digits\n"
    "7,2026-06-06,South,,missing\n"
    "8,2026-06-07,South,abc,word\n"
    "1,2026-06-01,North,1000000000000001234567890123456.78,=SUM(A1:A2)\n"
)


def test_edge_pipeline(spark):
    files = spark.createDataFrame([("edge", EDGE)], "file_id string, text string")
    r = D.read_records(files, ",")
    cells = cut_lineage(D.to_cells(D.table_records(r, D.header_ordinals(r))))
    columns = [
        ColumnInfo("id", "id", 1, "identifier", "identifier"), ColumnInfo("date", "date", 2, "date", "date"),
        ColumnInfo("region", "region", 3, "text", "dimension"),
        ColumnInfo("revenue", "revenue", 4, "mixed", "measure", additive=True, confirmed=True), ColumnInfo("note", "note", 5),
    ]
    sheet = CE.to_sheet(cells, columns, 1)
    proposals = cut_lineage(L.quality_ledger(sheet))
    kinds = sorted((i["kind"], i["source_row"]) for i in proposals.collect())
    assert kinds == [
        ("ambiguous-date", 5), ("category", 3), ("duplicate", 10), ("malformed", 7), ("malformed", 9), ("missing", 8),
        ("precision", 2), ("precision", 10),
    ]
    approved = proposals.filter("kind in ('duplicate', 'category')").select("issue_id")
    rows = N.apply_approvals(sheet, N.resolve_ledger(proposals, approved))
    got = {x["source_row"]: x for x in rows.collect()}
    assert len(got) == 8 and got[3]["region"] == "North" and got[2]["note"] == "=SUM(A1:A2)" and got[8]["revenue"] is None
    june = Scope("2026-06-01", "2026-06-30")
    total = metrics.scoped_sums(rows, [metrics.SumSpec("r", "revenue", june)], to_real_date(F.col("date")), F.col("region")).first()
    # Slash and impossible dates are outside any period; text and missing cells are not eligible.
    assert (total["value"], total["eligible_rows"], total["total_rows"]) == ("1000000000000001234567890123451.28", 3, 6)
    unknown = spark.createDataFrame([("quality-category-3",), ("quality-category-99",)], "issue_id string")
    assert [x["issue_id"] for x in N.unknown_approvals(proposals, unknown).collect()] == ["quality-category-99"]


def test_duplicate_headers_stay_apart(spark):
    files = spark.createDataFrame([("d", "date,region,revenue,revenue\n2026-06-01,N,100,150\n2026-06-02,N,200.00,200\n")], "file_id string, text string")
    r = D.read_records(files, ",")
    cells = cut_lineage(D.to_cells(D.table_records(r, D.header_ordinals(r))))
    heads = P.column_ids(P.read_headers(cells.filter("is_header"))).orderBy("source_column").collect()
    assert [h["id"] for h in heads] == ["date", "region", "revenue", "revenue__2"]
    sheet = CE.to_sheet(cells, [ColumnInfo(h["id"], h["label"], h["source_column"]) for h in heads], 1)
    specs = [metrics.SumSpec(c, c, Scope()) for c in ("revenue", "revenue__2")]
    got = {x["metric_id"]: x["value"] for x in metrics.scoped_sums(sheet.rows, specs, None, None).collect()}
    assert got == {"revenue": "300.00", "revenue__2": "350"}


def test_plain_numbers(spark):
    cases = {1e21: "1000000000000000000000", 1.5e-7: "0.00000015", -0.0: "0", 12.0: "12", 0.1: "0.1", 2.905e21: "2905000000000000000000", -3.25: "-3.25"}
    df = spark.createDataFrame([(v,) for v in cases], "n double")
    got = [r["t"] for r in CE.with_plain_number(df, "n", "t").collect()]
    assert got == list(cases.values())
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "n double")
    assert [r["t"] for r in CE.with_plain_number(odd, "n", "t").collect()] == [None, None]


def test_type_votes(spark):
    columns = {
        "whole": ["1"] * 95 + ["x"] * 5, "loose": ["1"] * 94 + ["x"] * 6, "half": ["1"] * 50 + ["x"] * 50,
        "dates": ["2026-02-28"] * 98 + ["2026-02-30"] * 2, "few_dates": ["2026-02-28"] * 97 + ["x"] * 3,
        "flags": ["Yes", "no", "TRUE", "لا"] * 25, "padded": ["1"] * 96 + ["007"] * 4, "points": ["1"] * 99 + ["1.5"], "site": ["1"] * 100,
    }
    rows = [(i, *[v[i] for v in columns.values()]) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} string" for c in columns))
    from tabulith.table import sheet_from_table

    sheet = sheet_from_table(df, "k", tuple(columns))
    full = {r["id"]: (r["type"], r["role"]) for r in P.column_profile(sheet).collect()}
    assert full == {
        "whole": ("integer", "measure"), "loose": ("mixed", "unknown"), "half": ("text", "dimension"), "dates": ("date", "date"),
        "few_dates": ("text", "dimension"), "flags": ("boolean", "unknown"), "padded": ("identifier", "identifier"),
        "points": ("decimal", "measure"), "site": ("integer", "identifier"),
    }
    sampled = {r["id"]: (r["type"], r["role"]) for r in P.column_profile(sheet, sample=2_000).collect()}
    assert sampled == full
