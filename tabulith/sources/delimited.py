"""Delimited text as records with physical line numbers, then as cells."""

from __future__ import annotations

import csv
import io
import itertools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import starts_like_formula
from tabulith.operators.ordinals import running_total
from tabulith.policy import POLICY
from tabulith.session import cut_lineage

# Delimiters that may be detected, in order.
DELIMITERS = (",", "\t", ";")


def _records(text: str, delimiter: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start_line, end_line, fields) of every record that is not blank."""
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    before = 0
    for fields in reader:
        start, before = before + 1, reader.line_num
        if "".join(fields).strip():
            yield start, before, fields


def spread_files(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Hash files over ``parts`` tasks; without it they are left where they lie."""
    return files.repartition(parts, "file_id") if parts else files


RECORD_BATCH = 20_000
#: Bytes of a record that the reader of split files puts together.
RECORD_BYTES = 64 << 20
RECORD_SCHEMA = "file_id string, ordinal long, start_line long, end_line long, fields array<string>"
_RECORD_ARROW = pa.schema(
    [("file_id", pa.string()), ("ordinal", pa.int64()), ("start_line", pa.int64()), ("end_line", pa.int64()),
     ("fields", pa.list_(pa.string()))]
)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Gather tuples into Arrow batches of bounded size."""
    while chunk := list(itertools.islice(rows, RECORD_BATCH)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, type=field.type) for column, field in zip(zip(*chunk), schema)], schema=schema
        )


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: only one text is held as a Python string."""
    for batch in batches:
        names, columns, texts = batch.schema.names, batch.columns, batch.column("text")
        for i in range(batch.num_rows):
            if texts[i].is_valid:
                yield {name: column[i].as_py() for name, column in zip(names, columns)}


def read_records(files: DataFrame, delimiter: str | None = None, parts: int | None = None) -> DataFrame:
    """(file_id, ordinal, start_line, end_line, fields) for files of (file_id, text).

    A record spans as many physical lines as its quoted newlines need; blank lines
    are skipped but counted. A ``delimiter`` column, when present, wins over the
    argument. Files are independent, so reading needs no grouping; a file too
    large for one task goes through ``read_large``.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (f["file_id"], i, start, end, fields)
            for f in _files(batches)
            for i, (start, end, fields) in enumerate(_records(f["text"], f.get("delimiter") or delimiter or ","), 1)
        )
        return _batches(rows, _RECORD_ARROW)

    return spread_files(files, parts).mapInArrow(parse, RECORD_SCHEMA)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line, value, ending) of splittable text files of any size.

    Spark reads the splits in parallel; a line's number is its position in its
    split plus the line counts of the file's earlier splits. A line ends with a line
    feed, a carriage return or both; ``value`` keeps the carriage return and
    ``ending`` is the line feed, so nothing of the file is lost.
    """
    fed = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("_size"),
        (F.octet_length("value") + 1).cast("long").alias("_bytes"), F.when(F.contains("value", F.lit("\r")), F.split("value", r"(?<=\r)(?!\z)")).otherwise(F.array("value")).alias("_parts"),
    )
    lines = fed.select("file_id", "split", "_size", "_bytes", F.size("_parts").alias("_of"), F.posexplode("_parts").alias("_at", "value")).select(
        "file_id", "split", "value", "_size", F.when(F.col("_at") == 0, F.col("_bytes")).otherwise(0).alias("_bytes"),
        (F.col("_at") == F.col("_of") - 1).alias("_fed"), F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file_id", "split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_bytes"), F.max("_size").alias("_size"))
    # One row per split of a file, a few thousand per terabyte.
    earlier = W.partitionBy("file_id").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # A file without a final line feed is one byte shorter than its lines (a byte order mark is not read: three more).
    beyond = F.sum("_bytes").over(W.partitionBy("file_id")) - F.col("_size")
    splits = splits.withColumn("_unfed", F.when(beyond.isin(1, -2), F.sum("_n").over(W.partitionBy("file_id")))).drop("_n", "_bytes", "_size")
    joined = lines.drop("_bytes", "_size").join(splits, ["file_id", "split"]).withColumn("line", F.col("_before") + F.col("_id") - F.col("_first") + 1)
    fed_at = F.col("_fed") & ~F.coalesce(F.col("line") == F.col("_unfed"), F.lit(False))
    return joined.select("file_id", "line", "value", F.when(fed_at, "\n").otherwise("").alias("ending"))


def ends_quoted(value: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line leaves a quoted field open, entered at a record's start and entered inside one.

    A quote opens a field only as its first character; after a closing quote the rest
    up to the delimiter is plain text, quotes included.
    """
    d = re.escape(delimiter)
    inside = '(?:[^"]|"")*+'
    field = f'(?:"{inside}"(?!")[^{d}]*+|[^"{d}][^{d}]*+|)'
    opened = f'"{inside}\\z'
    # Most lines hold no quote: they open nothing and close nothing.
    has_quote = F.contains(value, F.lit('"'))
    from_start = has_quote & value.rlike(f"^(?:{field}{d})*+{opened}")
    from_quoted = ~has_quote | value.rlike(f'^{inside}(?:\\z|"(?!")[^{d}]*+{d}(?:{field}{d})*+{opened})')
    return from_start, from_quoted


PIECES = "file_id string, record long, line long, piece int, text string, closed int"
_PIECE_ARROW = pa.schema(
    [("file_id", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("closed", pa.int32())]
)


def _stated_lines(lines: DataFrame, delimiter: str) -> DataFrame:
    """Lines with the number of their record and whether they start inside a quoted field.

    Each line is a step of a two-state automaton (at a record's start, or inside a
    quoted field). A line either forces a state or leaves it or swaps it, so the state
    before a line is what the last forcing line left, turned by the swaps since; both
    are running totals, taken block by block.
    """
    from_start, from_quoted = ends_quoted(F.col("value"), delimiter)
    told = lines.select("file_id", "line", F.concat("value", "ending").alias("text"), from_start.alias("_a"), from_quoted.alias("_b"))
    # Written once: the text is read and matched in one scan, and the totals move flags only.
    told = cut_lineage(told)
    steps = told.select("file_id", "line", "_a", (F.col("_a") == F.col("_b")).cast("long").alias("_forces"), (F.col("_a") & ~F.col("_b")).cast("long").alias("_swaps"))
    swapped = cut_lineage(running_total(steps, "line", F.col("_swaps"), "_swapped", ["file_id"]))
    forced = cut_lineage(running_total(swapped, "line", F.col("_forces"), "_forced", ["file_id"]))
    own = forced.withColumn("_last", F.col("_forced") - F.col("_forces"))
    # What the last forcing line before this one left, and the swaps counted by then.
    left = forced.filter("_forces = 1").select("file_id", F.col("_forced").alias("_last"), F.col("_a").cast("long").alias("_state"), F.col("_swapped").alias("_until"))
    first = own.filter("_last = 0").select("*", F.lit(0).cast("long").alias("_state"), F.lit(0).cast("long").alias("_until"))
    rest = own.filter("_last > 0").join(left, ["file_id", "_last"]).select(*first.columns)
    before = F.pmod(F.col("_state") + F.col("_swapped") - F.col("_swaps") - F.col("_until"), F.lit(2))
    opening = cut_lineage(first.unionByName(rest).select("file_id", "line", (before == 0).cast("long").alias("_opens")))
    numbered = running_total(opening, "line", F.col("_opens"), "record", ["file_id"])
    return told.select("file_id", "line", "text").join(numbered, ["file_id", "line"])


def _cut_into_pieces(delimiter: str):
    """One line at a time: the pieces of fields it holds, and how many fields end before its last piece."""

    def pieces(text: str, inside: bool) -> list[str]:
        if '"' not in text:  # what the reader below would give
            body = text.rstrip("\r\n")
            return [text] if inside else body.split(delimiter) if body else []
        return next(csv.reader([('"' + text) if inside else text], delimiter=delimiter), [])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        csv.field_size_limit(sys.maxsize)
        for f in _files(batches):
            found = pieces(f["text"], not f["_opens"])
            for i, text in enumerate(found):
                yield f["file_id"], f["record"], f["line"], i, text, len(found) - 1 if i == 0 else 0
            if not found:
                yield f["file_id"], f["record"], f["line"], 0, None, 0

    return lambda batches: _batches(rows(batches), _PIECE_ARROW)


def field_pieces(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file_id, record, field, line, text): what each line of numbered text adds to a field.

    The pieces of a field, in the order of their lines, are its value. A task holds one
    line; no record or field is ever gathered, so a quote that is never closed costs no
    more than its lines. ``field`` counts from 0 in its record: it is the number of
    fields that ended in the record's earlier lines, a running total less its value
    where the record opens. A blank line gives one null piece.
    """
    cut = cut_lineage(_stated_lines(lines, delimiter).mapInArrow(_cut_into_pieces(delimiter), PIECES))
    per_line = cut.filter("piece = 0").select("file_id", "record", "line", "closed")
    ended = cut_lineage(running_total(per_line, "line", F.col("closed").cast("long"), "_ended", ["file_id"]).withColumn("_ended", F.col("_ended") - F.col("closed")))
    opened = ended.groupBy("file_id", "record").agg(F.min("_ended").alias("_from"))
    based = ended.join(opened, ["file_id", "record"]).select("file_id", "line", (F.col("_ended") - F.col("_from")).alias("_base"))
    return cut.join(based, ["file_id", "line"]).select("file_id", "record", (F.col("_base") + F.col("piece")).cast("int").alias("field"), "line", "text")


def read_large(lines: DataFrame, delimiter: str, max_bytes: int = RECORD_BYTES) -> DataFrame:
    """Records of numbered lines: the form of ``read_records`` for huge files, with the same result.

    Fields are put together from their pieces, records from their fields. A record of
    more than ``max_bytes`` (what an unclosed quote makes of the rest of its file) is
    never gathered: it has its place and lines, null for ``fields`` and ``oversized``;
    its pieces stay readable through ``field_pieces``.
    """
    pieces = cut_lineage(field_pieces(lines, delimiter))
    records = pieces.groupBy("file_id", "record").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("_bytes"),
        # What counts as blank is what Python strips.
        F.bool_or(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")).alias("_there"),
    )
    there = cut_lineage(records.filter("_there"))
    kept = cut_lineage(running_total(there, "start_line", F.lit(1).cast("long"), "ordinal", ["file_id"]))
    fits = kept.filter(F.col("_bytes") <= max_bytes).select("file_id", "record")
    fields = pieces.join(fits, ["file_id", "record"]).groupBy("file_id", "record", "field").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("_p"))
    value = F.array_join(F.transform("_p", lambda x: x["text"]), "")
    whole = fields.select("file_id", "record", "field", value.alias("text")).groupBy("file_id", "record").agg(F.sort_array(F.collect_list(F.struct("field", "text"))).alias("_f"))
    whole = whole.select("file_id", "record", F.transform("_f", lambda x: x["text"]).alias("fields"))
    return kept.join(whole, ["file_id", "record"], "left").select("file_id", "ordinal", "start_line", "end_line", "fields", (F.col("_bytes") > max_bytes).alias("oversized"))


# --- votes -----------------------------------------------------------------


def delimiter_votes(files: DataFrame, sample_chars: int | None = None, parts: int | None = None) -> DataFrame:
    """(file_id, delimiter, position, records, min_width, max_width) per candidate.

    The whole file votes; ``sample_chars`` (``POLICY.delimiter_sample_chars``) lets only its head vote.
    """

    schema = pa.schema(
        [("file_id", pa.string()), ("delimiter", pa.string()), ("position", pa.int32()), ("records", pa.int64()),
         ("min_width", pa.int64()), ("max_width", pa.int64())]
    )

    def votes(files_: Iterator[dict]) -> Iterator[tuple]:
        for f in files_:
            head = f["text"][:sample_chars] if sample_chars else f["text"]
            for position, d in enumerate(DELIMITERS):
                n, low, high = 0, sys.maxsize, 0
                for _, _, fields in _records(head, d):
                    n, low, high = n + 1, min(low, len(fields)), max(high, len(fields))
                if n:
                    yield f["file_id"], d, position, n, low, high

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(votes(_files(batches)), schema)

    return spread_files(files, parts).mapInArrow(
        vote, "file_id string, delimiter string, position int, records long, min_width long, max_width long"
    )


def choose_delimiter(votes: DataFrame) -> DataFrame:
    """(file_id, delimiter, problem): the one consistent candidate, else the one partial.

    Two consistent or two partial candidates are ambiguous and never guessed.
    """
    consistent = (F.col("min_width") == F.col("max_width")) & (F.col("min_width") > 1)
    partial = ~consistent & (F.col("max_width") > 1)
    per_file = votes.groupBy("file_id").agg(
        F.count_if(consistent).alias("c"),
        F.count_if(partial).alias("p"),
        F.min(F.when(consistent, F.col("delimiter"))).alias("cd"),
        F.min(F.when(partial, F.col("delimiter"))).alias("pd"),
    )
    ambiguous = (F.col("c") > 1) | (F.col("p") > 1)
    chosen = F.coalesce("cd", "pd", F.lit(","))
    return per_file.select(
        "file_id",
        F.when(~ambiguous, chosen).alias("delimiter"),
        F.when(ambiguous, F.lit("csv.ambiguous-delimiter")).alias("problem"),
    )


def header_ordinals(records: DataFrame, preview: int = POLICY.preview_records) -> DataFrame:
    """(file_id, header, width): first record of the modal width of the first records.

    The width seen first wins a tie.
    """
    head = records.filter(F.col("ordinal") <= preview)
    widths = head.groupBy("file_id", F.size("fields").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")
    )
    best = widths.groupBy("file_id").agg(F.max(F.struct("n", (-F.col("first")).alias("_f"), "width")).alias("b"))
    return best.select("file_id", (-F.col("b._f")).alias("header"), F.col("b.width").alias("width"))


def explicit_header(records: DataFrame, line: Column) -> DataFrame:
    """(file_id, header, problem) for a header line chosen by the user."""
    starts = F.max(F.when(F.col("start_line") == line, F.col("ordinal")))
    inside = F.bool_or((F.col("start_line") < line) & (F.col("end_line") >= line))
    per_file = records.groupBy("file_id").agg(starts.alias("header"), inside.alias("i"))
    problem = F.when(F.col("header").isNotNull(), F.lit(None)).when(F.col("i"), "csv.header-row-inside-record").otherwise(
        "csv.header-row-not-a-record"
    )
    return per_file.select("file_id", "header", problem.cast("string").alias("problem"))


def table_records(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Records from each file's header on, flagged ``is_header``."""
    joined = records.join(headers.select("file_id", "header"), "file_id")
    return joined.filter(F.col("ordinal") >= F.col("header")).withColumn(
        "is_header", F.col("ordinal") == F.col("header")
    ).drop("header")


def to_cells(records: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Long cells (file_id, row, column, raw, cell_type, is_header) of header-on records.

    A cell's row is the physical line where its record starts. Empty fields emit
    nothing, except in the header where the blank keeps its position; a record
    shorter than the header emits nothing for the absent fields. Text is never
    coerced.
    """
    widest = records.groupBy("file_id").agg(F.max(F.size("fields")).alias("_widest"))
    padded = records.join(widest, "file_id")
    pad = F.array_repeat(F.lit(""), F.greatest(F.col("_widest") - F.size("fields"), F.lit(0)))
    fields = F.when(F.col("is_header"), F.concat("fields", pad)).otherwise(F.col("fields"))
    cells = padded.select(
        "file_id", F.col("start_line").alias("row"), "is_header", F.posexplode(fields).alias("pos", "raw")
    ).withColumn("column", F.col("pos") + 1)
    wanted = F.col("column") >= first
    if last is not None:
        wanted = wanted & (F.col("column") <= last)
    kept = cells.filter(wanted & ((F.col("raw") != "") | F.col("is_header")))
    blank = F.col("raw") == ""
    return kept.select(
        "file_id", "row", "column", F.when(~blank, F.col("raw")).alias("raw"),
        F.when(blank, "blank").otherwise("text").alias("cell_type"), "is_header",
    )


def ingest_warnings(records: DataFrame) -> DataFrame:
    """(file_id, warning) pairs: ragged rows and skipped blank lines.

    A gap between one record's end and the next one's start is a skipped blank.
    """
    previous = records.select("file_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("end_line").alias("_end"))
    gaps = records.join(previous, ["file_id", "ordinal"], "left")
    per_file = gaps.groupBy("file_id").agg(
        F.bool_or(F.col("start_line") > F.coalesce("_end", F.lit(0)) + 1).alias("blank"),
        (F.min(F.size("fields")) < F.max(F.size("fields"))).alias("ragged"),
    )
    found = F.filter(
        F.array(
            F.when(F.col("ragged"), "ingest.warn.csv-ragged-rows"),
            F.when(F.col("blank"), "ingest.warn.csv-blank-records-skipped"),
        ),
        lambda x: x.isNotNull(),
    )
    return per_file.select("file_id", F.explode(found).alias("warning"))


def preview(records: DataFrame, n: int = POLICY.preview_records) -> DataFrame:
    """Per file: record count, bounds, and the first ``n`` records as rows."""
    bounds = records.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("start_line").alias("first_row"),
        F.max("end_line").alias("last_row"),
        F.max(F.size("fields")).alias("last_column"),
    )
    head = records.filter(F.col("ordinal") <= n).select("file_id", "ordinal", "start_line", "fields")
    return head.join(bounds, "file_id")


def hazards(records: DataFrame, text: DataFrame, max_cell: int, max_rows: int | None = None) -> DataFrame:
    """(file_id, row, rule, n) for shapes a spreadsheet or reader may trip over."""
    width = records.filter("ordinal = 1").select("file_id", F.size("fields").alias("_w"))
    rows = records.join(width, "file_id")
    formulas = F.size(F.filter("fields", starts_like_formula))
    long_ = F.size(F.filter("fields", lambda f: F.length(f) > max_cell))
    ragged = F.when((F.col("ordinal") > 1) & (F.size("fields") != F.col("_w")), 1).otherwise(0)
    found = F.array(
        F.struct(F.lit("csv.formula-prefix").alias("rule"), formulas.alias("n")),
        F.struct(F.lit("csv.cell-overflow").alias("rule"), long_.alias("n")),
        F.struct(F.lit("csv.ragged-row").alias("rule"), ragged.alias("n")),
    )
    per_row = rows.select("file_id", F.col("ordinal").alias("row"), F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x"))
    out = per_row.select("file_id", "row", "x.rule", F.col("x.n").cast("long").alias("n"))
    nul = text.filter(F.col("text").contains("\x00")).select(
        "file_id", F.lit(None).cast("long").alias("row"), F.lit("csv.binary-bytes").alias("rule"), F.lit(1).cast("long").alias("n")
    )
    odd = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    open_quote = text.filter(odd % 2 == 1).select(
        "file_id", F.lit(None).cast("long").alias("row"), F.lit("csv.unterminated-quote").alias("rule"), F.lit(1).cast("long").alias("n")
    )
    out = out.unionByName(nul).unionByName(open_quote)
    if max_rows is not None:
        counted = records.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows)
        out = out.unionByName(
            counted.select("file_id", F.lit(None).cast("long").alias("row"), F.lit("csv.row-limit").alias("rule"), "n")
        )
    return out
