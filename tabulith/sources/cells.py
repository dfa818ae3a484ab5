"""The cells contract: any extractor may hand over long cells, we make rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.decimals import normalize_decimal
from tabulith.table import ColumnInfo, Sheet

# Day serials of the two spreadsheet date systems.
MAX_SERIAL = 2_958_465 + 1_462
LEAP_BUG_SERIAL = 60


def with_plain_number(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add plain decimal text of a double: exponents expanded, no ``-0``, null if not finite.

    The digits are the shortest that read back as the same double; a long text is
    therefore tried at 15 and 16 significant digits first. Each step is its own
    projection, so nothing is computed twice per row.
    """
    value = F.col(source)
    pattern = r"^(-?)([0-9]+)(?:\.([0-9]+))?[eE]([+-]?[0-9]+)\z"
    finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
    step = df.withColumn("_full", F.when(finite, value.cast("string")))
    long_ = F.length("_full") > 15
    step = step.withColumn("_a", F.when(long_, F.format_string("%.14e", value)))
    step = step.withColumn("_b", F.when(long_, F.format_string("%.15e", value)))
    reads_back = [F.when(F.col(c).try_cast("double") == value, F.col(c)) for c in ("_a", "_b")]
    step = step.withColumn("_text", F.coalesce(*reads_back, "_full"))
    step = step.withColumn("_whole", F.regexp_extract("_text", pattern, 2)).withColumn(
        "_digits", F.concat("_whole", F.regexp_extract("_text", pattern, 3))
    )
    step = step.withColumn("_point", F.length("_whole") + F.regexp_extract("_text", pattern, 4).try_cast("int"))
    digits, point = F.col("_digits"), F.col("_point")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.rpad(digits, F.greatest(point, F.length(digits)), "0")
    middle = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    expanded = F.when(point <= 0, small).when(point >= F.length(digits), large).otherwise(middle)
    signed = F.concat(F.regexp_extract("_text", pattern, 1), expanded)
    step = step.withColumn("_plain", F.when(point.isNotNull(), signed).otherwise(F.col("_text")))
    return step.withColumn(out, normalize_decimal(F.col("_plain"))).drop(
        "_full", "_a", "_b", "_text", "_whole", "_digits", "_point", "_plain"
    )


def invalid_serial(serial: Column, date_system: Column) -> Column:
    """Day serials no calendar date stands for."""
    return (serial < 0) | (serial > MAX_SERIAL) | ((date_system == "1900") & (serial == LEAP_BUG_SERIAL))


def map_cells(raw: DataFrame) -> DataFrame:
    """Typed cells from extractor output.

    Input columns: ``kind`` (b, n, e, d, s or z), ``number`` double, ``text``,
    ``flag`` boolean, ``formula`` text without ``=``, ``cached`` text, ``is_date``
    boolean and ``date_system``, next to any coordinates. Formula text wins over
    its cached result; dates keep their serial; nothing is coerced.
    """
    kind = F.col("kind")
    has_formula = F.coalesce(F.length("formula") > 0, F.lit(False))
    raw = with_plain_number(raw, "number", "_number")
    number = F.col("_number")
    filled = F.coalesce(F.col("text") != "", F.lit(False))
    cell_type = (
        F.when(has_formula, "formula")
        .when(kind == "b", "boolean")
        .when((kind == "n") & F.col("is_date"), "date")
        .when(kind == "n", "number")
        .when(kind == "e", "error")
        .when(kind == "d", "date")
        .when(filled, "text")
        .otherwise("blank")
    )
    value = (
        F.when(has_formula, F.concat(F.lit("="), "formula"))
        .when(kind == "b", F.when(F.col("flag"), "TRUE").otherwise("FALSE"))
        .when(kind == "n", number)
        .when(kind.isin("e", "d"), F.col("text"))
        .when(filled, F.col("text"))
    )
    bad_serial = (kind == "n") & F.col("is_date") & (number.isNull() | invalid_serial(F.col("number"), F.col("date_system")))
    warning = F.when(has_formula, "ingest.warn.formula-cells").when(
        F.coalesce(bad_serial, F.lit(False)), "ingest.warn.invalid-date-serial"
    )
    dropped = ("kind", "number", "text", "flag", "formula", "cached", "is_date", "date_system", "_number")
    keep = [c for c in raw.columns if c not in dropped]
    return raw.select(
        *keep,
        value.alias("raw"),
        cell_type.alias("cell_type"),
        F.when(has_formula, F.concat(F.lit("="), "formula")).alias("formula"),
        F.when(has_formula, F.coalesce("cached", F.when(F.col("number").isNotNull(), number))).alias("cached_value"),
        warning.alias("warning"),
    )


def warnings(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct warnings per file: a closed vocabulary, so the set stays tiny."""
    return cells.filter(F.col("warning").isNotNull()).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("warning")), ",").alias("warnings")
    )


def content_bounds(cells: DataFrame, keys: Sequence[str], first_row: int = 1) -> DataFrame:
    """Last row and column range of the populated cells at or below ``first_row``."""
    populated = cells.filter((F.col("row") >= first_row) & (F.col("cell_type") != "blank"))
    return populated.groupBy(*keys).agg(
        F.max("row").alias("last_row"), F.min("column").alias("first_column"), F.max("column").alias("last_column")
    )


def choose_sheet(sheets: DataFrame, wanted: str | None = None, allow_hidden: bool = False) -> DataFrame:
    """(file_id, sheet_id, problem): the wanted sheet, else the first visible one."""
    visible = F.col("visibility") == "visible"
    if wanted is None:
        return sheets.groupBy("file_id").agg(
            F.min_by("sheet_id", F.when(visible, F.col("ordinal"))).alias("sheet_id"), F.count_if(visible).alias("v")
        ).select(
            "file_id",
            F.when(F.col("v") > 0, F.col("sheet_id")).alias("sheet_id"),
            F.when(F.col("v") == 0, "sheet.none-visible").alias("problem"),
        )
    match = F.col("sheet_id") == wanted
    found = sheets.groupBy("file_id").agg(
        F.bool_or(match).alias("f"), F.coalesce(F.bool_or(match & visible), F.lit(False)).alias("v")
    )
    problem = F.when(~F.col("f"), "sheet.not-found").when(
        ~F.col("v") & F.lit(not allow_hidden), "sheet.hidden-requires-opt-in"
    )
    return found.select("file_id", F.when(problem.isNull(), F.lit(wanted)).alias("sheet_id"), problem.alias("problem"))


def sparse_header_row(cells: DataFrame, keys: Sequence[str], preview: int) -> DataFrame:
    """(keys, header_row): first row whose filled-cell count is the modal one.

    Counted over the first ``preview`` populated rows; among equally frequent
    counts the one first seen wins.
    """
    from pyspark.sql import Window as W

    keys = list(keys)
    rows = cells.filter(F.col("cell_type") != "blank").groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("w"))
    # The rank is cut to ``preview`` rows per key before the shuffle.
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("row"))
    head = rows.withColumn("rn", rank).filter(F.col("rn") <= preview)
    counts = head.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("b"))
    return best.select(*keys, (-F.col("b.f")).alias("header_row"))


def data_rows(cells: DataFrame, header_row: int, keys: Sequence[str] = ()) -> DataFrame:
    """Physical lines below the header that produced at least one cell, per file or sheet named by ``keys``."""
    return cells.filter(F.col("row") > header_row).select(*keys, "row").distinct()


def to_sheet(
    cells: DataFrame, columns: Sequence[ColumnInfo], header_row: int, sheet_id: str = "S0", typed: bool = False
) -> Sheet:
    """Wide rows from the long cells of one table.

    A row gathers at most one cell per column, so its group is never large.
    ``typed`` keeps cell type, formula and cached value next to the text.
    """
    at = {c.source_column: c for c in columns}
    below = cells.filter((F.col("row") > header_row) & F.col("column").isin(*at))
    extra = ["cell_type", "formula", "cached_value"] if typed else []
    per_row = below.groupBy(F.col("row").cast("long").alias("source_row")).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("raw", *extra)))).alias("_m")
    )
    out = ["source_row"]
    for position, c in at.items():
        cell = F.try_element_at("_m", F.lit(position))
        out.append(cell["raw"].alias(c.id))
        if typed:
            out += [
                F.coalesce(cell["cell_type"], F.lit("blank")).alias(f"{c.id}__kind"),
                cell["formula"].alias(f"{c.id}__formula"),
                cell["cached_value"].alias(f"{c.id}__cached"),
            ]
    rows = per_row.select(*out)
    return Sheet(rows, tuple(columns), sheet_id, header_row, frozenset(c.id for c in columns) if typed else frozenset())
