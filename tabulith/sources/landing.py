"""Landing files: identity, format, encoding, limits and warnings per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.text import BLANKS
from tabulith.policy import Limits

# Leading bytes of container formats, as hex.
ZIP_MAGIC = "504B"
OLE2_MAGIC = "D0CF11E0A1B11AE1"
BYTE_ORDER_MARK = "﻿"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) for every file under ``path``; one row per file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def files_from_text(df: DataFrame, id_: str, text: str) -> DataFrame:
    """Treat each text value of a table as the bytes of one landed file."""
    return df.select(F.col(id_).cast("string").alias("file_id"), F.encode(F.col(text), "UTF-8").alias("content"))


def detect_format(content: Column) -> Column:
    """``zip``, ``ole2`` or ``delimited`` by leading bytes, never by name."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when((F.length(content) >= 4) & head.startswith(ZIP_MAGIC), "zip")
        .when(head == OLE2_MAGIC, "ole2")
        .otherwise("delimited")
    )


def audit(files: DataFrame) -> DataFrame:
    """(file_id, bytes, sha256, format) per landed file."""
    return files.select(
        "file_id",
        F.length("content").cast("long").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        detect_format(F.col("content")).alias("format"),
    )


def decode(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(file_id, text, problem): text without its byte order mark, or why not.

    Invalid UTF-8, whitespace-only content, unsupported containers and oversized
    files are quarantined with a reason instead of failing the job.
    """
    content = F.col("content")
    raw = content.cast("string")
    valid = F.is_valid_utf8(raw)
    marked = raw.startswith(BYTE_ORDER_MARK)
    text = F.when(marked, F.substring(raw, 2, 2_147_483_647)).otherwise(raw)
    format_ = detect_format(content)
    too_big = F.lit(False) if limits.input_bytes is None else F.length(content) > limits.input_bytes
    problem = (
        F.when(too_big, "limit.input-bytes")
        .when(format_ == "ole2", "unsupported.ole2-container")
        .when(format_ == "zip", "cells-required")
        .when(~valid, "csv.invalid-utf8")
        # The first character that is not blank settles it; the text is not copied.
        .when(~raw.rlike(f"[^{BLANKS}]"), "csv.empty")
    )
    judged = files.withColumn("problem", problem)
    return judged.select("file_id", F.when(F.col("problem").isNull(), text).alias("text"), "problem")


def limit_problems(records: DataFrame, limits: Limits) -> DataFrame:
    """(file_id, reason) for files over a row, column, volume or cell limit.

    ``records`` starts at the header record of each file. The first limit hit in
    reading order is the reason; everything is one aggregate per file.
    """
    widths = records.select(
        "file_id",
        "start_line",
        "end_line",
        F.size("fields").alias("w"),
        F.size(F.filter("fields", lambda f: f != "")).alias("filled"),
        F.array_max(F.transform("fields", lambda f: F.length(f))).alias("longest"),
    )
    per_file = widths.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("w").alias("columns"),
        F.sum("filled").alias("cells"),
        F.max("longest").alias("longest"),
        ((F.max("end_line") - F.min("start_line") + 1) * F.max("w")).alias("volume"),
    )

    def over(name: str, cap: int | None) -> Column:
        return F.lit(False) if cap is None else F.col(name) > cap

    reason = (
        F.when(over("rows", limits.rows_including_header), "rows-including-header")
        .when(over("columns", limits.columns), "columns")
        .when(over("volume", limits.nonempty_cells), "range-cells")
        .when(over("longest", limits.cell_characters), "cell.characters")
        .when(over("cells", limits.nonempty_cells), "nonempty-cells")
    )
    return per_file.withColumn("reason", reason).filter("reason is not null").select("file_id", "reason")
