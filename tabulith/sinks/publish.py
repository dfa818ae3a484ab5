"""Guarded output: staged, compared with its manifest, then published; typed clean data.

A version of a bundle is a folder of its own with one table per part. Nothing reads
it until a manifest row names it, and that row is written last, in one small commit.
Before anything is written the identities of the table and of the analysis must
agree; after it they must still agree, and every staged part must hold what was
counted on its way out. Whatever fails leaves no version behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.dates import to_real_date
from tabulith.functions.decimals import fraction_scale, is_decimal, is_integer, normalize_decimal
from tabulith.session import delete_tables
from tabulith.sinks.tables import StaleBundle, assert_current
from tabulith.table import ColumnInfo

MANIFEST = "version string, seq long, part string, rows long, digest decimal(38,0), identity map<string,string>"
WIDEST = 38


def typed_clean(rows: DataFrame, columns: Sequence[ColumnInfo], keep: Sequence[str] = ("source_row",)) -> DataFrame:
    """Clean text rows with columns of their declared type.

    A date column becomes a date, an integer a long, a decimal a decimal wide enough
    for its longest fraction (one aggregation tells). A cell that its type cannot hold
    exactly is null there and stays as it was in ``<column>__text``, which is null
    otherwise, so no digit is lost and no cell is guessed.
    """
    decimals = [c.id for c in columns if c.type in ("decimal", "mixed")]
    scales = {}
    if decimals:
        top = lambda c: F.max(F.when(is_decimal(F.col(c)), fraction_scale(normalize_decimal(F.col(c))))).alias(c)
        found = rows.agg(*[top(c) for c in decimals]).first()
        scales = {c: min(18, found[c] or 0) for c in decimals}
    out: list[Column] = []
    for c in columns:
        text = F.col(f"`{c.id}`")
        if c.type == "date":
            typed = to_real_date(text)
            exact = typed.isNotNull()
        elif c.type == "integer":
            whole = is_decimal(text) & is_integer(text)
            typed = F.when(whole, normalize_decimal(text)).try_cast("long")
            exact = typed.isNotNull()
        elif c.id in scales:
            plain = normalize_decimal(text)
            typed = F.when(is_decimal(text) & (fraction_scale(plain) <= scales[c.id]), plain).try_cast(f"decimal({WIDEST},{scales[c.id]})")
            exact = typed.isNotNull()
        else:
            out.append(text.alias(c.id))
            continue
        out += [typed.alias(c.id), F.when(text.isNotNull() & ~exact, text).alias(f"{c.id}__text")]
    return rows.select(*out, *keep)


def _digest(df: DataFrame) -> tuple[Column, Column]:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").alias("digest")


def publish(parts: Mapping[str, DataFrame], path: str, table: DataFrame, snapshot: DataFrame, names: Sequence[str]) -> str:
    """Write ``parts`` below ``path`` as one version and return its name; ``StaleBundle`` if they may not be published.

    ``table`` and ``snapshot`` are the one-row identities of the data and of the analysis
    that stands on it, compared on ``names`` before staging and again before the manifest.
    """
    spark = table.sparkSession
    assert_current(table, snapshot, names)
    version = uuid.uuid4().hex
    staged = {name: f"{path}/{version}/{name}" for name in parts}
    try:
        counted = {}
        for name, df in parts.items():
            df.write.mode("error").parquet(staged[name])
            counted[name] = spark.read.parquet(staged[name]).agg(*_digest(df)).first()
            if counted[name]["rows"] != df.count():
                raise StaleBundle(f"part {name} changed while it was written")
        assert_current(table, snapshot, names)
    except Exception:
        delete_tables(spark, [f"{path}/{version}"])
        raise
    identity = {n: str(v) for n, v in zip(names, table.select(*names).first(), strict=True)}
    seq = max([r["seq"] for r in manifest(spark, path).select("seq").distinct().collect()], default=0) + 1
    rows = [(version, seq, name, c["rows"], c["digest"], identity) for name, c in counted.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All published parts; empty where nothing was published yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except Exception as error:  # only a missing path means that nothing is there
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def read_published(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of the latest version, checked against its manifest."""
    latest = manifest(spark, path).filter(F.col("part") == part).orderBy(F.desc("seq")).first()
    if latest is None:
        raise FileNotFoundError(f"no published {part} below {path}")
    df = spark.read.parquet(f"{path}/{latest['version']}/{part}")
    found = df.agg(*_digest(df)).first()
    if (found["rows"], found["digest"]) != (latest["rows"], latest["digest"]):
        raise StaleBundle(f"{part} of version {latest['version']} is not what was published")
    return df
