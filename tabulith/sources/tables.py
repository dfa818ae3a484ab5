"""Star-schema scans and the assembled operations fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(amount: Column) -> Column:
    """A two-decimal double as whole cents, exact after half-up rounding."""
    return F.round(amount.cast("decimal(18,2)") * 100, 0).cast("long")


def percent_of(cents_col: Column, hundredths: Column) -> Column:
    """``cents * hundredths / 100`` rounded half-up to whole cents."""
    doubled = cents_col * hundredths * 2
    magnitude = F.call_function("div", F.abs(doubled) + 100, F.lit(200).cast("long"))
    return F.when(doubled < 0, -magnitude).otherwise(magnitude)


def money(total_cents: Column) -> Column:
    """Whole cents as exact two-decimal money."""
    return (total_cents.cast("decimal(36,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)")


def money_text(total_cents: Column) -> Column:
    return money(total_cents).cast("string")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """(nationkey, site, region): one row per nation."""
    nation = scan(spark, folder, "nation")
    region = scan(spark, folder, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("site"), F.col("r_name").alias("region")
    )


def placed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their date, region and site; ``source_row`` starts at 2.

    Customers meet the small place table first, so only (key, site, region)
    travels in the one shuffle this join may need.
    """
    customer = scan(spark, folder, "customer").select("c_custkey", "c_nationkey")
    where = customer.join(places(spark, folder), F.col("c_nationkey") == F.col("nationkey")).select(
        "c_custkey", "site", "region"
    )
    orders = scan(spark, folder, "orders")
    return orders.join(where, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.col("o_orderkey") + 2).alias("source_row"),
        "o_orderkey",
        F.to_date("o_orderdate").alias("date"),
        "region",
        "site",
        "o_orderstatus",
        "o_orderpriority",
        cents(F.col("o_totalprice")).alias("price"),
    )


def line_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Additive whole-number measures of every line item, money in cents."""
    line = scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_linenumber"
    )
    revenue = cents(F.col("l_extendedprice"))
    off = F.round(F.col("l_discount").cast("decimal(4,2)") * 100, 0).cast("long")
    return line.select(
        "l_orderkey",
        revenue.alias("revenue"),
        percent_of(revenue, F.lit(105).cast("long")).alias("target"),
        percent_of(revenue, 100 - off).alias("cost"),
        F.col("l_quantity").cast("long").alias("orders"),
        F.col("l_linenumber").cast("long").alias("downtime"),
    )


MEASURES = ("revenue", "target", "cost", "orders", "downtime")


def fact_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Row-level operations fact: one row per line item."""
    lines = line_measures(spark, folder)
    placed = placed_orders(spark, folder)
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def fact_by_order(spark: SparkSession, folder: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Operations fact pre-added to one row per order, with its line count.

    Every measure is additive, so lines are summed map-side before the join: an
    order that owned a third of all lines is one row by the time it is shuffled.
    With ``days`` (first and last date) only the lines of orders placed then are added up.
    """
    placed, lines = placed_orders(spark, folder), line_measures(spark, folder)
    if days:
        placed = placed.filter(F.col("date").between(*[F.lit(d).cast("date") for d in days]))
        lines = lines.join(placed.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    per_order = lines.groupBy("l_orderkey").agg(*[F.sum(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("rows"))
    return placed.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
