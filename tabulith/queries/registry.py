"""Registry of the named queries and their plain-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``covers`` lists the operator ids it exercises."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL fragments shared by the twins --------------------------------------

OPS = """ops AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, r_name AS region, n_name AS site,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * 1.05, 2) AS DECIMAL(18,2)) AS target,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS cost,
         CAST(l_quantity AS BIGINT) AS orders, CAST(l_linenumber AS BIGINT) AS downtime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PLACED = """placed AS (
  SELECT o_orderkey + 2 AS source_row, o_orderkey, CAST(o_orderdate AS DATE) AS date, r_name AS region,
         n_name AS site, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CURRENT = ("1998-06-01", "1998-06-30")
PREVIOUS = ("1998-05-01", "1998-05-31")
IN_CURRENT = f"date BETWEEN DATE '{CURRENT[0]}' AND DATE '{CURRENT[1]}'"
IN_PREVIOUS = f"date BETWEEN DATE '{PREVIOUS[0]}' AND DATE '{PREVIOUS[1]}'"


def money_sql(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,2)) AS VARCHAR)"


def ratio_sql(num: str, den: str) -> str:
    """Half-up six-place ratio of two whole numbers, as ``functions.decimals.ratio6``."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    return (
        f"(CASE WHEN {d} <> 0 THEN CAST({sign} * ((ABS({n}) * 2000000 + ABS({d})) // (2 * ABS({d}))) AS DOUBLE)"
        f" / CAST(1000000 AS DOUBLE) END)"
    )


def cents_sql(expr: str) -> str:
    return f"(CAST({expr} AS DECIMAL(38,2)) * 100)"


def long_division_sql() -> str:
    """40 significant digits, half-up, of the whole numbers ``n`` over ``d`` > 0 of ``nd``, both below 10^18.

    Three 18-digit fraction limbs are divided out, the first 40 significant digits
    kept and a final carry applied in two halves.
    """
    return f"""l0 AS (SELECT id, ABS(n) // d AS q0, ABS(n) % d AS r0, d, n < 0 AS neg FROM nd),
 l1 AS (SELECT *, r0 * {10**18} // d AS f1, r0 * {10**18} % d AS r1 FROM l0), l2 AS (SELECT *, r1 * {10**18} // d AS f2, r1 * {10**18} % d AS r2 FROM l1),
 l3 AS (SELECT *, r2 * {10**18} // d AS f3 FROM l2),
 dg AS (SELECT id, neg, q0, CAST(q0 AS VARCHAR) AS whole, lpad(CAST(f1 AS VARCHAR), 18, '0') || lpad(CAST(f2 AS VARCHAR), 18, '0') || lpad(CAST(f3 AS VARCHAR), 18, '0') AS frac FROM l3),
 kp AS (SELECT *, CASE WHEN q0 > 0 THEN 40 - length(whole) ELSE 40 + length(frac) - length(ltrim(frac, '0')) END AS places FROM dg),
 cut AS (SELECT *, CAST('1' || substr(frac, 1, places - 20) AS HUGEINT) AS hi, CAST('1' || substr(frac, places - 19, 20) AS HUGEINT)
   + CASE WHEN substr(frac, places + 1, 1) >= '5' THEN 1 ELSE 0 END AS lo FROM kp),
 car AS (SELECT *, hi + CASE WHEN lo >= {2 * 10**20} THEN 1 ELSE 0 END AS h2, CASE WHEN lo >= {2 * 10**20} THEN lo - {10**20} ELSE lo END AS l2 FROM cut),
 out AS (SELECT id, CASE WHEN neg THEN '-' ELSE '' END || rtrim(rtrim(whole || '.' || substr(CAST(h2 AS VARCHAR), 2) || substr(CAST(l2 AS VARCHAR), 2), '0'), '.') AS value FROM car)"""
