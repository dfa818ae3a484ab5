"""Every registered query against its SQL twin on the same parquet tables."""

from __future__ import annotations

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tabulith.queries import COVERS, ORACLES, QUERIES


#: Queries that have nothing to tell about the smallest tables.
MAY_BE_EMPTY = {"evidence_page", "excluded_contributors", "set_difference", "trend_four_months"}


def plain(value):
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value if isinstance(value, (int, float, bool)) or value is None else str(value)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def results(spark, data):
    def run(name):
        try:
            df = QUERIES[name](spark, data)
            plan = df._jdf.queryExecution().executedPlan().toString()
            return name, (df.columns, [tuple(r) for r in df.collect()], plan)
        except Exception as error:  # reported by the test of that query
            return name, error

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, results, duck):
    got = results[name]
    if isinstance(got, Exception):
        raise got
    columns, rows, plan = got
    # No query may pair rows without a key, nor fall back to per-row Python.
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
    assert len(set(columns)) == len(columns)
    assert rows or name in MAY_BE_EMPTY
    if name not in ORACLES:
        return
    twin = duck.execute(ORACLES[name])
    names = [c[0] for c in twin.description]
    assert sorted(columns) == sorted(names)
    assert ordered(columns, rows) == ordered(names, twin.fetchall())


def test_every_operator_has_a_query():
    sizes = dict(S=18, K=9, P=20, N=18, J=13, A=21, W=8, T=6, U=5, F=24, E=14, C=5, V=22)
    covered = {x for ids in COVERS.values() for x in ids.split()}
    assert covered == {f"{p}{i}" for p, n in sizes.items() for i in range(1, n + 1)}
