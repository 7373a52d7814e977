"""The registry, and every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as e
from arrayloom import queries as core

DATA = "/root/testdata/sf0.001"


def test_registry():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"triangle_count", "bfs_levels", "erode2"} <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() == 1


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", [n for n in core.QUERIES if n in core.SQL])
def test_query_equals_sql(spark, duck, name):
    expected = duck.execute(core.SQL[name])
    columns = [c[0] for c in expected.description]
    expected = sorted(map(repr, ({k: _plain(v) for k, v in sorted(zip(columns, r))} for r in expected.fetchall())))
    found = core.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(repr({k: _plain(v) for k, v in sorted(r.asDict().items())}) for r in found.collect()) == expected


def _plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
