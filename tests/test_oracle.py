"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import importlib
import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
registry = importlib.import_module("tessera.plans.registry")
#: Long loops have tests of their own.
SLOW = {"graph_components", "datalog_same_generation"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return repr(x + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_matches(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    expected = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(expected.fetchall(), expected.columns)
