"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vellumetry.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows_as_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, DATA)
    cursor = oracle.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, expected)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
