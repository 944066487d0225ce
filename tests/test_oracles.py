"""Every registered query of the core against its SQL twin, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusmill.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    r = duck.execute(registry.SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    norm = lambda v: round(float(v), 5) if isinstance(v, float) else v
    ours = sorted((tuple(norm(x) for x in row) for row in df.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(norm(x) for x in row) for row in r.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_is_a_function():
    assert all(callable(f) for f in registry.QUERIES.values()) and registry.SQL.keys() <= registry.QUERIES.keys()
