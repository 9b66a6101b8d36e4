"""Every core query with SQL against DuckDB, value by value, and the pipeline end to end."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from skyloom.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, con, name):
    got = registry.queries()[name](spark, sf)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, cur.fetchall())
    assert len(a) == len(b)
    for p, q in zip(a, b):
        for x, y in zip(p, q):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-8)), (p, q)


def test_contract(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_pipeline(spark, sf):
    out = registry.queries()["q_pipeline"](spark, sf)
    assert out.count() > 0 and out.filter("redshift < 0.05 or n_bands < 3").count() == 0
