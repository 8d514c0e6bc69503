"""Every registered query against its SQL on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from nodeloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.5e}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF)
    cursor = db.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=2e-6, rel=2e-5) for a, b in zip(g, w, strict=True)), (g, w)


def test_entry_lists_queries_and_runs_the_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "region"
