"""The registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tidewire.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.sql("SET timezone = 'UTC'")
    return con


def plain(x):
    return None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry_registers_all(spark):
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
