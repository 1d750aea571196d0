"""Every registered query with a statement against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from corvane.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if isinstance(value, float) and value != value else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in SQL:
        rel = duck.sql(SQL[name])
        order = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == sorted(repr([plain(r[k]) for k in order]) for r in rel.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
