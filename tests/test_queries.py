"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    relation = duck.sql(entry.oracle_sql()[name])
    columns = sorted(relation.columns)
    assert sorted(df.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 49


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
