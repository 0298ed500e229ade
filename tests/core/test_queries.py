"""Every registered query of the library against its SQL on the smallest tables, and the contract of the entry file."""

import duckdb
import pytest

import __spark_entry__
from sporeline.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(names, values):
    """Rows as sorted text, columns by name, whole floats as integers."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple("None" if r[i] is None or r[i] != r[i] else plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
