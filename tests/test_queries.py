"""Every query against its SQL in DuckDB, as the driver compares them: columns by name, rows in any order."""

import os

import duckdb
import pytest

import __spark_entry__
from barloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents benchmark pages labels conversations embeddings".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "NULL" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    got = df.collect()
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).schema.names


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
