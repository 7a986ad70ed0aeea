"""The operators' queries that SQL can express, against DuckDB on the test tables."""

import os

import duckdb
import pytest

from barloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = registry.queries()[name](spark, data)
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_bpe", "op3_html_extraction", "op5_ngram_join", "op8_substring_dedup", "op12_minhash_dedup"])
def test_query_has_a_row_for_each_input_row(spark, data, name):
    table = "pages" if name in ("op1_url_filter", "op3_html_extraction") else "documents"
    assert registry.queries()[name](spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count()
