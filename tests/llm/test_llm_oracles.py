"""Queries with SQL give the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from quizloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, SF).select(*found.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
