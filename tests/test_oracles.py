"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from quizloom import queries as Q
from quizloom import source_queries

assert source_queries  # registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(Q.SQL[name])
    assert sorted(found.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(found.columns, map(str, found.types), strict=True))
    at = [found.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
