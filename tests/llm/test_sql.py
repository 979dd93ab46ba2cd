"""The training-data queries with SQL give DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from motiflake.llm.queries import QUERIES, SQL

TABLES = ("documents", "benchmark", "pages", "conversations")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_sql_says(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = con.sql(SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == names
    rows = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    assert rows == sorted(repr(tuple(dict(zip(want.columns, r, strict=True))[c] for c in names)) for r in want.fetchall())
