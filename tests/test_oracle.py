"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from motiflake.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


def rows(frame):
    def plain(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        return str(round(v, 6)) if isinstance(v, float) and not math.isnan(v) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted([tuple(plain(v) for v in r) for r in frame.itertuples(index=False)], key=str)


def number_like(rows_):
    """Whole numbers alike, whether an engine gives 3 or 3.0 (nullable columns become doubles in pandas)."""
    return [tuple(x[:-2] if isinstance(x, str) and x.endswith(".0") else x for x in r) for r in rows_]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_what_sql_says(spark, con, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert number_like(rows(got)) == number_like(rows(want))
