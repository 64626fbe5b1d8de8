"""Every query runs, and agrees with its SQL where it has any."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from textlake.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations", "events"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


def rows_of(df, columns):
    return sorted(tuple("null" if pd.isna(x) else str(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert set(got.columns) == set(want.columns)
        assert rows_of(got, list(want.columns)) == rows_of(want, list(want.columns))
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
