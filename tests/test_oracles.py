"""Every registered query with SQL gives the rows of the SQL, and some rows."""

import os

import duckdb
import pytest

from lexisieve.plans import rule_queries, run_queries, text_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {**rule_queries.QUERIES, **text_queries.QUERIES, **run_queries.QUERIES}
ORACLES = {**rule_queries.ORACLES, **text_queries.ORACLES, **run_queries.ORACLES}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return con


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toPandas(), sql.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) > 0 and rows(got, columns) == rows(want, columns)


def test_queries_without_sql_give_rows(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, SF).count() > 0, name
