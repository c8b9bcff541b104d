"""Training-data queries with SQL give the rows of the SQL."""

import os

import duckdb
import pytest

from lexisieve.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) > 0

    def rows(df):
        return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))

    assert rows(got) == rows(want)
