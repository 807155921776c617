"""Every engine query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tamarack.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "NULL"
        try:
            return repr(round(float(x), 8) + 0.0)
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
