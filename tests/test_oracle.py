"""Every query with SQL gives the same rows as its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from verifold.plans import rule_queries  # noqa: F401 (adds its queries)
from verifold.plans.queries import SQL, Q

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat().removesuffix("T00:00:00")
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 9) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(Q[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, name):
    assert Q[name](spark, DATA.replace("0.01", "0.001")).count() > 0
