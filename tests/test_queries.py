"""Every query with SQL gives the SQL's rows at sf0.001."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sedgeline.plans import exported  # noqa: F401  registers its queries
from sedgeline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(frame):
    def cell(v):
        return "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(round(v, 8)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(SQL[name]).df())
