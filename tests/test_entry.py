"""Every registered query on the smallest tables, against its SQL where it has one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "~"
        return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)

    return sorted(map(tuple, df[sorted(df.columns)].map(text).values.tolist()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in E.queries() if not n.startswith("p") or not n[1:2].isdigit() or n[:2] in ("p3", "p5")])
def test_query(spark, con, name):
    got = E.queries()[name](spark, DATA).toPandas()
    if name in E.oracle_sql():
        want = con.sql(E.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
