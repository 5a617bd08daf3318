"""Every core query on the smallest scale, against its SQL on a second engine."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from newsloom.plans.catalog import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def second_engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return f"{float(value):.6f}"
    return str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(plain(v)) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, second_engine, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert rows(got) == rows(second_engine.sql(SQL[name]).df())


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 90
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0
