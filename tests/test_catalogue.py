"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from relspan import catalogue

from .conftest import DATA


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_no_python_on_the_default_path(spark):
    plan = catalogue.queries()["seven_op"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
