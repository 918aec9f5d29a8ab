"""Every catalogue query against its SQL, and properties of plans."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from gridloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return round(float(v), 9) + 0.0 if not isinstance(v, str) else v

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), db.execute(catalogue.ORACLE[name]).df()
    assert set(ours.columns) == set(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"haversine_door", "total_models"}))
def test_no_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
