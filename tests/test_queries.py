"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomgraph import program_queries, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SLOW = {"reaches_without_redefinition"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def show(v):
        """One form for nulls of every kind, and for whole numbers that pandas made floats."""
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 5))
        return str(v)

    return sorted(tuple(show(v) for v in row) for row in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_same_as_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_reaches_without_same_as_sql(spark, duck):
    name = "reaches_without_redefinition"
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())
