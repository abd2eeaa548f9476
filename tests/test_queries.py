"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from threadloom.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def cell(v):
        if pd.isna(v):
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
