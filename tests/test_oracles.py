"""Every core query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from conftest import DATA

from skycat.plans import registry


def rows(df):
    def cell(v):
        if pd.isna(v):
            return None
        return str(v) if isinstance(v, (str, pd.Timestamp)) else float(v)

    return sorted(str(tuple(map(cell, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    assert len(ours)
    if sql := registry.oracle_sql().get(name):
        theirs = duck.execute(sql).df()
        assert set(ours.columns) == set(theirs.columns)
        assert rows(ours) == rows(theirs)
