"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from daygrain.plans import days, parts, rails, slate

PLANS = (slate, days, parts, rails)
QUERIES, ORACLES = {k: v for p in PLANS for k, v in p.QUERIES.items()}, {k: v for p in PLANS for k, v in p.ORACLES.items()}


def plain(df: pd.DataFrame) -> list:
    tell = lambda v: "∅" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else str(v) if isinstance(v, bool) else f"{float(v):.12g}" if isinstance(v, numbers.Number) else str(v)
    return sorted(tuple(map(tell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry():
    import __spark_entry__

    assert "day_states_flagship" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
