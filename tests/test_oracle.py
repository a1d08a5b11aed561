"""Every query with a SQL twin gives the same rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[c]) or pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype(float)
        else:
            frame[c] = frame[c].map(lambda v: None if pd.isna(v) else str(v)).astype(object)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=0, atol=1.1e-6)
