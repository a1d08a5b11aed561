"""Exact small cases of trace features and packet blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import PACKET_SCHEMA, packet_rows
from traceweave.catalog import tables as T
from traceweave.operators import features as FE

FOUR = [
    (1000.00, 100, "up", (180,), 0, 1),
    (1000.01, 200, "up", (), 0, 0),
    (1000.03, 300, "down", (250,), 0, 0),
    (1000.80, 400, "down", (), 1, 0),
]


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(packet_rows(FOUR), PACKET_SCHEMA)


def test_four_packets(four):
    row = FE.feature_rows(four, []).first().asDict()
    assert row["packet_count_total"] == 4 and row["bytes_total"] == 1000
    assert (row["bytes_up"], row["bytes_down"]) == (300, 700)
    assert row["burst_count_total"] == 3 and row["idle_gap_count"] == 1
    assert row["tcp_syn_count"] == 1 and row["connection_count"] == 1
    assert row["tcp_retransmission_count"] == 1 and row["tls_record_count"] == 2
    assert row["packet_size_p90"] == pytest.approx(370.0)
    assert row["packet_size_kurtosis"] == pytest.approx(-1.36)
    assert row["direction_switch_count"] == 1
    assert len(FE.PREDICTORS) == 92


def test_windows_restart_and_cover(four):
    rows = FE.feature_rows(four, [0.5, 1.0]).toPandas()
    half = rows[rows["window_size_sec"] == 0.5].sort_values("window_index")
    assert list(half["packet_count_total"]) == [3, 1]
    assert half["window_end_sec"].iloc[-1] == pytest.approx(0.8)
    assert list(half["burst_count_total"]) == [2, 1]
    assert half["iat_sec_mean"].iloc[1] == 0.0
    assert set(rows["row_type"]) == {"overall", "window"}


def test_empty_windows_are_emitted(spark):
    rows = packet_rows([(0.0, 10, "up", (), 0, 0), (3.2, 10, "down", (), 0, 0)])
    got = FE.feature_rows(spark.createDataFrame(rows, PACKET_SCHEMA), [1.0]).where("row_type = 'window'")
    counts = [r["packet_count_total"] for r in got.orderBy("window_index").collect()]
    assert counts == [1, 0, 0, 1]
    sparse = FE.feature_rows(spark.createDataFrame(rows, PACKET_SCHEMA), [1.0], dense=False)
    assert sparse.where("row_type = 'window'").count() == 2


def test_long_pauses_have_all_their_windows(spark):
    rows = packet_rows([(0.0, 10, "up", (), 0, 0), (25000.5, 10, "down", (), 0, 0), (25003.5, 10, "up", (), 0, 0)])
    got = FE.feature_rows(spark.createDataFrame(rows, PACKET_SCHEMA), [1.0, 5.0]).where("row_type = 'window'")
    got = got.groupBy("window_size_sec").agg(
        F.count("*").alias("n"), F.countDistinct("window_index").alias("d"), F.max("window_index").alias("last"),
        F.sum("packet_count_total").alias("packets"),
    )
    assert sorted(map(tuple, got.collect())) == [(1.0, 25004, 25004, 25003, 3), (5.0, 5001, 5001, 5000, 3)]


def test_blocks_are_exact(spark):
    rows = packet_rows([(i * 0.1, 100 + i, "up" if i % 2 else "down", (i,), 0, 0) for i in range(13)])
    got = FE.packet_blocks(spark.createDataFrame(rows, PACKET_SCHEMA), [5]).toPandas().sort_values("block_index")
    assert list(got["packet_start_index"]) == [0, 5] and list(got["packet_end_index"]) == [4, 9]
    assert got["packet_size_mean"].tolist() == [102.0, 107.0]
    assert got["direction_switch_rate"].tolist() == [1.0, 1.0]
    assert got["tls_record_size_median"].tolist() == [2.0, 7.0]


@pytest.mark.parametrize("limit", [15])
def test_hot_traces_give_the_same_rows(spark, limit):
    p = T.parsed_packets(spark, "/root/testdata/sf0.001")
    options = dict(burst_gap_sec=T.BURST_GAP, idle_threshold_sec=T.IDLE)
    key = ["experiment_id", "client_id", "window_size_sec", "window_index"]
    a = FE.feature_rows(p, [T.DAY], **options).toPandas().sort_values(key).reset_index(drop=True)
    b = FE.feature_rows(p, [T.DAY], limit=limit, **options).toPandas().sort_values(key).reset_index(drop=True)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fi":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-9, atol=1e-7, err_msg=c)
        else:
            pd.testing.assert_series_equal(a[c], b[c])


def test_groups_are_dealt_once_per_block(spark):
    """Packets of a group are shuffled once for each block; blocks meet where they are, and none is broadcast."""
    p = T.parsed_packets(spark, "/root/testdata/sf0.001")
    plan = FE.feature_rows(p, T.SCALES, T.BURST_GAP, T.IDLE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4  # all in one pass, bursts, connections, distributions
    assert "BroadcastExchange" not in plan
