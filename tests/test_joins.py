"""Range joins against all pairs, with intervals of very different lengths."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import shuffled_records
from traceweave.operators.joins import _serving, interval_join, overlapping_pairs


@pytest.fixture(scope="module")
def intervals():
    r = random.Random(2)
    rows = []
    for i in range(120):
        start = r.uniform(-50, 500)
        rows.append((r.choice("ab"), i, start, start + r.choice([0.0, 0.01, 1.0, 7.5, 64.0, 400.0]) * r.choice([1.0, 1.3])))
    return rows


SCHEMA = "k string, index long, start_epoch double, end_epoch double"


def test_points_in_intervals(spark, intervals):
    r = random.Random(3)
    points = [(r.choice("ab"), i, r.uniform(-60, 900)) for i in range(200)] + [(k, 1000 + i, s) for k, i, s, _ in intervals]
    got = interval_join(
        spark.createDataFrame(points, "k string, p long, t double"), spark.createDataFrame(intervals, SCHEMA), ["k"], "t", "start_epoch", "end_epoch"
    )
    want = sorted((p, i) for k, p, t in points for j, i, a, z in intervals if k == j and a <= t <= z)
    assert sorted((x["p"], x["index"]) for x in got.collect()) == want


def test_overlapping_intervals(spark, intervals):
    left, right = intervals[:70], intervals[50:]
    got = overlapping_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"])
    want = sorted(
        (i, j) for k, i, a, z in left for m, j, b, y in right if k == m and min(z, y) - max(a, b) > 0
    )
    assert sorted((x["left_index"], x["right_index"]) for x in got.collect()) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert overlapping_pairs(empty, empty, ["k"]).count() == 0


def test_points_are_not_copied_for_every_level(spark):
    """Few intervals of nine lengths: they go to many short buckets, not every point to nine levels."""
    points = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("t"))
    rows = [("a", i, 2000.0 * i, 2000.0 * i + 2.0**i) for i in range(9)]
    held = []

    def run():
        inside = interval_join(points, spark.createDataFrame(rows, SCHEMA), ["k"], "t", "start_epoch", "end_epoch")
        held.extend(inside.groupBy("index").count().collect())

    assert shuffled_records(spark, run) < 45_000
    assert sorted(map(tuple, held)) == [(i, 2**i + 1) for i in range(9)]


def test_many_intervals_of_a_length_keep_their_level():
    assert _serving({3: 10, 5: 10}, 1000) == {3: 3, 5: 3}
    assert _serving({3: 10, 20: 10}, 1000) == {3: 3, 20: 20}
    assert _serving({-20: 1, -19: 500, 40: 1}, 100) == {-20: -20, -19: -19, 40: 40}
