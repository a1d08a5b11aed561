"""Round inference on synthetic traces; matching against brute force."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PACKET_SCHEMA, packet_rows, shuffled_records
from traceweave.operators import matching as M
from traceweave.operators import rounds as R
from traceweave.operators.features import TRACE
from traceweave.operators.pairing import pair_transfers

CFG = R.RoundConfig(bin_sec=0.1, min_bin_bytes=1500, bridge_gap_sec=0.2, min_major_transfer_bytes=50_000)


def cycles(count, spacing=0.005, pause=3.5):
    rows = []
    for c in range(count):
        t = c * 10.0
        rows += [(t + i * spacing, 1500, "down", (), 0, 0) for i in range(100)]
        rows += [(t + 100 * spacing + pause + i * spacing, 1500, "up", (), 0, 0) for i in range(100)]
    return rows


@pytest.mark.parametrize("segment_rows", [100_000, 3])
def test_five_cycles(spark, segment_rows):
    p = spark.createDataFrame(packet_rows(cycles(5)) + packet_rows(cycles(1), client="client_2"), PACKET_SCHEMA)
    rounds, report = R.infer_rounds(p, CFG, segment_rows=segment_rows)
    found = rounds.orderBy("client_id", "inferred_round_index").collect()
    mine = [r for r in found if r["client_id"] == "client_1"]
    assert [r["inferred_round_index"] for r in mine] == [0, 1, 2, 3, 4]
    assert all(0.8 < r["confidence"] <= 1.0 for r in mine)
    assert all(r["packet_count"] >= 190 for r in mine)
    assert [r["inferred_round_index"] for r in found if r["client_id"] == "client_2"] == [0]
    assert {r["status"] for r in report.collect()} == {"ok"}


def test_few_packets(spark):
    p = spark.createDataFrame(packet_rows(cycles(1)[:10]), PACKET_SCHEMA)
    rounds, report = R.infer_rounds(p, CFG)
    assert rounds.count() == 0
    assert report.first()["status"] == "insufficient_packets"


def one_by_one(bursts, longest, ratio):
    """Pairs by feeding the bursts of one trace in order."""
    pairs, wait = [], None
    for direction, start, end, size, purity in sorted(bursts, key=lambda b: b[1:3]):
        now = (start, end, size, purity)
        if direction == "down":
            wait = now if wait is None or size >= wait[2] else wait
        elif wait and start > wait[1]:
            if not 0 < end - wait[0] <= longest:
                wait = None
            elif max(size / max(wait[2], 1), wait[2] / max(size, 1)) <= ratio:
                pairs.append(wait + now)
                wait = None
    return pairs


def test_pairing_keeps_stronger_download(spark):
    feed = [
        ("down", 0.0, 1.0, 100.0, 1.0),
        ("down", 2.0, 3.0, 500.0, 1.0),
        ("up", 4.0, 5.0, 10.0, 1.0),
        ("up", 6.0, 7.0, 400.0, 1.0),
        ("up", 8.0, 9.0, 400.0, 1.0),
    ]
    assert one_by_one(feed, 3600, 8) == [(2.0, 3.0, 500.0, 1.0, 6.0, 7.0, 400.0, 1.0)]


@pytest.mark.parametrize("segment_rows", [1, 2, 7, 100_000])
def test_pairs_do_not_depend_on_segments(spark, segment_rows):
    rng, feeds, rows = random.Random(8), {}, []
    for client in [*(f"c{i}" for i in range(12)), None]:
        t, feed, wide = 0.0, [], rng.choice([4, 40, 4000])
        for _ in range(rng.choice([1, 5, 60])):
            t += rng.choice([1, 2, 5, 30])
            feed.append((rng.choice(["down", "up"]), t, t + rng.choice([0, 1, 4]), float(rng.randint(1, wide)), 0.5))
        feeds[client] = feed
        rows += [("e", client, *f) for f in feed]
    names = "experiment_id string, client_id string, direction string, start_epoch double, end_epoch double, dominant_bytes double, purity double"
    found = pair_transfers(spark.createDataFrame(rows, names), 60, 4, TRACE, segment_rows).collect()
    want = [(client, *p) for client, feed in feeds.items() for p in one_by_one(feed, 60, 4)]
    assert sorted((tuple(r)[1:] for r in found), key=str) == sorted(want, key=str) and len(want) > 40


def intervals(rng, count, step):
    at, out = 0.0, []
    for i in range(count):
        at += round(rng.random() * step, 2)
        out.append((i, at, round(at + rng.random() * 3, 2)))
    return out


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_matching_equals_sequential_greedy(spark, limit):
    rng, sides, want = random.Random(3), ([], []), set()
    for client in ["a", "b", None]:
        left, right = intervals(rng, 40, 2.0), intervals(rng, 50, 1.5)
        right += [(90, 5.0, 5.0), (91, left[3][1], left[3][2])]
        for side, rows in zip(sides, (left, right), strict=True):
            side += [("e", client, *r) for r in rows]
        pairs = []
        for i, a0, a1 in left:
            for j, b0, b1 in right:
                iou = max(0.0, min(a1, b1) - max(a0, b0)) / max(max(a1, b1) - min(a0, b0), 1e-9)
                if iou >= 0.25 and b1 > b0:
                    pairs.append((-iou, abs(a0 - b0), i, j))
        used_l, used_r = set(), set()
        for _, _, i, j in sorted(pairs):
            if i not in used_l and j not in used_r:
                used_l.add(i)
                used_r.add(j)
                want.add((client, i, j))
    schema = "experiment_id string, client_id string, index long, start_epoch double, end_epoch double"
    tables = [spark.createDataFrame(rows, schema) for rows in sides]
    got = M.greedy_matches(*tables, TRACE, limit=limit)
    assert {(r["client_id"], r["left_index"], r["right_index"]) for r in got.collect()} == want and len(want) > 30


def offset_by_all_pairs(a, b, width, tolerance, top):
    buckets = {}
    for x in a:
        for y in b:
            buckets.setdefault(round((x - y) / width), []).append(x - y)
    fullest = sorted(buckets.values(), key=len, reverse=True)[:top]
    offsets = [statistics.median(v) for v in fullest] + [0.0]
    offsets.append(statistics.median(x - y for x, y in list(zip(a, b))[:20]))
    best = None
    for offset in offsets:
        pairs = sorted((abs(x - offset - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - offset - y) <= tolerance)
        used_i, used_j, errors = set(), set(), []
        for error, i, j in pairs:
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                errors.append(error)
        if errors:
            rank = (-len(errors), round(statistics.median(errors), 6), round(statistics.mean(errors), 6))
            if best is None or rank < best[0]:
                best = (rank, offset)
    return best


@pytest.mark.parametrize("block", [8, 64, 1 << 12])
def test_clock_offset_equals_all_pairs(monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BINS", block)
    rng = random.Random(block)
    for _ in range(60):
        span = rng.choice([5, 50, 1000])
        b = sorted(rng.choice([rng.random() * span, rng.randint(0, span) * 0.25]) for _ in range(rng.randint(1, 40)))
        offset = rng.choice([0, 3.1, -7.25, 40])
        a = [y + offset + rng.choice([0, rng.gauss(0, 0.1)]) for y in b if rng.random() < 0.8]
        a = sorted(a + [rng.random() * span for _ in range(rng.randint(1, 10))])
        top = rng.choice([1, 3, 64])
        (support, median, mean), want = offset_by_all_pairs(a, b, 0.25, 0.25, top)
        got = M.consensus(np.array(a), np.array(b), 0.25, 0.25, top)
        assert got == pytest.approx((want, -support, median, mean), abs=2e-6)


def test_shifted_clock_is_found_and_scored(spark):
    truth = [("e", "c", i, 100.0 + 10 * i + i % 3, 106.0 + 10 * i) for i in range(30)]
    found = [("e", "c", i, s + 7.125, e + 7.125) for _, _, i, s, e in truth if i % 7] + [("e", "d", 0, 1.0, 2.0)]
    truth.append(("e", "alone", 0, 1.0, 2.0))
    schema = "experiment_id string, client_id string, index long, start_epoch double, end_epoch double"
    made = M.validate_rounds(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), TRACE)
    scores = {r["client_id"]: r.asDict() for r in made["scores"].collect()}
    assert set(scores) == {"c", "alone"}
    assert scores["alone"]["status"] == "no_inferred_rounds" and scores["alone"]["boundary_recall_iou_25"] == 0
    one = scores["c"]
    assert one["clock_offset_sec"] == pytest.approx(7.125) and one["clock_alignment_support"] == 25
    assert (one["matched_rounds_iou_75"], one["boundary_precision"], one["interval_iou_mean"]) == (25, 1.0, pytest.approx(1.0))


def many_traces(spark, traces):
    left = spark.range(traces).select(F.col("id").alias("trace"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("index"))
    left = left.withColumn("start_epoch", F.col("trace") * 7.0 + F.col("index") * 10.0 + F.col("trace") % 3)
    left = left.withColumn("end_epoch", F.col("start_epoch") + 6.0)
    shifted = [(F.col(c) + 2.0).alias(c) for c in ("start_epoch", "end_epoch")]
    return left, left.select("trace", "index", *shifted)


def test_many_small_traces_cost_little_each(spark):
    """Groups of a few rows share batches; a group each (and a long FFT a trace) took minutes."""
    left, right = many_traces(spark, 15_000)
    began = time.monotonic()
    matches = M.greedy_matches(left, right, ["trace"]).agg(F.count("*"), F.min("iou"), F.max("start_error_sec")).first()
    offsets = M.clock_offsets(left, right, ["trace"]).groupBy("clock_offset_sec", "clock_alignment_support").count().collect()
    assert time.monotonic() - began < 60
    assert tuple(matches) == (90_000, 0.5, 2.0)
    assert [tuple(r) for r in offsets] == [(-2.0, 6, 15_000)]


def test_listed_differences_equal_correlated_ones(monkeypatch):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (7, 9), (60, 40)):
        a, b = (np.sort(rng.integers(0, 400, k) / 8.0) for k in (n, m))
        listed = [M.consensus(a, b, 0.25, 0.25, top) for top in (3, 64)]
        monkeypatch.setattr(M, "LISTED_PAIRS", 0)
        assert [M.consensus(a, b, 0.25, 0.25, top) for top in (3, 64)] == listed
        monkeypatch.undo()


def test_round_dataset_plans_rounds_once(spark):
    """Rounds and their rows are cut off, so that X and Y do not plan (and compute) them in each branch."""
    from traceweave.plans.jobs import round_dataset

    feed = [(10.0 * r + s + 0.1 * k, 1400, d, [], 0, 0) for r in range(6) for s, d in ((0, "down"), (4, "up")) for k in range(20)]
    packets = spark.createDataFrame(packet_rows(feed), PACKET_SCHEMA)
    labels = spark.createDataFrame([("run_1", "client_1", "f")], "experiment_id string, client_id string, family string")
    made = round_dataset(packets, labels, ["family"])
    assert made["x"].count() == made["y"].count() == made["boundaries"].count() == 6
    for name in "xy":
        assert len(made[name]._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def rounds_of_many_lengths(spark, clients):
    """Six rounds a client, from 8 to 250 seconds long, and as many packets between them."""
    feed = []
    for r in range(6):
        start, pause = 1000.0 * r, 4.0 * 2**r
        feed += [(start + s + 0.1 * k, 1400, d, [], 0, 0) for s, d in ((0, "down"), (pause, "up")) for k in range(20)]
        feed += [(start + 500 + 10 * k, 40, "up", [], 0, 0) for k in range(40)]
    one = spark.createDataFrame(packet_rows(feed), PACKET_SCHEMA)
    copies = spark.range(clients).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("_copy"))
    return one.crossJoin(copies).withColumn("client_id", F.col("_copy")).drop("_copy")


def test_round_dataset_shuffles_a_packet_few_times(spark):
    """Once for its bin, once each to count and to measure the packets of a round; not once per length and block."""
    from traceweave.plans.jobs import round_dataset

    packets = rounds_of_many_lengths(spark, 40).localCheckpoint()
    labels = packets.select("experiment_id", "client_id").distinct().withColumn("family", F.lit("f")).localCheckpoint()
    made = {}
    wrote = shuffled_records(spark, lambda: made.update(round_dataset(packets, labels, ["family"])))
    x = made["x"].select("client_id", "window_index", "packet_count_total", "iat_sec_max")
    assert sorted({tuple(r)[1:3] for r in x.collect()}) == [(i, 40) for i in range(6)] and x.count() == 240
    assert wrote < 8 * packets.count()


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_segments_restart_their_gaps_switches_and_bursts(spark, limit):
    """Packets on a shared border are in both segments; overlapping segments do not disturb each other."""
    from traceweave.operators.features import segment_features

    times = [(0.0, "up"), (1.0, "down"), (2.0, "unknown"), (3.0, "down"), (3.0, "up"), (5.0, "up"), (9.0, "down")]
    feed = [(t + 100 * k, 100 + k, d, [k], 0, 0) for k in range(30) for t, d in times]
    packets = spark.createDataFrame(packet_rows(feed), PACKET_SCHEMA)
    spans = [(0, 1.0, 3.0), (1, 3.0, 9.0), (2, 3.0, 3.0), (3, 0.0, 2909.0), (4, 6.0, 8.0)]
    segments = spark.createDataFrame(
        [("run_1", "client_1", *s) for s in spans], "experiment_id string, client_id string, segment_index long, start_epoch double, end_epoch double"
    )
    rows = segment_features(packets, segments, burst_gap_sec=1.5, limit=limit)
    names = ["window_index", "packet_count_total", "direction_switch_count", "burst_count_total", "iat_sec_max", "window_start_sec", "window_end_sec"]
    found = sorted(tuple(r) for r in rows.select(*names).collect())
    assert found == [
        (0, 4, 1, 4, 1.0, 1.0, 3.0),
        (1, 4, 2, 4, 4.0, 3.0, 9.0),
        (2, 2, 1, 2, 0.0, 3.0, 3.0),
        (3, 210, 30 * 3 + 29, 30 * 7, 91.0, 0.0, 2909.0),
    ]


def test_many_small_traces_are_paired_in_batches(spark):
    """A Python group a trace took two minutes, shared batches take 18 s."""
    n = 24_000
    rows = spark.range(n).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("experiment_id"),
        F.lit("c").alias("client_id"),
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"),
    )
    rows = rows.select(
        "experiment_id",
        "client_id",
        F.when(F.col("i") % 2 == 0, "down").otherwise("up").alias("direction"),
        (F.col("i") * 10.0).alias("start_epoch"),
        (F.col("i") * 10.0 + 5).alias("end_epoch"),
        F.lit(100.0).alias("dominant_bytes"),
        F.lit(1.0).alias("purity"),
    )
    began = time.monotonic()
    found = pair_transfers(rows, 60, 4, TRACE).agg(F.count("*"), F.countDistinct("experiment_id")).first()
    assert time.monotonic() - began < 60
    assert tuple(found) == (3 * n, n)
