"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from traceweave.catalog import tables as T
from traceweave.operators import features as FE
from traceweave.streaming import drain as D
from traceweave.streaming import live as L

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def keyed(spark):
    L.use_keyed_state(spark)
    return spark


def replay(spark, df, order, folder, files=4):
    """Write a table as files in time order and read them back as a stream."""
    edges = df.select(F.percentile(order, F.array(*[F.lit(i / files) for i in range(1, files)]))).first()[0]
    part = sum((F.col(order) > e).cast("int") for e in edges)
    for i in range(files):  # one after the other: the source takes files by age
        df.where(part == i).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, folder):
    L.append_log(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def heartbeats(spark, df, folder, seconds, times=2):
    """Files without packets that move the watermark `seconds` past the last packet."""
    last = df.agg(F.max("timestamp_epoch")).first()[0]
    row = df.limit(1).withColumns(
        {"frame_length": F.lit(None).cast(df.schema["frame_length"].dataType), "experiment_id": F.lit("heartbeat")}
    )
    for i in range(times):
        beat = row.withColumn("timestamp_epoch", F.lit(last + seconds + i))
        L.with_event_time(beat).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_anchored_windows_equal_batch(keyed, tmp_path):
    p = L.with_event_time(T.parsed_packets(keyed, FOLDER))
    replay(keyed, p, "timestamp_epoch", str(tmp_path))
    heartbeats(keyed, p, str(tmp_path), 50 * T.DAY)
    source = keyed.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scales, trace = [2 * T.DAY, 7 * T.DAY], ["experiment_id", "client_id"]
    got = drain(L.anchored_windows(source, trace, scales, "5 seconds", idle_end=40 * T.DAY), str(tmp_path))
    want = FE.feature_rows(p, scales, T.BURST_GAP, T.IDLE).where("row_type = 'window'")
    same = ["window_size_sec", "window_index", "packet_count_total", "packet_count_up", "bytes_total", "direction_switch_count"]
    rows = lambda df, gap: sorted(tuple(r)[:-1] + (round(r[gap], 6),) for r in df.select(*trace, *same, gap).collect())
    assert rows(got, "iat_max_sec") == rows(want, "iat_sec_max")


def test_flushed_windows_equal_batch(keyed, tmp_path):
    """Without heartbeats the last windows come from the state that is left."""
    p = L.with_event_time(T.parsed_packets(keyed, FOLDER))
    source = replay(keyed, p, "timestamp_epoch", str(tmp_path))
    scales, trace = [2 * T.DAY, 7 * T.DAY], ["experiment_id", "client_id"]
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    counts = D.run_to_end(L.anchored_windows(source, trace, scales, "5 seconds", idle_end=40 * T.DAY), out, checkpoint)
    assert counts["rows_in"] == p.count() and counts["rows_late"] == 0
    got = D.flush(keyed, out, checkpoint, trace, scales)
    total = got.count()
    assert counts["rows_out"] < total
    want = FE.feature_rows(p, scales, T.BURST_GAP, T.IDLE).where("row_type = 'window'")
    same = ["window_size_sec", "window_index", "packet_count_total", "packet_count_up", "bytes_total", "direction_switch_count"]
    rows = lambda df, gap: sorted(tuple(r)[:-1] + (round(r[gap], 6),) for r in df.select(*trace, *same, gap).collect())
    assert rows(got, "iat_max_sec") == rows(want, "iat_sec_max")
    # Flushing again gives the same; the summary has every packet once.
    got = D.flush(keyed, out, checkpoint, trace, scales)
    assert got.count() == total
    summary = D.run_summary(got, "experiment_id", trace).collect()
    assert sum(r["packets"] for r in summary) == p.count()


def test_late_packets_are_counted(keyed, tmp_path):
    schema = "trace string, packet_index long, timestamp_epoch double, frame_length long, direction string, seq int"
    rows = [("a", 0, 10.0, 1, "up", 0), ("a", 1, 500.0, 1, "up", 1), ("a", 2, 900.0, 1, "up", 2), ("a", 3, 20.0, 1, "up", 3)]
    source = L.with_event_time(replay(keyed, keyed.createDataFrame(rows, schema), "seq", str(tmp_path), 4))
    windows = L.anchored_windows(source, ["trace"], [100.0], "5 seconds", idle_end=1e6)
    counts = D.run_to_end(windows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert (counts["rows_in"], counts["rows_late"]) == (4, 1)
    found = D.flush(keyed, f"{tmp_path}/out", f"{tmp_path}/checkpoint", ["trace"], [100.0])
    assert sorted((r["window_index"], r["packet_count_total"]) for r in found.collect() if r["packet_count_total"]) == [(0, 1), (4, 1), (8, 1)]


def test_trace_ends_and_late_first_packet(keyed, tmp_path):
    schema = "trace string, packet_index long, timestamp_epoch double, frame_length long, direction string"
    # 10.0 arrives before 9.5; the trace ends exactly with its third window; another one is half a second long.
    steps = [
        [("a", 1, 10.0, 100, "up"), ("b", 9, 10.0, 7, "up")],
        [("a", 0, 9.5, 50, "down"), ("b", 10, 10.5, 7, "down")],
        [("a", 2, 15.25, 10, "up")],
        [("a", 3, 18.5, 1, "down")],
        [("beat", 0, 60.0, None, None)],
        [("beat", 1, 61.0, None, None)],
    ]
    for rows in steps:
        L.with_event_time(keyed.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = keyed.read.parquet(f"{tmp_path}/in").schema
    source = keyed.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(L.anchored_windows(source, ["trace"], [3.0], "10 seconds", idle_end=20.0), str(tmp_path))
    rows = sorted((r["trace"], r["window_index"], r["packet_count_total"], r["bytes_total"], r["direction_switch_count"], r["iat_max_sec"]) for r in got.collect())
    assert rows == [
        ("a", 0, 2, 150, 1, 0.5),
        ("a", 1, 1, 10, 0, 0.0),
        ("a", 2, 1, 1, 0, 0.0),
        ("b", 0, 2, 14, 1, 0.5),
    ]


def test_epoch_windows(keyed, tmp_path):
    p = L.with_event_time(T.packets(keyed, FOLDER))
    source = replay(keyed, p, "timestamp_epoch", str(tmp_path))
    got = drain(L.epoch_windows(source, ["experiment_id"], [T.DAY], "1 minute"), str(tmp_path))
    day = p.groupBy("experiment_id", F.window("event_time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    both = got.join(day.select("experiment_id", F.col("w.start").alias("window_start"), "n"), ["experiment_id", "window_start"])
    assert got.count() == both.count() > 0
    assert both.where("n <> packet_count_total").count() == 0


def test_stability_gate(keyed, tmp_path):
    rows = [("t", float(i), lab, conf, n) for i, (lab, conf, n) in enumerate(
        [("a", 0.95, 30), ("a", 0.95, 30), ("a", 0.5, 30), ("a", 0.95, 30), ("a", 0.99, 30), ("a", 0.92, 30), ("b", 0.99, 30), ("b", 0.99, 5), ("b", 0.99, 30)]
    )]
    df = keyed.createDataFrame(rows, "trace string, elapsed_sec double, label string, confidence double, packet_count_total long")
    got = drain(L.stability_gate(replay(keyed, df, "elapsed_sec", str(tmp_path), 3), ["trace"]), str(tmp_path))
    stable = [(r["elapsed_sec"], r["stable_label"], r["first_stable_sec"]) for r in got.orderBy("elapsed_sec").collect() if r["stable"]]
    assert stable == [(5.0, "a", 5.0)]
    assert got.count() == 8


def test_registration_buffer(keyed, tmp_path):
    schema = "run string, peer string, kind string, client_id string, packet_index long, timestamp_epoch double, frame_length long, src_ip string, seq int"
    packets = [("r", "1.1", "packet", None, i, float(i), 10, "1.1" if i % 2 else "9.9", i) for i in range(6)]
    rows = packets + [("r", "1.1", "registration", "c1", None, None, None, None, 6), ("r", "1.1", "packet", None, 7, 7.0, 10, "9.9", 7)]
    source = replay(keyed, keyed.createDataFrame(rows, schema), "seq", str(tmp_path), 3)
    got = drain(L.registration_buffer(source, "run", "peer"), str(tmp_path)).orderBy("packet_index").collect()
    assert [r["packet_index"] for r in got] == [0, 1, 2, 3, 4, 5, 7]
    assert {r["client_id"] for r in got} == {"c1"}
    assert [r["direction"] for r in got][-1] == "down"
    assert D.left_over(keyed, f"{tmp_path}/checkpoint", "run", "peer").count() == 0


def test_packets_of_unregistered_peers_are_counted(keyed, tmp_path):
    schema = "run string, peer string, kind string, client_id string, packet_index long, timestamp_epoch double, frame_length long, src_ip string, seq int"
    rows = [("r", f"p{i % 2}", "packet", None, i, float(i), 10, "9.9", i) for i in range(7)]
    rows.append(("r", "p1", "registration", "c1", None, None, None, None, 7))
    source = replay(keyed, keyed.createDataFrame(rows, schema), "seq", str(tmp_path), 2)
    drain(L.registration_buffer(source, "run", "peer", expire_sec=3600), str(tmp_path))
    left = D.left_over(keyed, f"{tmp_path}/checkpoint", "run", "peer").collect()
    assert [(r["peer"], r["packets"]) for r in left] == [("p0", 4)]


@pytest.mark.parametrize("block_values", [1, 100])
def test_round_barrier(keyed, tmp_path, block_values):
    schema = "run string, sequence int, round long, client_id string, num_examples int, values array<double>"
    rows = [
        ("r", 0, 1, "a", 1, [1.0, 2.0]),
        ("r", 1, 1, "a", 1, [1.0, 2.0]),
        ("r", 2, 2, "b", 1, [0.0, 0.0]),
        ("r", 3, 1, "b", 3, [5.0, 6.0]),
        ("r", 4, 2, "b", 0, [1.0, 1.0]),
        ("r", 5, 2, "a", 1, [3.0, 3.0]),
    ]
    source = replay(keyed, keyed.createDataFrame(rows, schema), "sequence", str(tmp_path), 3)
    got = drain(L.round_barrier(source, "run", 2, block_values), str(tmp_path)).collect()
    means = {1: [], 2: []}
    for r in sorted((r for r in got if r["status"] == "aggregated"), key=lambda r: (r["round"], r["block"])):
        means[r["round"]] += r["values"]
    assert means == {1: [4.0, 5.0], 2: [2.0, 2.0]}
    assert sorted((r["status"], r["client_id"]) for r in got if r["status"] != "aggregated") == [("duplicate", "a"), ("stale_or_future", "b")]


def test_a_step_of_a_replay_is_one_batch(keyed, tmp_path):
    """Batches do not grow in number with the files of a table."""
    from traceweave.catalog.live import FILES, _replayed

    rows = keyed.range(600).repartition(20).select(F.col("id"), F.col("id").cast("double").alias("timestamp_epoch"))
    query = L.append_log(_replayed(rows, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == FILES
    assert keyed.read.parquet(f"{tmp_path}/out").count() == 600


class _Kept:
    """Stands for a state variable or handle; counts the calls and the rows it is given."""

    def __init__(self):
        self.value, self.items, self.calls, self.timers, self.names = None, [], {}, set(), {}

    def _count(self, name, n=1):
        self.calls[name] = self.calls.get(name, 0) + n

    def getValueState(self, name, *_):
        return self.names.setdefault(name, _Kept())

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def exists(self):
        return bool(self.items) or self.value is not None

    def get(self):
        self._count("get")
        return self.value or iter(list(self.items))

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self._count("rows", len(rows))
        self.items += rows

    def put(self, rows):
        self._count("rows", len(rows))
        self.items = list(rows)

    def clear(self):
        self.value, self.items = None, []


def test_waiting_packets_are_left_alone_until_passed():
    handle, processor = _Kept(), L.AnchoredWindows(["trace"], [10.0], 1e6)
    processor.init(handle)
    handle.names["trace"].get = lambda: handle.names["trace"].value
    for batch in range(50):
        new = [(float(100 * batch + i), 100 * batch + i, 1, "up") for i in range(100)]
        assert list(processor._advance(("a",), new, 0.0)) == []
    waiting = handle.names["waiting"]
    assert waiting.calls.get("get", 0) <= 1
    assert waiting.calls["rows"] <= 50  # an element a batch, not one a packet
    assert len(handle.timers) == 1
    assert len(L.from_chunks(waiting.items)) == 5000


def test_waiting_packets_of_a_peer_share_elements():
    handle, processor = _Kept(), L.RegistrationBuffer(["run"])
    processor.init(handle)
    handle.names["owner"].get = lambda: handle.names["owner"].value
    row = {"kind": "packet", "client_id": None, "timestamp_epoch": 1.0, "frame_length": 1, "src_ip": "9.9"}
    packets = [row | {"packet_index": i} for i in range(10_000)]
    assert list(processor.handleInputRows(("r", "p"), packets, None)) == []
    waiting = handle.names["waiting"]
    assert waiting.calls["rows"] == 3
    assert [p[0] for p in L.from_chunks(waiting.items)] == list(range(10_000))


def test_flush_closes_across_taken_and_waiting_packets(keyed, tmp_path):
    """Gaps and switches at the border, a trace that was not begun, packets of unknown direction, a null trace."""
    schema = "trace string, packet_index long, timestamp_epoch double, frame_length long, direction string"
    steps = [
        [("a", 0, 0.0, 1, "up"), ("a", 1, 4.0, 2, "unknown"), (None, 0, 1.0, 5, "down")],
        [("a", 2, 21.0, 4, "down"), ("b", 0, 30.0, 8, "up")],
        [("a", 3, 23.0, 8, "up"), ("a", 4, 45.0, 16, "down"), ("b", 1, 33.0, 8, None), (None, 1, 46.0, 5, "up")],
    ]
    for rows in steps:
        later = keyed.createDataFrame(rows, schema).withColumn("timestamp_epoch", F.col("timestamp_epoch") + 1000)
        L.with_event_time(later).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kind = keyed.read.parquet(f"{tmp_path}/in").schema
    source = keyed.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    D.run_to_end(L.anchored_windows(source, ["trace"], [20.0], "24 seconds", idle_end=1e6), out, checkpoint)
    found = D.flush(keyed, out, checkpoint, ["trace"], [20.0])
    columns = ["trace", "window_index", "packet_count_total", "packet_count_up", "bytes_total", "direction_switch_count", "iat_sum_sec", "iat_max_sec"]
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert rows == sorted(
        [
            ("a", 0, 2, 1, 3, 0, 4.0, 4.0),
            ("a", 1, 2, 1, 12, 1, 2.0, 2.0),
            ("a", 2, 1, 0, 16, 0, 0.0, 0.0),
            ("b", 0, 2, 1, 16, 0, 3.0, 3.0),
            (None, 0, 1, 0, 5, 0, 0.0, 0.0),
            (None, 1, 0, 0, 0, 0, 0.0, 0.0),
            (None, 2, 1, 1, 5, 0, 0.0, 0.0),
        ],
        key=str,
    )
