"""Structured Streaming: live packets, anchored windows, gates, buffers, barriers.

Windows aligned to the epoch are a plain streaming aggregation, which merges
map side and so does not mind a hot trace.  Windows anchored at a trace's first
packet, stability gates, registration buffers and round barriers keep keyed
state; each keeps only running totals or a bounded list per key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from traceweave.sources.scan import decoded_packets, split_decoded_line

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUFFER_PACKETS = 256


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def packet_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Decoder text files arriving in a folder, parsed like the batch reader."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return with_event_time(decoded_packets(lines.select(*split_decoded_line("value"))))


def with_event_time(packets: DataFrame, name: str = "event_time") -> DataFrame:
    return packets.withColumn(name, F.timestamp_micros((F.col("timestamp_epoch") * 1e6).cast("long")))


def epoch_windows(packets: DataFrame, keys: Sequence[str], scales: Sequence[float], late: str = "10 seconds") -> DataFrame:
    """Tumbling windows of several scales aligned to the epoch."""
    size = F.col("frame_length").cast("long")
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    parts = None
    for scale in scales:
        table = (
            packets.withWatermark("event_time", late)
            .groupBy(*keys, F.window("event_time", f"{round(scale * 1e6)} microseconds").alias("w"))
            .agg(
                F.count(F.lit(1)).alias("packet_count_total"),
                F.count(F.when(up, 1)).alias("packet_count_up"),
                F.count(F.when(down, 1)).alias("packet_count_down"),
                F.sum(size).alias("bytes_total"),
                F.max(size).alias("packet_size_max"),
            )
            .select(
                *keys, F.lit(float(scale)).alias("window_size_sec"), F.col("w.start").alias("window_start"),
                "packet_count_total", "packet_count_up", "packet_count_down", "bytes_total", "packet_size_max",
            )
        )
        parts = table if parts is None else parts.unionByName(table)
    return parts


WINDOW_FIELDS = (
    ("window_size_sec", T.DoubleType()),
    ("window_index", T.LongType()),
    ("window_start_sec", T.DoubleType()),
    ("window_end_sec", T.DoubleType()),
    ("packet_count_total", T.LongType()),
    ("packet_count_up", T.LongType()),
    ("packet_count_down", T.LongType()),
    ("bytes_total", T.LongType()),
    ("direction_switch_count", T.LongType()),
    ("iat_sum_sec", T.DoubleType()),
    ("iat_max_sec", T.DoubleType()),
)
EMPTY = (0, 0, 0, 0, 0, 0.0, 0.0)


def add_packets(
    scale: float, first: float, window: list | None, packets: Sequence[tuple], trace_end: float | None
) -> tuple[list[tuple], list | None]:
    """Windows of one scale that are done, as values of ``WINDOW_FIELDS``, and the open one.

    ``window``: index, the values from ``packet_count_total`` on, time and direction of the last packet. With
    ``trace_end`` the last window is done as well, and none is left open.
    """
    done = []
    last = None if trace_end is None else max(1, math.ceil((trace_end - first) / scale)) - 1
    w = window or [0, *EMPTY, None, None]

    def close() -> None:
        done.append((scale, w[0], w[0] * scale, w[0] * scale + scale, *w[1:8]))

    for t, _, size, direction in packets:
        index = int((t - first) // scale)
        index = index if last is None else min(index, last)
        while w[0] < index:
            close()
            w = [w[0] + 1, *EMPTY, None, None]
        known = direction in ("up", "down")
        w[1] += 1
        w[2] += direction == "up"
        w[3] += direction == "down"
        w[4] += int(size)
        w[5] += bool(known and w[9] is not None and w[9] != direction)
        if w[8] is not None:
            gap = max(0.0, t - w[8])
            w[6] += gap
            w[7] = max(w[7], gap)
        w[8] = t
        w[9] = direction if known else w[9]
    if trace_end is None:
        return done, w
    close()
    return done, None


#: Packets that one element of a list of waiting packets holds.
CHUNK_PACKETS = 4096


def packet_lists(*fields: tuple[str, T.DataType]) -> T.StructType:
    """An element of a waiting list: up to `CHUNK_PACKETS` packets, a list per field, so that packets share its cost."""
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in fields])


def in_chunks(packets: Sequence[tuple]) -> list[tuple]:
    starts = range(0, len(packets), CHUNK_PACKETS)
    return [tuple(list(field) for field in zip(*packets[i : i + CHUNK_PACKETS])) for i in starts]


def from_chunks(chunks: Iterable[tuple]) -> list[tuple]:
    return [packet for chunk in chunks for packet in zip(*chunk)]


class AnchoredWindows(StatefulProcessor):
    """Windows of every scale that start at the trace's first packet; the same rows as the batch operator's.

    Packets wait until the watermark has passed them and are then taken in order of time, so a late first packet
    still becomes the anchor. The packets of the latest time seen wait for a successor: as a trace's last ones they
    belong to the window that ends with them. Windows are written once a later one has a packet, with the empty ones
    between. A trace ends when the watermark is ``idle_end`` seconds past its last packet: its last window is written
    and its state removed. A packet after that starts a new trace. State: the packets of one watermark delay, and one
    value with what is known of the trace and its open window per scale. Waiting packets are read when some of them
    are passed, not with every batch, and a trace has one timer.

    Rows without a size are heartbeats: they move the watermark and are nothing else.
    """

    def __init__(self, names: Sequence[str], scales: Sequence[float], idle_end: float) -> None:
        self.row = Row(*names)
        self.scales = [float(s) for s in scales]
        self.idle_end = float(idle_end)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packets = packet_lists(
            ("t", T.DoubleType()), ("index", T.LongType()), ("size", T.LongType()), ("direction", T.StringType())
        )
        opened = T.StructType(
            [T.StructField("scale", T.DoubleType()), T.StructField("index", T.LongType())]
            + [T.StructField(n, t) for n, t in WINDOW_FIELDS[4:]]
            + [T.StructField("last_t", T.DoubleType()), T.StructField("last_known", T.StringType())]
        )
        # Of the packets that wait: earliest and latest time; of those taken: the first, the last, the last known one.
        times = ("low", "latest", "first", "last_t", "known_t")
        trace = T.StructType(
            [T.StructField("due", T.LongType())]
            + [T.StructField(n, T.DoubleType()) for n in times]
            + [T.StructField("known", T.StringType()), T.StructField("windows", T.ArrayType(opened))]
        )
        self.waiting = handle.getListState("waiting", packets)
        self.trace = handle.getValueState("trace", trace)

    def _advance(self, key: tuple, new: list, watermark: float, fired: int | None = None) -> Iterator[Row]:
        """Take what the watermark has passed; windows before the last packet's are written, at the trace's end all."""
        state = self.trace.get()
        if state is None and not new:
            return
        due, low, latest, first, last_t, known_t, known, windows = state or (None,) * 7 + ([],)
        if fired is not None and fired != due:
            return
        times = [p[0] for p in new] + [t for t in (low, latest) if t is not None]
        low, latest = min(times), max(times)
        over = watermark > latest + self.idle_end
        if not over and low >= min(watermark, latest):
            if new:
                self.waiting.appendList(in_chunks(new))
        else:
            packets = sorted(from_chunks(self.waiting.get()) + new) if state else sorted(new)
            ready = packets if over else [p for p in packets if p[0] < watermark and p[0] < latest]
            first = ready[0][0] if first is None else first
            held = {w[0]: list(w[1:]) for w in windows}
            windows = []
            for s in self.scales:
                done, window = add_packets(s, first, held.get(s), ready, latest if over else None)
                yield from (self.row(*key, *values) for values in done)
                windows.append((s, *window) if window else None)
            if over:
                if due is not None and fired is None:
                    self.handle.deleteTimer(due)
                self.waiting.clear()
                self.trace.clear()
                return
            last_t = ready[-1][0]
            known_t, known = next(((p[0], p[3]) for p in reversed(ready) if p[3] in ("up", "down")), (known_t, known))
            rest = packets[len(ready) :]
            low = rest[0][0]
            self.waiting.put(in_chunks(rest))
        # Wake when the next packet is passed, or when the trace is over.
        wake = int(max(low if low < latest else latest + self.idle_end, watermark) * 1000) + 2
        if wake != due:
            if due is not None and fired is None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wake)
        self.trace.update((wake, low, latest, first, last_t, known_t, known, [tuple(w) for w in windows]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [
            (r["timestamp_epoch"], r["packet_index"], int(r["frame_length"]), r["direction"])
            for r in rows
            if r["frame_length"] is not None
        ]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000.0
        yield from self._advance(key, [], watermark, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def keyed_schema(df: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, T.DataType]]) -> T.StructType:
    types = {f.name: f.dataType for f in df.schema.fields}
    return T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(n, t) for n, t in fields])


def anchored_windows(
    packets: DataFrame, keys: Sequence[str], scales: Sequence[float], late: str = "10 seconds", idle_end: float = 3600.0
) -> DataFrame:
    """Windows anchored at each trace's first packet; a trace is over ``idle_end`` seconds after its last packet."""
    schema = keyed_schema(packets, keys, WINDOW_FIELDS)
    processor = AnchoredWindows(schema.names, scales, idle_end)
    return (
        packets.withWatermark("event_time", late)
        .groupBy(*keys)
        .transformWithState(processor, schema, "Append", "EventTime")
    )


GATE_FIELDS = (
    ("elapsed_sec", T.DoubleType()),
    ("label", T.StringType()),
    ("accepted", T.IntegerType()),
    ("stable", T.IntegerType()),
    ("stable_label", T.StringType()),
    ("first_stable_sec", T.DoubleType()),
)


class StabilityGate(StatefulProcessor):
    """Stable once the last N windows were accepted with one label.

    A low confidence, a missing label or a sparse window clears the history;
    only the current label, its run length and the first stable time are kept.
    """

    def __init__(self, names: Sequence[str], windows: int = 3, confidence: float = 0.90, minimum_packets: int = 20) -> None:
        self.row = Row(*names)
        self.windows, self.confidence, self.minimum = max(int(windows), 1), confidence, minimum_packets

    def init(self, handle: StatefulProcessorHandle) -> None:
        run = T.StructType(
            [T.StructField("label", T.StringType()), T.StructField("length", T.LongType()), T.StructField("first", T.DoubleType())]
        )
        self.run = handle.getValueState("run", run)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        label, length, first = self.run.get() if self.run.exists() else (None, 0, None)
        for r in sorted(rows, key=lambda r: r["elapsed_sec"]):
            if r["packet_count_total"] < self.minimum:
                label, length = None, 0
                continue
            ok = bool(r["label"]) and r["confidence"] >= self.confidence
            length = (length + 1 if r["label"] == label else 1) if ok else 0
            label = r["label"] if ok else None
            stable = length >= self.windows
            if stable and first is None:
                first = r["elapsed_sec"]
            yield self.row(*key, r["elapsed_sec"], r["label"], int(ok), int(stable), label if stable else None, first)
        self.run.update((label, length, first))

    def close(self) -> None:
        pass


def stability_gate(predictions: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """``predictions``: keys, elapsed_sec, label, confidence, packet_count_total."""
    schema = keyed_schema(predictions, keys, GATE_FIELDS)
    return predictions.groupBy(*keys).transformWithState(StabilityGate(schema.names, **options), schema, "Append", "None")


RELEASED_FIELDS = (
    ("client_id", T.StringType()),
    ("packet_index", T.LongType()),
    ("timestamp_epoch", T.DoubleType()),
    ("frame_length", T.LongType()),
    ("direction", T.StringType()),
)


class RegistrationBuffer(StatefulProcessor):
    """Holds the packets of a peer until its registration arrives.

    On registration they are released with their direction derived from the
    peer's address, later packets pass straight through. With a ``capacity``
    only the newest packets wait; with ``expire_sec`` what a peer left behind
    goes that long after its last packet.
    """

    def __init__(self, names: Sequence[str], capacity: int | None = None, expire_sec: float | None = None) -> None:
        self.row = Row(*names)
        self.capacity = capacity
        self.ttl = None if expire_sec is None else int(expire_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        owner = T.StructType([T.StructField("client", T.StringType())])
        packets = packet_lists(
            ("i", T.LongType()), ("t", T.DoubleType()), ("n", T.LongType()), ("src", T.StringType())
        )
        self.owner = handle.getValueState("owner", owner, self.ttl)
        self.waiting = handle.getListState("waiting", packets, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        owner = self.owner.get()
        client = owner[0] if owner else None
        packets = []
        for r in rows:
            if r["kind"] == "registration":
                client = client or r["client_id"]
            else:
                packets.append((int(r["packet_index"]), float(r["timestamp_epoch"]), int(r["frame_length"]), r["src_ip"]))
        packets.sort(key=lambda p: (p[1], p[0]))
        if client is None:
            if self.capacity is None:
                if packets:
                    self.waiting.appendList(in_chunks(packets))
                return
            held = from_chunks(self.waiting.get()) + packets
            self.waiting.put(in_chunks(held[-self.capacity :]))
            return
        if not owner:
            self.owner.update((client,))
            packets = from_chunks(self.waiting.get()) + packets
            self.waiting.clear()
        for i, t, n, src in packets:
            yield self.row(*key, client, i, t, n, "up" if src == key[-1] else "down")

    def close(self) -> None:
        pass


def registration_buffer(
    events: DataFrame, run: str, peer: str, capacity: int | None = None, expire_sec: float | None = None
) -> DataFrame:
    """``events``: union of packets and registrations with a ``kind`` column, keyed by run and peer ip.

    Nothing is dropped unless a capacity (``BUFFER_PACKETS`` is the usual one) or an expiry is given.
    """
    schema = keyed_schema(events, [run, peer], RELEASED_FIELDS)
    processor = RegistrationBuffer(schema.names, capacity, expire_sec)
    mode = "None" if expire_sec is None else "ProcessingTime"
    return events.groupBy(run, peer).transformWithState(processor, schema, "Append", mode)


BARRIER_FIELDS = (
    ("round", T.LongType()),
    ("status", T.StringType()),
    ("client_id", T.StringType()),
    ("total_examples", T.LongType()),
    ("values", T.ArrayType(T.DoubleType())),
)
#: Values of a model that one key holds.
BLOCK_VALUES = 65_536


class RoundBarrier(StatefulProcessor):
    """Averages one block of a model once all expected clients have sent their update of the round.

    All blocks of a run see the same updates in the same order, so each decides alike; what is rejected (duplicates,
    updates of another round) is written by the first block only. State is the block's running weighted sum and the
    clients seen, not the updates themselves.
    """

    def __init__(self, names: Sequence[str], expected: int) -> None:
        self.row = Row(*names)
        self.expected = int(expected)

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = T.StructType(
            [
                T.StructField("round", T.LongType()),
                T.StructField("weight", T.LongType()),
                T.StructField("size", T.LongType()),
                T.StructField("sums", T.ArrayType(T.DoubleType())),
                T.StructField("clients", T.ArrayType(T.StringType())),
            ]
        )
        self.state = handle.getValueState("state", state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        current, weight, size, sums, clients = self.state.get() if self.state.exists() else (1, 0, 0, [], [])
        sums, clients = np.array(sums, float), list(clients)
        first_block = key[-1] == 0
        for r in sorted(rows, key=lambda r: r["sequence"]):
            client = r["client_id"]
            status = "stale_or_future" if r["round"] != current else "duplicate" if client in clients else None
            if status is not None:
                if first_block:
                    yield self.row(*key, r["round"], status, client, None, None)
                continue
            if clients and r["size"] != size:
                raise ValueError(f"update of {client} has another length")
            w, values = max(int(r["num_examples"]), 1), np.array(r["values"], float)
            sums = w * values if not clients else sums + w * values
            weight, size = weight + w, r["size"]
            clients.append(client)
            if len(clients) == self.expected:
                yield self.row(*key, current, "aggregated", None, weight, (sums / weight).tolist())
                current, weight, size, sums, clients = current + 1, 0, 0, np.zeros(0), []
        self.state.update((current, weight, size, sums.tolist(), clients))

    def close(self) -> None:
        pass


def round_barrier(updates: DataFrame, run: str, expected: int, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``updates``: run, sequence, round, client_id, num_examples, values.

    One row per finished round and block of ``block_values`` values (``block`` from 0), and one per rejected update.
    """
    n = F.size("values").cast("long")
    count = F.greatest(F.ceil(n / block_values), F.lit(1)).cast("int")
    begin = F.col("block") * block_values + 1
    blocks = updates.select(
        run, "sequence", "round", "client_id", "num_examples", n.alias("size"), "values",
        F.explode(F.sequence(F.lit(0), count - 1)).alias("block"),
    ).withColumn("values", F.slice("values", begin, F.lit(block_values)))
    schema = keyed_schema(blocks, [run, "block"], BARRIER_FIELDS)
    return blocks.groupBy(run, "block").transformWithState(RoundBarrier(schema.names, expected), schema, "Append", "None")


def append_log(rows: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Append-only sink: every row of the stream once, as parquet."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(folder)
