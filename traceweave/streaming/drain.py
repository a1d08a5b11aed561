"""The end of a stream: what its state still holds becomes rows, and everything that came in is accounted for.

A stream that has read all there is (``availableNow``) leaves its last windows open, because no later packet moves the
watermark past them. They lie in the checkpoint's state, which Spark reads as tables. `flush` closes them the way the
stream would have closed them, `left_over` counts packets whose peer never registered, and `run_to_end` keeps count of
the rows that came too late. Flushed rows go beside the stream's own and are overwritten by the next flush, so a stream
may be taken up again after one.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from traceweave.operators.features import empty_runs, window_index
from traceweave.operators.ordered import sequence
from traceweave.session import cut_lineage
from traceweave.streaming.live import WINDOW_FIELDS, append_log


class Counts(StreamingQueryListener):
    """Rows read, written and dropped as late by one query, over all its batches."""

    def __init__(self) -> None:
        self.rows = {"rows_in": 0, "rows_out": 0, "rows_late": 0}
        self.query: str | None = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.query = self.query or str(event.runId)

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.query:
            self.rows["rows_in"] += event.progress.numInputRows
            self.rows["rows_out"] += max(event.progress.sink.numOutputRows, 0)
            self.rows["rows_late"] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.query:
            self.ended.set()


def run_to_end(rows: DataFrame, folder: str, checkpoint: str, wait_sec: float = 60.0) -> dict[str, int]:
    """Write a stream until its source has nothing more; returns `Counts.rows`."""
    spark, counts = rows.sparkSession, Counts()
    spark.streams.addListener(counts)
    try:
        append_log(rows, folder, checkpoint).awaitTermination()
        counts.ended.wait(wait_sec)  # progress comes by another thread, the end last
    finally:
        spark.streams.removeListener(counts)
    return counts.rows


def residual(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """What a keyed processor's state variable holds after the last batch: the key's fields and the value's, a row per element."""
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable)
    table = reader.load(checkpoint)
    value = next(name for name in ("value", "list_element", "user_map_value") if name in table.columns)
    # With a time to live, Spark wraps a value together with its end.
    inner = F.col(f"{value}.value") if "ttlExpirationMs" in table.schema[value].dataType.names else F.col(value)
    columns = [F.col("key.*")]
    if "user_map_key" in table.columns:
        columns.append(F.col("user_map_key").alias("_at"))
    return table.select(*columns, inner.alias("_value"))


def waiting_packets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The packets that a keyed processor's waiting list holds, a row each."""
    held = residual(spark, checkpoint, "waiting")
    fields = [F.col(f"_value.{n}").alias(n) for n in held.schema["_value"].dataType.names]
    packets = held.withColumn("_packet", F.explode(F.arrays_zip(*fields)))
    return packets.drop("_value").select("*", "_packet.*").drop("_packet")


def open_windows(spark: SparkSession, checkpoint: str, keys: Sequence[str], scales: Sequence[float]) -> DataFrame:
    """The windows that `anchored_windows` left open, closed at each trace's last packet.

    What a trace has taken stands before its waiting packets as one row: the predecessor of the first of them, which
    brings the open windows' totals.
    """
    keys, counts = list(keys), [n for n, _ in WINDOW_FIELDS[4:]]
    t, direction = F.col("timestamp_epoch"), F.col("direction")
    known = F.when(direction.isin("up", "down"), F.struct(t.alias("t"), direction.alias("d")))
    packets = waiting_packets(spark, checkpoint).withColumnsRenamed({"t": "timestamp_epoch", "index": "packet_index"})
    packets = packets.withColumn("known", known)
    begun = residual(spark, checkpoint, "trace").select(*keys, "_value.*").where("first IS NOT NULL")
    begun = begun.select(
        *keys, "first", "windows", F.col("last_t").alias("timestamp_epoch"), F.lit(None).cast("long").alias("packet_index"),
        F.when(F.col("known_t").isNotNull(), F.struct(F.col("known_t").alias("t"), F.col("known").alias("d"))).alias("known"),
    )
    rows = cut_lineage(packets.unionByName(begun, allowMissingColumns=True))
    trace = sequence(rows, keys, ["timestamp_epoch", "packet_index"])
    trace = trace.previous({"prev_t": t, "prev_known": F.col("known")})
    trace = trace.key_stats({"_first": F.min("first"), "_low": F.min("timestamp_epoch"), "trace_end": F.max("timestamp_epoch")})
    trace = trace.with_columns({"trace_start": F.coalesce("_first", "_low")})
    prev, before = F.col("prev_t"), F.col("prev_known")
    zero = F.lit(0).cast("long")

    def entry(scale: Column, index: Column, last: Column, values: Sequence[Column]) -> Column:
        return F.struct(scale.alias("scale"), index.alias("index"), last.alias("last"), *[v.alias(n) for n, v in zip(counts, values)])

    entries, empty = [], []
    for s in scales:
        scale = F.lit(float(s))
        own, prior = window_index(t, scale), window_index(prev, scale)
        gap = F.when(prior == own, F.greatest(t - prev, F.lit(0.0))).otherwise(F.lit(0.0))
        switched = (window_index(before["t"], scale) == own) & direction.isin("up", "down") & (before["d"] != direction)
        flags = [F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long") for c in (direction == "up", direction == "down", switched)]
        up, down, switches = flags
        entries.append(entry(scale, own, own, [zero + 1, up, down, F.col("size"), switches, gap, gap]))
        blank = [zero] * 5 + [F.lit(0.0)] * 2
        empty.append(F.transform(empty_runs(prior, own, float(s)), lambda g: entry(g["scale"], g["index"], g["last"], blank)))
    taken = F.array(*entries)
    held = F.transform("windows", lambda w: entry(w["scale"], w["index"], w["index"], [w[n] for n in counts]))
    whole = F.when(F.col("size").isNull(), held).when(prev.isNull(), taken).otherwise(F.concat(taken, *empty))
    exploded = trace.rows().select(*keys, F.explode(whole).alias("g"))
    exploded = exploded.select(*keys, "g.*", F.explode(F.sequence("g.index", "g.last")).alias("window_index"))
    start = F.col("window_index") * F.col("scale")
    totals = {n: F.max(n) if n == "iat_max_sec" else F.sum(n) for n in counts}
    return (
        exploded.groupBy(*keys, "scale", "window_index")
        .agg(*[c.alias(n) for n, c in totals.items()])
        .select(
            *keys, F.col("scale").alias("window_size_sec"), "window_index", start.alias("window_start_sec"),
            (start + F.col("scale")).alias("window_end_sec"), *counts,
        )
    )


def flush(spark: SparkSession, folder: str, checkpoint: str, keys: Sequence[str], scales: Sequence[float]) -> DataFrame:
    """Close what a stream of anchored windows left open; returns all its windows, written and flushed."""
    open_windows(spark, checkpoint, keys, scales).write.mode("overwrite").parquet(f"{folder.rstrip('/')}-flushed")
    return spark.read.parquet(folder).unionByName(spark.read.parquet(f"{folder.rstrip('/')}-flushed"))


def left_over(spark: SparkSession, checkpoint: str, run: str, peer: str) -> DataFrame:
    """run, peer, packets: what the registration buffer still holds for peers that never registered."""
    waiting = residual(spark, checkpoint, "waiting").select(run, peer, F.size("_value.i").cast("long").alias("n"))
    return waiting.groupBy(run, peer).agg(F.sum("n").alias("packets"))


def run_summary(windows: DataFrame, run: str, trace: Sequence[str], gates: DataFrame | None = None, left: DataFrame | None = None) -> DataFrame:
    """One row per run: traces, windows, packets in them (of the finest scale), predictions, stable traces, packets of
    unregistered peers."""
    trace = list(trace)
    scaled = windows.groupBy(run, "window_size_sec").agg(
        F.count_distinct(*[F.col(c) for c in trace]).alias("traces"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("packet_count_total").alias("packets"),
    )
    table = scaled.groupBy(run).agg(
        F.max("traces").alias("traces"),
        F.sum("rows").alias("feature_rows"),
        F.min_by("packets", "window_size_sec").alias("packets"),
    )
    if gates is not None:
        stable = F.when(F.col("first_stable_sec").isNotNull(), F.struct(*trace))
        gated = gates.groupBy(run).agg(F.count(F.lit(1)).alias("predictions"), F.count_distinct(stable).alias("stable_traces"))
        table = table.join(gated, run, "left").fillna(0, ["predictions", "stable_traces"])
    if left is not None:
        lost = left.groupBy(run).agg(F.count(F.lit(1)).alias("unregistered_peers"), F.sum("packets").alias("unregistered_packets"))
        table = table.join(lost, run, "full_outer").fillna(0)
    return table.withColumn("status", F.lit("stopped"))

