"""Streaming queries: the events as a stream that ends, its rows, and what is left in its state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.tables import DAY, PACKETS_SQL, SCALES, parsed_packets
from traceweave.catalog.traces import features_sql
from traceweave.functions.exprs import rounded
from traceweave.operators.features import TRACE
from traceweave.session import shared_folder
from traceweave.streaming import drain, live

FILES = 3


def _replayed(rows: DataFrame, folder: str, order: str = "timestamp_epoch") -> DataFrame:
    """The rows as files in order of time, one step written after the other, read as a stream.

    A trigger takes a step's files, however many these are: batches that grew in number with the table would each visit
    every key again.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - low) / max(high - low, 1e-9) * FILES), F.lit(FILES - 1))
    for i in range(FILES):
        rows.where(part == i).write.mode("append").parquet(f"{folder}/in/{i}")
    files = max(len(spark.read.schema(rows.schema).parquet(f"{folder}/in/{i}").inputFiles()) for i in range(FILES))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(files, 4)).parquet(f"{folder}/in/*")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"


class _Stateful:
    """Keyed processors need their state store while they run; the session's own comes back behind them."""

    def __init__(self, spark) -> None:
        self.conf, self.name = spark.conf, "spark.sql.streaming.stateStore.providerClass"
        self.before = spark.conf.get(self.name)
        live.use_keyed_state(spark)

    def __enter__(self) -> None:
        pass

    def __exit__(self, *_) -> None:
        self.conf.set(self.name, self.before)


@query(
    f"""SELECT experiment_id, client_id, window_size_sec, window_index, {r6("window_start_sec")} AS window_start_sec, packet_count_total, packet_count_up, packet_count_down, bytes_total, direction_switch_count, {r6("iat_sec_max")} AS iat_max_sec
FROM ({features_sql(SCALES)}) w WHERE row_type = 'window'"""
)
def live_windows(spark, sf_dir):
    """All windows of a stream that has ended: those it wrote, and those that its last state still held."""
    names = [*TRACE, "packet_index", "timestamp_epoch", "frame_length", "direction"]
    folder = _folder(spark)
    with _Stateful(spark):
        source = live.with_event_time(_replayed(parsed_packets(spark, sf_dir).select(*names), folder))
        windows = live.anchored_windows(source, TRACE, SCALES, f"{int(20 * DAY)} seconds", idle_end=60 * DAY)
        drain.run_to_end(windows, f"{folder}/out", f"{folder}/checkpoint")
        found = drain.flush(spark, f"{folder}/out", f"{folder}/checkpoint", TRACE, SCALES)
    columns = "window_size_sec window_index window_start_sec packet_count_total packet_count_up packet_count_down bytes_total direction_switch_count iat_max_sec"
    return rounded(found.select(*TRACE, *columns.split()))


@query(
    f"""WITH {PACKETS_SQL}, k AS (SELECT experiment_id, '10.0.0.' || (user_id % 250) AS peer, src_ip, user_id FROM raw), o AS (SELECT DISTINCT experiment_id, peer FROM k WHERE user_id % 3 <> 0),
g AS (SELECT experiment_id, peer, count(*) AS n, count(*) FILTER (src_ip = peer) AS up FROM k GROUP BY 1, 2)
SELECT experiment_id, peer, CASE WHEN o.peer IS NULL THEN 0 ELSE n END AS released, CASE WHEN o.peer IS NULL THEN 0 ELSE up END AS released_up, CASE WHEN o.peer IS NULL THEN n ELSE 0 END AS left_over FROM g LEFT JOIN o USING (experiment_id, peer)"""
)
def live_registrations(spark, sf_dir):
    """Packets wait for the registration of their peer, which comes half-way; a third of the peers never register."""
    p = parsed_packets(spark, sf_dir)
    back = F.col("direction") == "down"
    user = F.substring("client_id", 8, 18).cast("long")
    packets = p.select(
        "experiment_id",
        F.when(back, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("peer"),
        F.lit("packet").alias("kind"),
        user.alias("_user"),
        "packet_index",
        "timestamp_epoch",
        F.col("frame_length").cast("long").alias("frame_length"),
        "src_ip",
    )
    owners = packets.where(F.col("_user") % 3 != 0).groupBy("experiment_id", "peer").agg(
        ((F.min("timestamp_epoch") + F.max("timestamp_epoch")) / 2).alias("timestamp_epoch"), F.min("_user").alias("_user")
    )
    events = packets.withColumn("client_id", F.lit(None).cast("string")).unionByName(
        owners.withColumns({"kind": F.lit("registration"), "client_id": F.concat(F.lit("client_"), F.col("_user"))}),
        allowMissingColumns=True,
    ).drop("_user")
    folder = _folder(spark)
    with _Stateful(spark):
        released = live.registration_buffer(_replayed(events, folder), "experiment_id", "peer")
        drain.run_to_end(released, f"{folder}/out", f"{folder}/checkpoint")
        left = drain.left_over(spark, f"{folder}/checkpoint", "experiment_id", "peer").withColumnRenamed("packets", "left_over")
        found = spark.read.parquet(f"{folder}/out").groupBy("experiment_id", "peer").agg(
            F.count(F.lit(1)).alias("released"), F.count(F.when(F.col("direction") == "up", 1)).alias("released_up")
        )
    return found.join(left, ["experiment_id", "peer"], "full_outer").fillna(0)
