"""Adapters: the given tables as packets, labels, scores ... (Spark and SQL).

Each adapter exists twice with the same rules, once as a DataFrame and once as
the text of a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweave.functions import exprs as X

HOUR, DAY = 3600.0, 86400.0
SCALES = (6 * HOUR, DAY, 2 * DAY, 7 * DAY)
BURST_GAP = 6 * HOUR
IDLE = DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_seconds(name: str):
    return (
        F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")
        / F.lit(1e6)
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw packets."""
    ev = table(spark, sf_dir, "events")
    up, down = F.col("event_type").isin("click", "purchase"), F.col("event_type").isin("view", "signup")
    k = F.get_json_object("props", "$.k").cast("int")
    ev = ev.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 12).cast("string")).alias("experiment_id"),
        F.concat(F.lit("client_"), F.col("user_id").cast("string")).alias("client_id"),
        F.col("event_id").alias("packet_index"),
        epoch_seconds("ts").alias("timestamp_epoch"),
        (F.floor(F.col("value") * 10).cast("int") + 40).alias("frame_length"),
        F.when(up, "up").when(down, "down").otherwise("unknown").alias("direction"),
        k.alias("k"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("_client_ip"),
        (F.lit(50000) + F.col("user_id") % 3).cast("int").alias("_client_port"),
    )
    back = F.col("direction") == "down"
    proxy_ip, proxy_port = F.lit("10.0.0.251"), F.lit(8080)
    return ev.select(
        "experiment_id",
        "client_id",
        "packet_index",
        "timestamp_epoch",
        "frame_length",
        F.when(back, proxy_ip).otherwise(F.col("_client_ip")).alias("src_ip"),
        F.when(back, F.col("_client_ip")).otherwise(proxy_ip).alias("dst_ip"),
        F.when(back, proxy_port).otherwise(F.col("_client_port")).alias("src_port"),
        F.when(back, F.col("_client_port")).otherwise(proxy_port).alias("dst_port"),
        F.when(F.col("k") % 10 == 0, "UDP").otherwise("TCP").alias("transport_protocol"),
        F.concat(F.lit("0x"), F.lower(F.hex(F.col("k") % 32))).alias("tcp_flags_hex"),
        F.when(F.col("k") % 17 == 0, 1).otherwise(0).alias("retransmission"),
        F.when(
            F.col("k") % 3 == 0,
            F.concat_ws(";", F.col("k").cast("string"), (F.col("k") + F.col("frame_length")).cast("string")),
        )
        .otherwise("")
        .alias("tls_text"),
        "direction",
        "k",
    )


def parsed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with flag columns and TLS lengths, as the feature operators take them."""
    raw = packets(spark, sf_dir)
    return X.with_flags(raw).withColumn("tls_record_lengths", X.int_list("tls_text"))


PACKETS_SQL = """
pk AS (
  SELECT 'run_' || (user_id % 12) AS experiment_id, 'client_' || user_id AS client_id, user_id,
    event_id AS packet_index, epoch_us(ts) / 1e6::DOUBLE AS timestamp_epoch,
    CAST(floor(value * 10) AS INTEGER) + 40 AS frame_length,
    CASE WHEN event_type IN ('click','purchase') THEN 'up' WHEN event_type IN ('view','signup') THEN 'down' ELSE 'unknown' END AS direction,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
raw AS (
  SELECT experiment_id, client_id, user_id, packet_index, timestamp_epoch, frame_length, direction, k,
    CASE WHEN direction = 'down' THEN '10.0.0.251' ELSE '10.0.0.' || (user_id % 250) END AS src_ip,
    CASE WHEN direction = 'down' THEN '10.0.0.' || (user_id % 250) ELSE '10.0.0.251' END AS dst_ip,
    CASE WHEN direction = 'down' THEN 8080 ELSE CAST(50000 + user_id % 3 AS INTEGER) END AS src_port,
    CASE WHEN direction = 'down' THEN CAST(50000 + user_id % 3 AS INTEGER) ELSE 8080 END AS dst_port,
    CASE WHEN k % 10 = 0 THEN 'UDP' ELSE 'TCP' END AS transport_protocol,
    '0x' || lower(printf('%x', k % 32)) AS tcp_flags_hex,
    CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS retransmission,
    CASE WHEN k % 3 = 0 THEN k || ';' || (k + frame_length) ELSE '' END AS tls_text
  FROM pk),
pp AS (
  SELECT *, ((k % 32) & 2 > 0)::INT AS tcp_syn, ((k % 32) & 16 > 0)::INT AS tcp_ack,
    ((k % 32) & 1 > 0)::INT AS tcp_fin, ((k % 32) & 4 > 0)::INT AS tcp_rst,
    CASE WHEN k % 3 = 0 THEN [k, k + frame_length] ELSE [] END AS tls
  FROM raw)
"""
