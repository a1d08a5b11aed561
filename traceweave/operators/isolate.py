"""Packet selection, identity removal and trace stitching."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.features import ORDER, TRACE
from traceweave.operators.ordered import DEFAULT_LIMIT, null_safe_join, sequence
from traceweave.session import cut_lineage

# ---- fixed values -------------------------------------------------------
SAFE_COLUMNS = (
    "experiment_id packet_index relative_time_sec frame_length direction transport_protocol tcp_flags_hex tcp_syn "
    "tcp_ack tcp_fin tcp_rst retransmission tls_record_count tls_record_lengths"
).split()
RAW_REQUIRED = (
    "packet_index timestamp_epoch frame_length src_ip dst_ip src_port dst_port transport_protocol tcp_flags_hex "
    "retransmission tls_record_lengths"
).split()
STITCH_MINIMUM_PACKETS = 20
#: Result rows of an address (and of a task on average) above which they are dealt out, connections of one cell.
PAIRS_PER_TASK = 8_000_000
CONNECTIONS_HELD = 100_000
# -------------------------------------------------------------------------


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def client_facing(packets: DataFrame, clients: DataFrame) -> DataFrame:
    """Packets with a client address at either end (drops the upstream leg).

    ``clients`` has run and address columns (``experiment_id``, ``client_ip``).
    Two left joins on the deduplicated address list replace an OR condition,
    which Spark could only run as a nested loop.
    """
    ips = clients.select("experiment_id", "client_ip").distinct()
    return (
        packets.join(
            ips.select("experiment_id", F.col("client_ip").alias("src_ip"), F.lit(True).alias("_s")),
            ["experiment_id", "src_ip"],
            "left",
        )
        .join(
            ips.select("experiment_id", F.col("client_ip").alias("dst_ip"), F.lit(True).alias("_d")),
            ["experiment_id", "dst_ip"],
            "left",
        )
        .withColumns(
            {
                "src_is_client": F.coalesce("_s", F.lit(False)),
                "dst_is_client": F.coalesce("_d", F.lit(False)),
            }
        )
        .drop("_s", "_d")
        .where("src_is_client or dst_is_client")
    )


def with_directions(packets: DataFrame, server_ip: str | None = None) -> DataFrame:
    """Direction from the client flags of ``client_facing`` and the server address."""
    server = F.lit(server_ip or "")
    known = F.lit(bool(server_ip))
    return packets.withColumn(
        "direction",
        X.direction_of(
            F.col("src_is_client"),
            F.col("dst_is_client"),
            known & (F.col("src_ip") == server),
            known & (F.col("dst_ip") == server),
        ),
    )


def connection_facing(
    packets: DataFrame, connections: DataFrame, pairs: int = PAIRS_PER_TASK, held: int = CONNECTIONS_HELD
) -> DataFrame:
    """Packets of accepted connections, labelled with the connection's alias.

    ``connections``: ``experiment_id client_ip client_port alias`` and, where a
    check of the proxy side is wanted, ``proxy_ip proxy_port`` (null = any).
    Each end of a packet is looked up by an equi join; a packet gives a row per
    connection of each end, an upload at its source, a download at its
    destination. Where connections share an address, the result is packets
    times connections of it: an address above ``pairs`` of them is dealt into
    cells by packet and, above ``held`` connections, by alias, and a large
    result into tasks by its own rows, not by the bytes of its input.
    """
    columns = connections.columns
    proxy_ip = F.col("proxy_ip") if "proxy_ip" in columns else F.lit(None).cast("string")
    proxy_port = F.col("proxy_port") if "proxy_port" in columns else F.lit(None).cast("int")
    address = ["experiment_id", "_ip", "_port"]
    side = connections.select(
        "experiment_id",
        F.col("client_ip").alias("_ip"),
        F.col("client_port").alias("_port"),
        "alias",
        proxy_ip.alias("_proxy_ip"),
        proxy_port.alias("_proxy_port"),
    ).na.drop(subset=address)

    def end(near: str, far: str, direction: str):
        names = {"_ip": f"{near}_ip", "_port": f"{near}_port", "_far_ip": f"{far}_ip", "_far_port": f"{far}_port"}
        return F.struct(*[F.col(c).alias(n) for n, c in names.items()], F.lit(direction).alias("connection_direction"))

    both = F.explode(F.array(end("src", "dst", "up"), end("dst", "src", "down")))
    ends = packets.withColumn("_end", both).select(*packets.columns, "_end.*").na.drop(subset=address)

    met = side.groupBy(*address).agg(F.count(F.lit(1)).alias("_m"))
    load = ends.groupBy(*address).agg(F.count(F.lit(1)).alias("_n")).join(met, address, "left").na.fill(0, ["_m"])
    load = cut_lineage(load.withColumn("_pairs", F.col("_n").cast("double") * F.col("_m")))
    total = load.agg(F.sum("_pairs")).first()[0] or 0.0
    # Addresses without a connection are the proxy's own: where they are large, their ends go before the shuffle.
    large = load.where((F.col("_pairs") > pairs) | (F.col("_m") > held) | ((F.col("_m") == 0) & (F.col("_n") > pairs)))
    aliases = F.greatest(F.ceil(F.col("_m") / held), F.lit(1))
    cells = F.broadcast(
        large.select(
            *address,
            (F.col("_m") == 0).alias("_unmet"),
            F.greatest(F.ceil(F.col("_pairs") / aliases / pairs), F.lit(1)).alias("_rows"),
            aliases.alias("_aliases"),
        )
    )

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        """Rows in their own slice of an address, once for every slice of the other side."""
        found = rows.join(cells, address, "left").where("_unmet is null or not _unmet")
        slices = F.coalesce(own, F.lit(1))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        found = found.withColumns({f"{own}_cell": F.pmod(F.xxhash64(by), slices), f"{other}_cell": every})
        found = found.drop("_unmet", "_rows", "_aliases")
        return found.repartition(tasks, *key) if total > pairs else found

    key = [*address, "_rows_cell", "_aliases_cell"]
    tasks = max(int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / pairs))
    ok = (F.col("_proxy_ip").isNull() | (F.col("_proxy_ip") == F.col("_far_ip"))) & (
        F.col("_proxy_port").isNull() | (F.col("_proxy_port") == F.col("_far_port"))
    )
    hit = dealt(ends, "packet_index", "_rows", "_aliases").join(dealt(side, "alias", "_aliases", "_rows"), key).where(ok)
    return hit.select(*packets.columns, "alias", "connection_direction")


def per_client(packets: DataFrame, clients: DataFrame) -> DataFrame:
    """One copy of each packet per client it touches, direction as that client sees it.

    ``clients``: ``experiment_id client_ip``.  A packet between two clients is
    an upload of one and a download of the other; one to itself is unknown.
    """
    ips = clients.select("experiment_id", "client_ip").distinct()
    ends = packets.withColumn(
        "client_ip",
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))),
    ).join(ips, ["experiment_id", "client_ip"])
    up, down = F.col("src_ip") == F.col("client_ip"), F.col("dst_ip") == F.col("client_ip")
    return ends.withColumn(
        "direction", F.when(up & ~down, "up").when(down & ~up, "down").otherwise("unknown")
    )


def safe_rows(packets: DataFrame, keys: Sequence[str] = TRACE, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Classifier-safe packets: addresses, ports and absolute time removed."""
    trace = sequence(packets, keys, ORDER, limit).key_stats({"_start": F.min("timestamp_epoch")})
    rows = trace.rows().withColumns(
        {
            "relative_time_sec": F.greatest(F.col("timestamp_epoch") - F.col("_start"), F.lit(0.0)),
            "tls_record_count": F.size("tls_record_lengths"),
            "tls_record_lengths": F.concat_ws(
                ";", F.transform("tls_record_lengths", lambda v: v.cast("string"))
            ),
        }
    )
    require_columns(rows, SAFE_COLUMNS, "packet table")
    return rows.select(*SAFE_COLUMNS)


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row per key: a ``min_by`` aggregate instead of a window over all copies."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")).select(
        *key, *[F.col(f"_first.{c}").alias(c) for c in keep]
    )


def dedupe_packets(packets: DataFrame) -> DataFrame:
    """Drop packets of a trace seen twice (overlapping captures): 8 identity columns, time to 1 µs."""
    key = [*TRACE, "_us", "frame_length", "src_ip", "dst_ip", "src_port", "dst_port", "transport_protocol", "tcp_flags_hex"]
    rest = [c for c in packets.columns if c not in key]
    timed = packets.withColumn("_us", F.floor(F.col("timestamp_epoch") * 1e6 + 0.5))
    return dedupe_first(timed, key, list(ORDER), rest).drop("_us").select(*packets.columns)


def trace_offsets(packets: DataFrame) -> DataFrame:
    """Start and end of each trace relative to its run's first packet."""
    traces = packets.groupBy(*TRACE).agg(
        F.min("timestamp_epoch").alias("_t0"), F.max("timestamp_epoch").alias("_t1")
    )
    runs = traces.groupBy("experiment_id").agg(F.min("_t0").alias("_c0"))
    return traces.join(runs, "experiment_id").select(
        *TRACE,
        (F.col("_t0") - F.col("_c0")).alias("trace_start_offset_sec"),
        (F.col("_t1") - F.col("_c0")).alias("trace_end_offset_sec"),
    )


def with_global_time(features: DataFrame, offsets: DataFrame) -> DataFrame:
    """Window bounds on the run's clock."""
    return features.join(offsets, list(TRACE)).withColumns(
        {
            "window_start_global_sec": F.col("trace_start_offset_sec") + F.col("window_start_sec"),
            "window_end_global_sec": F.col("trace_start_offset_sec") + F.col("window_end_sec"),
        }
    )


def chunk_global_index(packets: DataFrame, keys: Sequence[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Packet number over capture chunks and connections of a client, from 1 and without gaps."""
    parts = [*keys, "chunk_number", "connection_number"]
    rows = sequence(packets, parts, ORDER, limit).numbered("_local").rows()
    # Where each (chunk, connection) starts: one row per part, summed up in a client's chunk order.
    before = Window.partitionBy(*keys).orderBy("chunk_number", "connection_number")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = packets.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = null_safe_join(rows, starts, parts)
    return numbered.withColumn("global_index", F.col("_start") + F.col("_local")).drop("_start", "_local")


def stitch(packets: DataFrame, client: Sequence[str], connection: str, minimum: int = STITCH_MINIMUM_PACKETS) -> DataFrame:
    """Give all connections of a client one trace key; tiny clients are dropped."""
    summary = stitched_summary(packets, client, connection, minimum).select(*client, "stitched_alias")
    return packets.join(summary, list(client)).withColumn("client_capture_id", F.col("stitched_alias"))


def stitched_summary(packets: DataFrame, client: Sequence[str], connection: str, minimum: int) -> DataFrame:
    per_connection = packets.groupBy(*client, connection).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("timestamp_epoch").alias("t0"),
        F.max("timestamp_epoch").alias("t1"),
    )
    return (
        per_connection.groupBy(*client)
        .agg(
            F.concat(
                F.lit("stitched_"), F.concat_ws("_", F.array_sort(F.collect_list(connection)))
            ).alias("stitched_alias"),
            F.sum("n").alias("packet_count"),
            (F.max("t1") - F.min("t0")).alias("span_sec"),
        )
        .where(F.col("packet_count") >= minimum)
    )
