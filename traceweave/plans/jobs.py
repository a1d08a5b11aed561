"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators import audit, dataset, features, identity, isolate, rounds, sampling
from traceweave.operators.features import TRACE, WINDOW_SCALES
from traceweave.operators.ordered import DEFAULT_LIMIT
from traceweave.session import cut_lineage


def repaired_features(
    packets: DataFrame, clients: DataFrame, scales: Sequence[float] = WINDOW_SCALES, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Features per client of a capture that holds other traffic as well.

    Isolation, direction as each client sees it and flags from the mask are
    derived anew; nothing of the old derived columns is trusted.
    """
    own = isolate.per_client(packets, clients)
    own = X.with_flags(own).withColumn("tls_record_lengths", X.int_list("tls_text"))
    return features.feature_rows(own, scales, keys=["experiment_id", "client_ip"], limit=limit)


def canonical_traces(
    packets: DataFrame,
    chosen: DataFrame,
    chunk: str,
    scales: Sequence[float] = WINDOW_SCALES,
    limit: int = DEFAULT_LIMIT,
    **options,
) -> dict[str, DataFrame]:
    """One trace per client from capture chunks, and an audit row per client.

    ``chosen`` is the result of ``choose_connections``. Packets of a client's connections are united over chunks and
    connections, packets that overlapping chunks hold twice go, and features are derived from what is left. The audit
    has every chosen client, with the reason of the choice, its connections, chunks and packets (0 if none was seen).
    """
    side = chosen.select(
        F.col("run_id").alias("experiment_id"), "client_ip", "client_port", F.col("client_id").alias("alias")
    ).distinct()
    facing = isolate.connection_facing(packets, side).withColumn("direction", F.col("connection_direction"))
    united = facing.drop("client_id").withColumnRenamed("alias", "client_id")
    traces = isolate.dedupe_packets(united)
    # The client's end of a packet names its connection.
    up = F.col("direction") == "up"
    end = F.when(up, F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))).otherwise(
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    )
    seen = (
        traces.groupBy(*TRACE, end.alias("_end"), chunk)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*TRACE)
        .agg(
            F.sum("_n").alias("packet_count"),
            F.countDistinct("_end").alias("connections_seen"),
            F.countDistinct(chunk).alias("chunk_count"),
        )
    )
    wanted = chosen.groupBy(F.col("run_id").alias("experiment_id"), "client_id").agg(
        F.count(F.lit(1)).alias("connections_chosen"), F.min("reason").alias("reason")
    )
    counts = ("packet_count", "connections_seen", "chunk_count")
    report = wanted.join(seen, list(TRACE), "left").na.fill(0, list(counts))
    return {"features": features.feature_rows(traces, scales, limit=limit, **options), "audit": report}


def capture_features(
    packets: DataFrame,
    connections: DataFrame,
    scales: Sequence[float] = WINDOW_SCALES,
    limit: int = DEFAULT_LIMIT,
    **options,
) -> dict[str, DataFrame]:
    """All artifacts of a capture: safe packets, features on the run's clock, quality."""
    traced = isolate.connection_facing(packets, connections)
    traced = traced.drop("client_id").withColumnsRenamed({"alias": "client_id"}).withColumn(
        "direction", F.col("connection_direction")
    )
    offsets = isolate.trace_offsets(traced)
    rows = features.feature_rows(traced, scales, limit=limit, **options)
    return {
        "safe_packets": isolate.safe_rows(traced, limit=limit),
        "features": isolate.with_global_time(rows, offsets),
        "quality": audit.capture_quality(traced, TRACE),
    }


def fingerprint_dataset(
    feature_table: DataFrame,
    labels: DataFrame,
    fields: Sequence[str],
    run: str = "experiment_id",
    client: str = "client_id",
    limit: int = DEFAULT_LIMIT,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(X, Y, predictors): policy check, labels per client, row ids, then a split."""
    predictors = dataset.predictors_of([c for c in feature_table.columns if c != client], run)
    labelled = identity.with_labels(feature_table, labels, run, client, fields, strict=True)
    if "deployment" in labelled.columns:
        labelled = dataset.reject_local(labelled)
    order = ["window_size_sec", "window_index"]
    rows = dataset.with_row_id(labelled, [run, client], order, limit)
    numeric = [F.col(c).cast("double").alias(c) for c in predictors]
    metadata = [c for c in dataset.METADATA if c in rows.columns]
    return rows.select(*metadata, *numeric), rows.select("row_id", run, client, *fields), predictors


def round_dataset(
    packets: DataFrame,
    labels: DataFrame,
    fields: Sequence[str],
    cfg: rounds.RoundConfig | None = None,
    limit: int = DEFAULT_LIMIT,
    **options,
) -> dict[str, DataFrame]:
    """Inferred rounds, their feature rows and labels, and the diagnostics."""
    found, report = rounds.infer_rounds(packets, cfg, limit=limit)
    # Rounds and their rows are few, and read by many branches, each of which would plan and compute them again.
    found = cut_lineage(found)
    segments = found.select(*TRACE, F.col("inferred_round_index").alias("segment_index"), "start_epoch", "end_epoch")
    rows = cut_lineage(features.segment_features(packets, segments, "round", limit=limit, **options))
    x, y, _ = fingerprint_dataset(rows, labels, fields, limit=limit)
    return {"x": x, "y": y, "boundaries": found, "diagnostics": report}


def packet_budget_dataset(
    packets: DataFrame,
    budgets: Sequence[int] = features.PACKET_BUDGETS,
    cap: int = 0,
    seed: int = 42,
    limit: int = DEFAULT_LIMIT,
) -> dict[str, DataFrame]:
    """K=1 rows and exact-K blocks; a ``cap`` above 0 samples at most so many units per trace and K."""
    trace = features.number_packets(packets, limit=limit)
    size = F.col("trace_packets")
    out = {}
    if 1 in budgets:
        units = sampling.stratified_units(trace.df, trace.keys, "position", "trace_packets", cap, seed)
        out["single"] = features.single_packet_rows(type(trace)(units, trace.keys, trace.order, trace.sliced))
    larger = [int(k) for k in budgets if int(k) > 1]
    if larger:
        blocks = features.blocks_of(trace, larger)
        sizes = packets.groupBy(*TRACE).agg(F.count(F.lit(1)).alias("trace_packets"))
        units = blocks.join(sizes, list(TRACE)).withColumn(
            "_units", F.floor(size / F.col("packet_budget"))
        )
        keys = [*TRACE, "packet_budget"]
        out["blocks"] = sampling.stratified_units(units, keys, "block_index", "_units", cap, seed).drop(
            "_units", "trace_packets"
        )
    return out
