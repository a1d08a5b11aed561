"""Transfer rounds inferred from traffic direction, and their validation.

bins -> labels -> directional bursts -> major-transfer thresholds -> pairs of a
download and the upload that follows -> rounds with a confidence.  Endpoint
truth only ever validates the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.features import ORDER, TRACE
from traceweave.operators.joins import interval_join
from traceweave.operators.ordered import (
    DEFAULT_LIMIT,
    exact_quantiles,
    sequence,
)
from traceweave.operators.pairing import SEGMENT_ROWS, pair_transfers
from traceweave.session import cut_lineage


@dataclass(frozen=True)
class RoundConfig:
    bin_sec: float = 0.25
    direction_dominance: float = 0.65
    min_bin_bytes: int = 2048
    bridge_gap_sec: float = 0.75
    min_major_transfer_bytes: int = 4096
    min_training_gap_sec: float = 0.05
    max_round_sec: float = 3600.0
    max_transfer_size_ratio: float = 8.0
    min_round_packets: int = 20

    def __post_init__(self) -> None:
        if self.bin_sec <= 0:
            raise ValueError("bin_sec must be positive")
        if not 0.5 < self.direction_dominance <= 1.0:
            raise ValueError("direction_dominance must be in (0.5, 1]")

    @property
    def bridge_bins(self) -> int:
        return max(0, round(self.bridge_gap_sec / self.bin_sec))


# ---- fixed values -------------------------------------------------------
MIXED_DOMINANCE = 0.55
LOG_GAP = 0.55
#: Shares of a round's confidence: purity of both transfers, likeness of sizes, agreement with the medians, training gap.
DOWN_PURITY, UP_PURITY, LIKENESS, STEADINESS, TRAINING_GAP = 0.20, 0.20, 0.25, 0.20, 0.15
# -------------------------------------------------------------------------


def trace_bounds(packets: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    return packets.groupBy(*keys).agg(
        F.min("timestamp_epoch").alias("trace_start"),
        F.max("timestamp_epoch").alias("trace_end"),
        F.count(F.lit(1)).alias("trace_packets"),
    )


def packet_bins(
    packets: DataFrame,
    cfg: RoundConfig,
    keys: Sequence[str] = TRACE,
    limit: int = DEFAULT_LIMIT,
    least_packets: int = 0,
) -> DataFrame:
    """Byte and packet counts of every bin that has packets, with its label.

    ``edge_*`` count the packets exactly on the bin's lower border, which also
    belong to a span that ends there. Traces below ``least_packets`` have no bins.
    """
    trace = sequence(packets, keys, ORDER, limit)
    stats = {"trace_start": F.min("timestamp_epoch"), "trace_end": F.max("timestamp_epoch")}
    if least_packets:
        stats["trace_packets"] = F.count(F.lit(1))
    rows = trace.key_stats(stats).rows()
    if least_packets:
        rows = rows.where(F.col("trace_packets") >= least_packets)
    rel = F.greatest(F.col("timestamp_epoch") - F.col("trace_start"), F.lit(0.0))
    last = F.floor((F.col("trace_end") - F.col("trace_start")) / cfg.bin_sec)
    index = F.least(X.floor_divide(rel, cfg.bin_sec), last)
    rows = rows.withColumn("bin", index)
    on_edge = F.col("timestamp_epoch") == F.col("trace_start") + F.col("bin") * F.lit(float(cfg.bin_sec))
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    size = F.col("frame_length")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, size)), F.lit(0)).cast("long")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    bins = rows.groupBy(*keys, "bin").agg(
        total(up).alias("up_bytes"),
        total(down).alias("down_bytes"),
        total(~up & ~down).alias("unknown_bytes"),
        count(up).alias("up_packets"),
        count(down).alias("down_packets"),
        count(~up & ~down).alias("unknown_packets"),
        F.min("timestamp_epoch").alias("first_epoch"),
        F.max("timestamp_epoch").alias("last_epoch"),
        F.max("trace_start").alias("trace_start"),
        total(up & on_edge).alias("edge_up_bytes"),
        total(down & on_edge).alias("edge_down_bytes"),
        count(on_edge).alias("edge_packets"),
    )
    return bins.withColumn("label", bin_label(cfg))


def bin_label(cfg: RoundConfig) -> Column:
    up, down = F.col("up_bytes"), F.col("down_bytes")
    both = F.greatest(up + down, F.lit(1))
    return (
        F.when(up + down < cfg.min_bin_bytes, "quiet")
        .when(down / both >= cfg.direction_dominance, "down")
        .when(up / both >= cfg.direction_dominance, "up")
        .when(F.greatest(up, down) / both >= MIXED_DOMINANCE, F.when(down > up, "down").otherwise("up"))
        .otherwise("mixed")
    )


def _islands(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bin, label: single mixed bins between equal directions, with that direction.

    Only mixed bins look at their neighbours, by equi join on the bin number,
    so there is no per-trace order to keep. Bins are nearly as many as packets
    where these are sparse, so none of the sides is broadcast.
    """
    directed = bins.where("label in ('up', 'down')").select(*keys, "bin", F.col("label").alias("_near"))
    before = directed.select(*keys, (F.col("bin") + 1).alias("bin"), F.col("_near").alias("_before"))
    after = directed.select(*keys, (F.col("bin") - 1).alias("bin"), F.col("_near").alias("_after"))
    return (
        bins.where("label = 'mixed'")
        .select(*keys, "bin")
        .join(before.hint("merge"), [*keys, "bin"])
        .join(after.hint("merge"), [*keys, "bin"])
        .where("_before = _after")
        .select(*keys, "bin", F.col("_before").alias("label"))
    )


def smoothed(bins: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """All bins; a single mixed bin between equal directions takes their label."""
    islands = _islands(bins, keys).withColumnRenamed("label", "_new")
    return (
        bins.join(islands, [*keys, "bin"], "left")
        .withColumn("label", F.coalesce("_new", "label"))
        .drop("_new")
    )


def directed_bins(bins: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    """keys, bin, label of the bins that have a direction once smoothed; the others need not be joined for that."""
    directed = bins.where("label in ('up', 'down')").select(*keys, "bin", "label")
    return directed.unionByName(_islands(bins, keys))


def dense_bins(packets: DataFrame, cfg: RoundConfig, keys: Sequence[str] = TRACE) -> DataFrame:
    """Every bin of every trace with raw and smoothed label; silent bins are quiet."""
    bins = packet_bins(packets, cfg, keys)
    labels = smoothed(bins, keys).select(*keys, "bin", F.col("label").alias("clean_label"))
    grid = trace_bounds(packets, keys).select(
        *keys,
        F.explode(
            F.sequence(
                F.lit(0).cast("long"), F.floor((F.col("trace_end") - F.col("trace_start")) / cfg.bin_sec)
            )
        ).alias("bin"),
    )
    counts = ["up_bytes", "down_bytes", "unknown_bytes", "up_packets", "down_packets", "unknown_packets"]
    full = grid.join(bins.select(*keys, "bin", *counts, "label"), [*keys, "bin"], "left").join(
        labels, [*keys, "bin"], "left"
    )
    return full.fillna(0, counts).fillna("quiet", ["label", "clean_label"])


def directional_bursts(
    bins: DataFrame, cfg: RoundConfig, keys: Sequence[str] = TRACE, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Runs of equal-direction bins, bridged over short gaps without the other direction.

    ``bins`` are those of `packet_bins`; they are smoothed here. In the order of
    directed bins a bin joins its predecessor exactly when that has the same
    direction and is near enough.
    """
    bins = cut_lineage(bins)  # read often below
    order = sequence(directed_bins(bins, keys), keys, ["bin"], limit).previous(
        {"_p": F.struct(F.col("bin").alias("b"), F.col("label").alias("l"))}
    )
    starts = (
        F.col("_p").isNull()
        | (F.col("_p.l") != F.col("label"))
        | (F.col("bin") - F.col("_p.b") - 1 > cfg.bridge_bins)
    )
    order = order.with_columns({"_new": starts.cast("long")}).running_sum({"span": F.col("_new")})
    spans = order.rows().groupBy(*keys, "span").agg(
        F.first("label").alias("direction"), F.min("bin").alias("_first"), F.max("bin").alias("_last")
    )
    # A span is closed at both ends: packets on the border after its last bin count.
    touched = spans.select(
        *keys, "span", "direction", "_last", F.explode(F.sequence(F.col("_first"), F.col("_last") + 1)).alias("bin")
    )
    edge = F.col("bin") > F.col("_last")
    parts = touched.join(bins.drop("label").hint("merge"), [*keys, "bin"]).where(~edge | (F.col("edge_packets") > 0))

    def pick(inside: str, border: str) -> Column:
        return F.sum(F.when(edge, F.col(border)).otherwise(F.col(inside)))

    border_time = F.col("trace_start") + F.col("bin") * F.lit(float(cfg.bin_sec))
    packets = F.col("up_packets") + F.col("down_packets") + F.col("unknown_packets")
    bursts = parts.withColumn("_packets", packets).groupBy(*keys, "span", "direction").agg(
        F.min("first_epoch").alias("start_epoch"),
        F.max(F.when(edge, border_time).otherwise(F.col("last_epoch"))).alias("end_epoch"),
        pick("up_bytes", "edge_up_bytes").alias("bytes_up"),
        pick("down_bytes", "edge_down_bytes").alias("bytes_down"),
        pick("_packets", "edge_packets").alias("packet_count"),
    )
    dominant = F.when(F.col("direction") == "down", F.col("bytes_down")).otherwise(F.col("bytes_up"))
    return bursts.withColumns(
        {
            "dominant_bytes": dominant,
            "purity": X.safe_divide(dominant, F.col("bytes_up") + F.col("bytes_down")),
        }
    )


def major_thresholds(
    bursts: DataFrame, cfg: RoundConfig, keys: Sequence[str] = TRACE, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Smallest burst that counts as a model transfer, per trace and direction.

    Medians are read off by rank, the split is the widest gap of log sizes
    (the earliest of equal gaps).
    """
    scope = [*keys, "direction"]
    sized = bursts.where("dominant_bytes > 0").select(*scope, "span", F.col("dominant_bytes").cast("double").alias("v"))
    ranked = sequence(sized, scope, ["v", "span"], limit).numbered("i").previous({"_low": F.col("v")})
    rows = ranked.key_stats({"n": F.count(F.lit(1))}).rows()
    gap = F.log10(F.greatest(F.col("v"), F.lit(1.0))) - F.log10(F.greatest(F.col("_low"), F.lit(1.0)))
    rows = rows.withColumn("_gap", F.when(F.col("_low").isNotNull(), gap))
    n, i = F.col("n"), F.col("i")
    half = F.floor(n / 2)
    rest = n - half

    def at(rank: Column) -> Column:
        return F.max(F.when(i == rank, F.col("v")))

    table = rows.groupBy(*scope).agg(
        F.max("n").alias("n"),
        ((at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2).alias("_median"),
        ((at(half + F.floor((rest + 1) / 2)) + at(half + F.ceil((rest + 1) / 2))) / 2).alias("_upper"),
        F.max_by(F.struct("_gap", "_low", "v", "i"), F.when(F.col("_gap").isNotNull(), F.struct("_gap", -F.col("i")))).alias("_s"),
    )
    above = F.col("n") - F.col("_s.i") + 1
    split = (F.col("_s._gap") >= LOG_GAP) & (above >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.10)))
    floor = F.lit(max(1.0, float(cfg.min_major_transfer_bytes)))
    typical = (
        F.when(F.col("n") < 4, 0.5 * F.col("_median"))
        .when(split, F.sqrt(F.col("_s._low") * F.col("_s.v")))
        .otherwise(0.25 * F.col("_upper"))
    )
    return table.select(*scope, F.greatest(floor, typical).alias("threshold_bytes"), F.col("n").alias("burst_count"))


def major_bursts(bursts: DataFrame, thresholds: DataFrame, keys: Sequence[str] = TRACE) -> DataFrame:
    scope = [*keys, "direction"]
    return bursts.join(thresholds.select(*scope, "threshold_bytes"), scope).where(
        F.col("dominant_bytes") >= F.col("threshold_bytes")
    )


def infer_rounds(
    packets: DataFrame,
    cfg: RoundConfig | None = None,
    keys: Sequence[str] = TRACE,
    limit: int = DEFAULT_LIMIT,
    segment_rows: int = SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(rounds, diagnostics) of every trace, from traffic alone."""
    cfg = cfg or RoundConfig()
    keys = list(keys)
    sizes = trace_bounds(packets, keys)
    bins = packet_bins(packets, cfg, keys, limit, cfg.min_round_packets)
    bursts = cut_lineage(directional_bursts(bins, cfg, keys, limit))
    thresholds = major_thresholds(bursts, cfg, keys, limit)
    major = major_bursts(bursts, thresholds, keys)
    pairs = cut_lineage(pair_transfers(major, cfg.max_round_sec, cfg.max_transfer_size_ratio, keys, segment_rows, limit))
    medians = exact_quantiles(pairs, keys, "down_dominant_bytes", [0.5], ["median_download_bytes"], limit).join(
        exact_quantiles(pairs, keys, "up_dominant_bytes", [0.5], ["median_upload_bytes"], limit), keys
    )
    spans = pairs.withColumns({"start_epoch": F.col("down_start_epoch"), "end_epoch": F.col("up_end_epoch")})
    inside = interval_join(
        packets.select(*keys, "timestamp_epoch"),
        spans.select(*keys, "start_epoch", "end_epoch"),
        keys,
        "timestamp_epoch",
        "start_epoch",
        "end_epoch",
    )
    counts = inside.groupBy(*keys, "start_epoch", "end_epoch").agg(F.count(F.lit(1)).alias("packet_count"))
    scored = (
        spans.join(counts, [*keys, "start_epoch", "end_epoch"])
        .where(F.col("packet_count") >= cfg.min_round_packets)
        .join(medians, keys)
        .withColumn("confidence", confidence(cfg))
    )
    scored = cut_lineage(scored)  # ordering them plans twice, and each time would look for the packets inside again
    rounds = sequence(scored, keys, ["start_epoch", "end_epoch"], limit).numbered("_n").rows()
    rounds = rounds.select(
        *keys,
        (F.col("_n") - 1).alias("inferred_round_index"),
        "start_epoch",
        "end_epoch",
        F.col("down_start_epoch").alias("download_start_epoch"),
        F.col("down_end_epoch").alias("download_end_epoch"),
        F.col("up_start_epoch").alias("upload_start_epoch"),
        F.col("up_end_epoch").alias("upload_end_epoch"),
        F.col("down_dominant_bytes").cast("long").alias("download_bytes"),
        F.col("up_dominant_bytes").cast("long").alias("upload_bytes"),
        "packet_count",
        "confidence",
    )
    return rounds, diagnostics(sizes, bursts, thresholds, major, pairs, rounds, medians, cfg, keys)


def confidence(cfg: RoundConfig) -> Column:
    """Purity, size likeness, agreement with the trace's medians and a training gap."""
    down, up = (F.greatest(F.col(f"{s}_dominant_bytes"), F.lit(1.0)) for s in ("down", "up"))

    def alike(a: Column, b: Column) -> Column:
        return F.exp(-F.abs(F.log(a / b)))

    steady = (
        alike(down, F.greatest(F.col("median_download_bytes"), F.lit(1.0)))
        + alike(up, F.greatest(F.col("median_upload_bytes"), F.lit(1.0)))
    ) / 2.0
    gap = F.greatest(F.col("up_start_epoch") - F.col("down_end_epoch"), F.lit(0.0))
    rest = F.when(gap >= cfg.min_training_gap_sec, F.lit(1.0)).otherwise(gap / max(cfg.min_training_gap_sec, 1e-9))
    total = (
        DOWN_PURITY * F.col("down_purity")
        + UP_PURITY * F.col("up_purity")
        + LIKENESS * alike(up, down)
        + STEADINESS * steady
        + TRAINING_GAP * rest
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def diagnostics(sizes, bursts, thresholds, major, pairs, rounds, medians, cfg: RoundConfig, keys: Sequence[str]) -> DataFrame:
    """One status row per trace."""
    keys = list(keys)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    limits = thresholds.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("direction") == d, F.col("threshold_bytes"))).alias(f"{d}_threshold_bytes")
            for d in ("down", "up")
        ]
    )
    found = rounds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("inferred_round_count"), F.avg("confidence").alias("mean_confidence")
    )
    table = sizes.select(*keys, F.col("trace_packets").alias("packet_count"))
    for part in (counted(bursts, "burst_count"), counted(major, "major_burst_count"), limits, counted(pairs, "_pairs"), medians, found):
        table = table.join(part, keys, "left")
    table = table.fillna(0, ["burst_count", "major_burst_count", "_pairs", "inferred_round_count", "mean_confidence"])
    floor = max(1.0, float(cfg.min_major_transfer_bytes))
    table = table.fillna(floor, ["down_threshold_bytes", "up_threshold_bytes"])
    status = (
        F.when(F.col("packet_count") < cfg.min_round_packets, "insufficient_packets")
        .when(F.col("_pairs") == 0, "no_round_pairs")
        .when(F.col("inferred_round_count") == 0, "no_usable_rounds")
        .otherwise("ok")
    )
    return table.withColumn("status", status).drop("_pairs")


# ---- truth and validation -----------------------------------------------------


def phase_rounds(events: DataFrame, keys: Sequence[str], sequence_column: str) -> DataFrame:
    """Truth rounds from phase-end events; the last event of a phase counts.

    ``events``: keys, round, event, phase, timestamp_epoch, phase_time_ms and
    round_start_epoch/round_end_epoch of explicit boundary events, which win.
    """
    scope = [*keys, "round"]
    end, start = X.finite(F.col("timestamp_epoch")), X.phase_start("timestamp_epoch", "phase_time_ms")
    columns = []
    for phase in ("download", "training", "upload"):
        mine = (F.col("event") == "federated_phase") & (F.lower(F.trim("phase")) == phase)
        order = F.when(mine, F.col(sequence_column))
        columns.append(F.max_by(F.struct(start.alias("s"), end.alias("e")), order).alias(f"_{phase}"))
    a, b = X.finite(F.col("round_start_epoch")), X.finite(F.col("round_end_epoch"))
    valid = (F.col("event") == "round_boundary_ground_truth") & (b > a)
    columns.append(F.max_by(F.struct(a.alias("s"), b.alias("e")), F.when(valid, F.col(sequence_column))).alias("_explicit"))
    table = events.groupBy(*scope).agg(*columns)
    starts, ends = ([F.col(f"_{p}.{x}") for p in ("download", "training", "upload")] for x in "se")
    return table.select(
        *scope,
        F.coalesce(F.col("_explicit.s"), F.least(*starts)).alias("start_epoch"),
        F.coalesce(F.col("_explicit.e"), F.greatest(*ends)).alias("end_epoch"),
        *[
            F.col(f"_{p}.{x}").alias(f"{p}_{name}_epoch")
            for p in ("download", "training", "upload")
            for x, name in (("s", "start"), ("e", "end"))
        ],
    ).where("end_epoch > start_epoch")
