"""Trace features: windows, whole traces, rounds and exact-K packet blocks.

One set of aggregate expressions serves every grouping.  Inter-arrival times,
direction switches and bursts are derived once per trace; a group (a window, a
block, a round) only keeps those whose predecessor lies in the same group, so
they restart at every group boundary without another window pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import (
    DEFAULT_LIMIT,
    Sequenced,
    exact_quantiles,
    salted_attach,
    sequence,
)
from traceweave.session import cut_lineage

TRACE = ("experiment_id", "client_id")
ORDER = ("timestamp_epoch", "packet_index")
WINDOW_SCALES = (0.5, 1.0, 2.0, 5.0)
PACKET_BUDGETS = (1, 5, 10, 25, 50, 100, 250, 500)
QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p90": 0.90, "p95": 0.95}
#: Empty windows that one generated row stands for before it is spread out.
GAP_WINDOWS = 10_000
GROUP = ("window_size_sec", "window_index")
#: The scale number of the whole trace.
WHOLE = -1


def connection_of(df: DataFrame) -> Column:
    return F.when(
        (X.text("src_ip") != "") & (X.text("dst_ip") != ""), X.connection_key()
    )


def sequence_packets(
    packets: DataFrame,
    burst_gap_sec: float = 0.05,
    keys: Sequence[str] = TRACE,
    limit: int = DEFAULT_LIMIT,
) -> Sequenced:
    """Packets with their predecessor, burst number and trace bounds.

    Adds ``prev_t``, ``prev_known`` (time and direction of the last packet with
    a known direction), ``burst_id``, ``trace_start`` and ``trace_end``.
    """
    trace = sequence(packets, keys, ORDER, limit)
    known = F.when(
        F.col("direction").isin("up", "down"),
        F.struct(F.col("timestamp_epoch").alias("t"), F.col("direction").alias("d")),
    )
    trace = trace.previous(
        {
            "_prev": F.struct(F.col("timestamp_epoch").alias("t"), F.col("direction").alias("d")),
            "prev_known": known,
        }
    )
    gap = F.greatest(F.col("timestamp_epoch") - F.col("_prev.t"), F.lit(0.0))
    starts = (
        F.col("_prev").isNull() | (F.col("_prev.d") != F.col("direction")) | (gap > F.lit(float(burst_gap_sec)))
    )
    trace = trace.with_columns({"starts_burst": starts.cast("long")})
    trace = trace.running_sum({"burst_id": F.col("starts_burst")})
    trace = trace.key_stats(
        {"trace_start": F.min("timestamp_epoch"), "trace_end": F.max("timestamp_epoch")}
    )
    trace = trace.with_columns({"prev_t": F.col("_prev.t")})
    df = trace.df.drop("_prev")
    if trace.sliced:
        df = cut_lineage(df)
    return Sequenced(df, trace.keys, trace.order, trace.sliced)


def read_often(trace: Sequenced) -> Sequenced:
    """Checkpoint a trace that several blocks read, each with its own columns.

    Otherwise every block would scan, shuffle and sort the packets again.
    """
    if trace.sliced:  # already done while sequencing
        return trace
    return Sequenced(cut_lineage(trace.df), trace.keys, trace.order, trace.sliced)


def gap_before() -> Column:
    """Time since the previous packet of the trace, null for its first packet."""
    gap = F.col("timestamp_epoch") - F.col("prev_t")
    return F.when(gap < 0, F.lit(0.0)).otherwise(gap)


def window_count(duration: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.greatest(F.lit(1).cast("long"), F.ceil(duration / scale))


def window_index(t: Column, scale: Column) -> Column:
    """Window of a time relative to the trace start; the end point joins the last window."""
    relative = F.greatest(t - F.col("trace_start"), F.lit(0.0))
    duration = F.greatest(F.col("trace_end") - F.col("trace_start"), F.lit(0.0))
    index = F.least(X.floor_divide(relative, scale), window_count(duration, scale) - 1)
    return F.when(t.isNotNull(), index)


def _measures() -> dict[str, Column]:
    """Columns a packet contributes to its group (null on marker rows)."""
    tls = F.transform(F.col("tls_record_lengths"), lambda v: v.cast("double"))
    return {
        "t": F.col("timestamp_epoch"),
        "len": F.col("frame_length").cast("double"),
        "dir": F.col("direction"),
        "burst_id": F.col("burst_id"),
        "new_burst": F.col("starts_burst"),
        "transport": F.col("transport_protocol"),
        "syn": F.col("tcp_syn"),
        "ack": F.col("tcp_ack"),
        "fin": F.col("tcp_fin"),
        "rst": F.col("tcp_rst"),
        "retr": F.col("retransmission"),
        "tls_n": F.size("tls_record_lengths").cast("long"),
        "tls_sum": X.array_sum(tls),
        "tls_sq": X.array_sum(F.transform(tls, lambda v: v * v)),
        "tls_min": F.array_min(tls),
        "tls_max": F.array_max(tls),
        "tls_list": tls,
        "conn": F.col("conn"),
    }


def measured_packets(trace: Sequenced, scales: Sequence[float]) -> Sequenced:
    """What each packet brings to its groups, and its windows, its predecessor's and those of the last known direction.

    All of it is worked out once per packet, before packets become a row per scale.
    """
    df = trace.df.withColumn("conn", connection_of(trace.df))
    measures = _measures()
    del measures["tls_list"]
    times = {"_own": F.col("timestamp_epoch"), "_prior": F.col("prev_t"), "_known": F.col("prev_known.t")}
    windows = [
        window_index(t, F.lit(float(s))).cast("long").alias(f"{name}{i}")
        for name, t in times.items()
        for i, s in enumerate(scales)
    ]
    narrow = df.select(
        *trace.parts,
        "trace_start",
        "trace_end",
        gap_before().alias("_gap"),
        F.when(F.col("prev_known.t").isNotNull(), F.col("prev_known.d")).alias("_known_dir"),
        *[c.alias(n) for n, c in measures.items()],
        *windows,
    )
    return Sequenced(narrow, trace.keys, trace.order, trace.sliced)


def windowed_rows(packets: DataFrame, keys: Sequence[str], scales: Sequence[float], dense: bool) -> DataFrame:
    """One row per packet of `measured_packets` and grouping (whole trace, ``scale`` -1, plus every scale's number).

    With ``dense`` each packet also emits one empty marker per window between its
    predecessor's window and its own, so windows without packets appear without
    a join and without a list of all windows of a trace.
    """
    measures = [n for n in _measures() if n in packets.columns]
    prior = F.col("_gap").isNotNull()

    def entry(scale: int, index: Column, same: Column, same_known: Column) -> Column:
        return F.struct(
            F.lit(scale).alias("scale"),
            index.cast("long").alias("index"),
            index.cast("long").alias("last"),
            F.coalesce(same, F.lit(False)).alias("same"),
            F.coalesce(same_known, F.lit(False)).alias("same_known"),
            F.lit(True).alias("packet"),
        )

    whole = entry(WHOLE, F.lit(-1), prior, F.col("_known_dir").isNotNull())
    numbered = range(len(scales))
    entries = F.array(
        whole,
        *[
            entry(i, F.col(f"_own{i}"), F.col(f"_prior{i}") == F.col(f"_own{i}"), F.col(f"_known{i}") == F.col(f"_own{i}"))
            for i in numbered
        ],
    )
    dense = dense and len(scales) > 0
    if dense:
        gaps = F.concat(*[empty_runs(F.col(f"_prior{i}"), F.col(f"_own{i}"), i) for i in numbered])
        entries = F.when(~prior, entries).otherwise(F.concat(entries, gaps))
    exploded = packets.select(
        *keys, "trace_start", "trace_end", "_gap", "_known_dir", *measures, F.explode(entries).alias("g")
    )
    index = F.col("g.index")
    if dense:
        exploded = exploded.select("*", F.explode(F.sequence("g.index", "g.last")).alias("_index"))
        index = F.col("_index")
    return exploded.select(
        *keys,
        F.col("g.scale").alias("scale"),
        index.alias("window_index"),
        "trace_start",
        "trace_end",
        *[F.when(F.col("g.packet"), F.col(n)).alias(n) for n in measures],
        F.when(F.col("g.packet") & F.col("g.same"), F.col("_gap")).alias("iat"),
        F.when(
            F.col("g.packet") & F.col("g.same_known") & F.col("dir").isin("up", "down"),
            (F.col("dir") != F.col("_known_dir")).cast("long"),
        ).alias("switched"),
    )


def empty_runs(before: Column, own: Column, scale: float | int) -> Column:
    """The windows strictly between two packets' windows, as runs of at most GAP_WINDOWS."""
    low, high = before + 1, own - 1
    runs = F.transform(
        F.sequence(low, F.greatest(low, high), F.lit(GAP_WINDOWS).cast("long")),
        lambda i: F.struct(
            F.lit(scale).alias("scale"),
            i.alias("index"),
            F.least(i + GAP_WINDOWS - 1, high).alias("last"),
            F.lit(False).alias("same"),
            F.lit(False).alias("same_known"),
            F.lit(False).alias("packet"),
        ),
    )
    return F.when(low <= high, runs).otherwise(F.slice(_no_runs(scale), 1, 0))


def _no_runs(scale: float | int) -> Column:
    zero_ = F.lit(0).cast("long")
    return F.array(
        F.struct(
            F.lit(scale).alias("scale"),
            zero_.alias("index"),
            zero_.alias("last"),
            F.lit(False).alias("same"),
            F.lit(False).alias("same_known"),
            F.lit(False).alias("packet"),
        )
    )


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def four(prefix: str, value: Column) -> dict[str, Column]:
    return {
        # sum/count instead of avg: the planner then shares them with the totals,
        # which keeps the aggregate narrow enough for generated code.
        f"{prefix}_mean": zero(F.sum(value) / F.count(value)),
        f"{prefix}_std": zero(F.stddev_pop(value)),
        f"{prefix}_min": zero(F.min(value)),
        f"{prefix}_max": zero(F.max(value)),
    }


def moments(prefix: str, value: Column) -> dict[str, Column]:
    """Population skewness and excess kurtosis, 0 for short or constant input."""
    count, spread = F.count(value), F.stddev_pop(value)
    return {
        f"{prefix}_skewness": F.when((count >= 3) & (spread > 0), zero(F.skewness(value))).otherwise(F.lit(0.0)),
        f"{prefix}_kurtosis": F.when((count >= 4) & (spread > 0), zero(F.kurtosis(value))).otherwise(F.lit(0.0)),
    }


def quantile_columns(prefix: str, value: Column) -> dict[str, Column]:
    """All quantiles of one value from a single exact percentile state."""
    cut = F.percentile(value, F.array(*[F.lit(p) for p in QUANTILES.values()]))
    return {f"{prefix}_{n}": zero(cut[i]) for i, n in enumerate(QUANTILES)}


def pooled(prefix: str, n: Column, total: Column, squares: Column, low: Column, high: Column) -> dict[str, Column]:
    """Four statistics of exploded arrays from per-row sums."""
    count = F.sum(n).cast("double")
    mean = F.sum(total) / count
    spread = F.sqrt(F.greatest(F.sum(squares) / count - mean * mean, F.lit(0.0)))
    some = count > 0
    return {
        f"{prefix}_mean": F.when(some, mean).otherwise(F.lit(0.0)),
        f"{prefix}_std": F.when(some, spread).otherwise(F.lit(0.0)),
        f"{prefix}_min": zero(F.min(low)),
        f"{prefix}_max": zero(F.max(high)),
    }


def _when_sum(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("long")


def group_aggregates(idle_threshold_sec: float) -> dict[str, Column]:
    """Everything about a group that one pass over its rows can tell."""
    length, iat, direction = F.col("len"), F.col("iat"), F.col("dir")
    up, down = direction == "up", direction == "down"
    idle = F.when(iat > float(idle_threshold_sec), iat)
    first_of_burst = F.col("iat").isNotNull() & (F.col("new_burst") == 1)
    out: dict[str, Column] = {
        "packet_count_total": F.count(length),
        "packet_count_up": F.count(F.when(up, length)),
        "packet_count_down": F.count(F.when(down, length)),
        "packet_count_unknown": F.count(F.when(direction == "unknown", length)),
        "bytes_total": F.coalesce(F.sum(length), F.lit(0)).cast("long"),
        "bytes_up": _when_sum(up, length),
        "bytes_down": _when_sum(down, length),
        "_span": zero(F.max("t") - F.min("t")),
        "direction_switch_count": F.coalesce(F.sum("switched"), F.lit(0)).cast("long"),
        "idle_gap_count": F.count(idle),
        "idle_time_total_sec": zero(F.sum(idle)),
        "idle_time_mean_sec": zero(F.sum(idle) / F.count(idle)),
        "idle_time_max_sec": zero(F.max(idle)),
        "tcp_packet_count": F.count(F.when(F.col("transport") == "TCP", 1)),
        "udp_packet_count": F.count(F.when(F.col("transport") == "UDP", 1)),
        "tcp_syn_count": F.coalesce(F.sum("syn"), F.lit(0)).cast("long"),
        "tcp_ack_count": F.coalesce(F.sum("ack"), F.lit(0)).cast("long"),
        "tcp_fin_count": F.coalesce(F.sum("fin"), F.lit(0)).cast("long"),
        "tcp_rst_count": F.coalesce(F.sum("rst"), F.lit(0)).cast("long"),
        "tcp_retransmission_count": F.coalesce(F.sum("retr"), F.lit(0)).cast("long"),
        "tls_record_count": F.coalesce(F.sum("tls_n"), F.lit(0)).cast("long"),
        **four("packet_size", length),
        **moments("packet_size", length),
        **four("upload_packet_size", F.when(up, length)),
        **four("download_packet_size", F.when(down, length)),
        **four("iat_sec", iat),
        **moments("iat_sec", iat),
        **four("burst_interval_sec", F.when(first_of_burst, iat)),
        **pooled("tls_record_size", F.col("tls_n"), F.col("tls_sum"), F.col("tls_sq"), F.col("tls_min"), F.col("tls_max")),
    }
    return out


def bursts_in_groups(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per burst of a group: a trace burst cut at the group's borders."""
    return (
        rows.where(F.col("len").isNotNull())
        .groupBy(*group, "burst_id")
        .agg(
            F.first("dir").alias("direction"),
            F.min("t").alias("start_epoch"),
            F.max("t").alias("end_epoch"),
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("len").cast("long").alias("byte_count"),
        )
    )


def burst_block(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    bursts = bursts_in_groups(rows, group)
    return bursts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("burst_count_total"),
        F.count(F.when(F.col("direction") == "up", 1)).alias("burst_count_up"),
        F.count(F.when(F.col("direction") == "down", 1)).alias("burst_count_down"),
        *[
            c.alias(n)
            for n, c in (
                four("burst_bytes", F.col("byte_count").cast("double"))
                | four("burst_packets", F.col("packet_count").cast("double"))
                | four("burst_duration_sec", F.col("end_epoch") - F.col("start_epoch"))
            ).items()
        ],
    )


def connection_block(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct connections in two aggregations, none of which holds a set."""
    return (
        rows.where(F.col("conn").isNotNull())
        .groupBy(*group, "conn")
        .agg(F.lit(1).alias("_one"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("connection_count"))
    )


def entropy_of(
    df: DataFrame,
    group: Sequence[str],
    values: Mapping[str, Column],
    skewed: bool = False,
) -> DataFrame:
    """Histogram entropy in bits of several values per group.

    Between 4 and 32 equal-width bins (the square root of the count); the
    largest value falls in the last bin.  One value or one distinct value is 0.
    """
    long = df.select(
        *group,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("x")) for n, v in values.items()])
        ).alias("m"),
    ).select(*group, F.col("m.metric").alias("metric"), F.col("m.x").alias("x")).where(F.col("x").isNotNull())
    keys = [*group, "metric"]
    if skewed:
        long = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("w"))
        stats = long.groupBy(*keys).agg(
            F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("n")
        )
        sized = salted_attach(long, stats, keys, F.col("x"), how="inner")
    else:
        whole = Window.partitionBy(*keys)
        sized = long.withColumns(
            {
                "w": F.lit(1).cast("long"),
                "lo": F.min("x").over(whole),
                "hi": F.max("x").over(whole),
                "n": F.count("x").over(whole),
            }
        )
    bins = F.least(F.lit(32.0), F.greatest(F.lit(4.0), F.floor(F.sqrt("n")))).cast("double")
    position = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    cells = (
        sized.where(F.col("hi") > F.col("lo"))
        .groupBy(*keys, F.least(position, bins - 1).alias("bin"))
        .agg(F.sum("w").alias("c"), F.max("n").alias("n"))
    )
    p = F.col("c") / F.col("n")
    return cells.groupBy(*group).agg(
        *[
            F.coalesce(-F.sum(F.when(F.col("metric") == n, p * F.log2(p))), F.lit(0.0)).alias(n)
            for n in values
        ]
    )


def distributions(df: DataFrame, group: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Quantiles and histogram entropy of several values from one sorted pass.

    Ranks come from the sort, so no group needs a percentile state, and the
    same order serves the group's size and bounds.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("m"), v.cast("double").alias("x")) for n, v in values.items()])
    long = df.select(*group, F.explode(pairs).alias("p")).select(*group, "p.m", "p.x").where(F.col("x").isNotNull())
    keys = [*group, "m"]
    whole = Window.partitionBy(*keys)
    ranked = long.withColumn("i", F.row_number().over(whole.orderBy("x")) - 1)
    sized = ranked.withColumns(
        {"lo": F.min("x").over(whole), "hi": F.max("x").over(whole), "n": F.count("x").over(whole)}
    )
    bins = F.least(F.lit(32.0), F.greatest(F.lit(4.0), F.floor(F.sqrt("n")))).cast("double")
    position = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1)
    picks = []
    for name, p in QUANTILES.items():
        rank = F.lit(p) * (F.col("n") - 1)
        picks.append(F.max(F.when(F.col("i") == F.floor(rank), F.col("x"))).alias(f"l_{name}"))
        picks.append(F.max(F.when(F.col("i") == F.ceil(rank), F.col("x"))).alias(f"h_{name}"))
    cells = (
        sized.withColumn("bin", F.when(F.col("hi") > F.col("lo"), position).otherwise(F.lit(0.0)))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), *picks)
    )
    share = F.col("c") / F.col("n")
    out = []
    for metric in values:
        mine = F.col("m") == metric
        out.append(F.coalesce(-F.sum(F.when(mine, share * F.log2(share))), F.lit(0.0)).alias(f"{metric}_entropy"))
        n = F.max(F.when(mine, F.col("n")))
        for name, p in QUANTILES.items():
            rank = F.lit(p) * (n - 1)
            low, high = (F.max(F.when(mine, F.col(f"{side}_{name}"))) for side in "lh")
            out.append(zero(low + (high - low) * (rank - F.floor(rank))).alias(f"{metric}_{name}"))
    return cells.groupBy(*group).agg(*out)


def _assemble(
    rows: DataFrame,
    group: Sequence[str],
    idle_threshold_sec: float,
    skewed: bool,
    limit: int,
    extra: Sequence[Column] = (),
    inner: DataFrame | None = None,
) -> DataFrame:
    """Join the blocks of one grouping; every block has one row per group.

    ``inner``: the rows without markers of empty groups, where ``rows`` has such.
    """
    main = rows.groupBy(*group).agg(*extra, *[c.alias(n) for n, c in group_aggregates(idle_threshold_sec).items()])
    measured = {"packet_size": "len", "iat_sec": "iat"}
    rows = rows if inner is None else inner
    parts = [burst_block(rows, group), connection_block(rows, group)]
    if skewed:
        parts.append(
            entropy_of(rows, group, {f"{n}_entropy": F.col(c) for n, c in measured.items()}, skewed=True)
        )
        for prefix, value in measured.items():
            names = [f"{prefix}_{n}" for n in QUANTILES]
            parts.append(exact_quantiles(rows, group, value, list(QUANTILES.values()), names, limit))
    else:
        parts.append(distributions(rows, group, {n: F.col(c) for n, c in measured.items()}))
    for part in parts:
        fresh = [c for c in part.columns if c not in group]
        # There is a row per group on both sides: more than a broadcast should hold, whatever the files' size promises.
        main = main.join(part.hint("merge"), list(group), "left").fillna(0, fresh)
    return main


PREDICTORS = (
    "packet_count_total packet_count_up packet_count_down packet_count_unknown bytes_total bytes_up bytes_down "
    "bytes_unknown duration_sec upload_download_packet_ratio upload_download_byte_ratio upload_packet_fraction "
    "download_packet_fraction upload_byte_fraction download_byte_fraction packets_per_second bytes_per_second "
    "upload_packets_per_second download_packets_per_second upload_bytes_per_second download_bytes_per_second "
    "direction_switch_count direction_switch_rate burst_count_total burst_count_up burst_count_down "
    "burst_frequency_per_second idle_gap_count idle_time_total_sec idle_time_mean_sec idle_time_max_sec "
    "tcp_packet_count udp_packet_count tcp_syn_count tcp_ack_count tcp_fin_count tcp_rst_count "
    "tcp_retransmission_count tls_record_count connection_count"
).split() + [
    f"{prefix}_{stat}"
    for prefix, stats in (
        ("packet_size", "mean median std min max q25 q75 p90 p95 entropy skewness kurtosis"),
        ("upload_packet_size", "mean std min max"),
        ("download_packet_size", "mean std min max"),
        ("iat_sec", "mean median std min max q25 q75 p90 p95 entropy skewness kurtosis"),
        ("burst_bytes", "mean std min max"),
        ("burst_packets", "mean std min max"),
        ("burst_duration_sec", "mean std min max"),
        ("burst_interval_sec", "mean std min max"),
        ("tls_record_size", "mean std min max"),
    )
    for stat in stats.split()
]
ROW_METADATA = [
    "row_type",
    "window_index",
    "window_start_sec",
    "window_end_sec",
    "window_size_sec",
    "packet_information_threshold",
    "packet_information_ok",
]


def derived_columns(duration: Column, threshold: int) -> dict[str, Column]:
    c = F.col
    unknown_bytes = c("bytes_total") - c("bytes_up") - c("bytes_down")
    out = {
        "bytes_unknown": unknown_bytes,
        "duration_sec": duration,
        "upload_download_packet_ratio": X.safe_divide(c("packet_count_up"), c("packet_count_down")),
        "upload_download_byte_ratio": X.safe_divide(c("bytes_up"), c("bytes_down")),
        "upload_packet_fraction": X.safe_divide(c("packet_count_up"), c("packet_count_total")),
        "download_packet_fraction": X.safe_divide(c("packet_count_down"), c("packet_count_total")),
        "upload_byte_fraction": X.safe_divide(c("bytes_up"), c("bytes_total")),
        "download_byte_fraction": X.safe_divide(c("bytes_down"), c("bytes_total")),
        "direction_switch_rate": X.safe_divide(
            c("direction_switch_count"), F.greatest(c("packet_count_total") - 1, F.lit(0))
        ),
        "packet_information_threshold": F.lit(int(threshold)),
        "packet_information_ok": (c("packet_count_total") >= int(threshold)).cast("int"),
    }
    for name, source in (
        ("packets_per_second", "packet_count_total"),
        ("bytes_per_second", "bytes_total"),
        ("upload_packets_per_second", "packet_count_up"),
        ("download_packets_per_second", "packet_count_down"),
        ("upload_bytes_per_second", "bytes_up"),
        ("download_bytes_per_second", "bytes_down"),
        ("burst_frequency_per_second", "burst_count_total"),
    ):
        out[name] = X.safe_divide(c(source), duration)
    return out


def feature_rows(
    packets: DataFrame,
    scales: Sequence[float] = WINDOW_SCALES,
    burst_gap_sec: float = 0.05,
    idle_threshold_sec: float = 0.5,
    packet_information_threshold: int = 2,
    keys: Sequence[str] = TRACE,
    dense: bool = True,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """One whole-trace row plus one row per window and scale, 92 predictors each."""
    if burst_gap_sec < 0 or idle_threshold_sec < 0:
        raise ValueError("gap and idle threshold must not be negative")
    scales = sorted({float(s) for s in scales})
    if any(s <= 0 for s in scales):
        raise ValueError("window scales must be positive")
    trace = sequence_packets(packets, burst_gap_sec, keys, limit)
    return windowed_features(
        trace, scales, burst_gap_sec, idle_threshold_sec, packet_information_threshold, dense, limit
    )


def windowed_features(
    trace: Sequenced,
    scales: Sequence[float],
    burst_gap_sec: float,
    idle_threshold_sec: float,
    packet_information_threshold: int,
    dense: bool = True,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    keys, scales = list(trace.keys), [float(s) for s in scales]
    trace = measured_packets(trace, scales)
    packets = trace.df if trace.sliced else cut_lineage(trace.df)  # cut while sequencing, if it is sliced
    rows = windowed_rows(packets, keys, scales, dense)
    inner = windowed_rows(packets, keys, scales, False)
    group = [*keys, "scale", "window_index"]
    if not trace.sliced:
        # No group is above the limit, and most have few packets: their rows are dealt once, as they are, and every
        # block and join finds them in place. Where a trace is cut, its groups are reduced before they are dealt.
        rows, inner = rows.repartition(*group), inner.repartition(*group)
    bounds = [F.max("trace_start").alias("_t0"), F.max("trace_end").alias("_t1")]
    table = _assemble(rows, group, idle_threshold_sec, trace.sliced, limit, bounds, inner)
    sizes = F.array(*[F.lit(s) for s in (0.0, *scales)])
    table = table.withColumn("window_size_sec", F.element_at(sizes, F.col("scale") + 2))
    scale, index = F.col("window_size_sec"), F.col("window_index")
    total = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(0.0))
    whole = scale == 0.0
    start = F.when(whole, F.lit(0.0)).otherwise(index * scale)
    last = (index == window_count(total, scale) - 1) & (total > index * scale)
    end = F.when(whole, total).when(last, F.least(index * scale + scale, total)).otherwise(index * scale + scale)
    duration = F.when(whole, F.col("_span")).otherwise(
        F.greatest(F.col("window_end_sec") - F.col("window_start_sec"), F.lit(0.0))
    )
    table = table.withColumns(
        {
            "row_type": F.when(whole, "overall").otherwise("window"),
            "window_start_sec": start,
            "window_end_sec": end,
        }
    ).withColumns(derived_columns(duration, packet_information_threshold))
    return table.select(*keys, *ROW_METADATA, *PREDICTORS)


# ---- rounds and other closed intervals ------------------------------------


#: What features need of a packet, besides its keys and order.
PACKET_FIELDS = (
    "frame_length direction transport_protocol tcp_syn tcp_ack tcp_fin tcp_rst retransmission tls_record_lengths"
).split()


def segment_features(
    packets: DataFrame,
    segments: DataFrame,
    row_type: str = "round",
    burst_gap_sec: float = 0.05,
    idle_threshold_sec: float = 0.5,
    packet_information_threshold: int = 2,
    keys: Sequence[str] = TRACE,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Features of the packets inside ``segments`` (trace keys, segment_index, start_epoch, end_epoch).

    A packet on the border of two segments belongs to both. Packets meet their segments first and once; what
    is left is put in order per segment, where bursts, gaps and switches start anew, and dealt to all blocks as it is.
    """
    from traceweave.operators.joins import interval_join

    keys = list(keys)
    starts = packets.groupBy(*keys).agg(F.min("timestamp_epoch").alias("trace_start"))
    bounds = segments.join(starts, keys).select(
        *keys, F.col("segment_index").alias("window_index"), "trace_start", "start_epoch", "end_epoch"
    )
    narrow = packets.select(*keys, *ORDER, *PACKET_FIELDS, connection_of(packets).alias("conn"))
    inside = interval_join(narrow, bounds, keys, "timestamp_epoch", "start_epoch", "end_epoch")
    own = inside.withColumnsRenamed({"trace_start": "_t0", "start_epoch": "_start", "end_epoch": "_end"})
    own = cut_lineage(own.withColumn("window_size_sec", F.lit(0.0)))
    group = [*keys, *GROUP]
    trace = sequence_packets(own, burst_gap_sec, group, limit)
    prior = F.col("prev_known")
    rows = trace.df.select(
        *group,
        "_t0",
        "_start",
        "_end",
        *[c.alias(n) for n, c in _measures().items() if n != "tls_list"],
        gap_before().alias("iat"),
        F.when(
            prior.isNotNull() & F.col("direction").isin("up", "down"), (F.col("direction") != prior["d"]).cast("long")
        ).alias("switched"),
    )
    if not trace.sliced:
        rows = cut_lineage(rows)
    extra = [F.max(n).alias(n) for n in ("_t0", "_start", "_end")]
    table = _assemble(rows, group, idle_threshold_sec, trace.sliced, limit, extra)
    table = table.withColumns(
        {
            "row_type": F.lit(row_type),
            "window_start_sec": F.col("_start") - F.col("_t0"),
            "window_end_sec": F.col("_end") - F.col("_t0"),
        }
    ).withColumns(derived_columns(F.col("_span"), packet_information_threshold))
    return table.select(*keys, *ROW_METADATA, *PREDICTORS)


# ---- packet budgets ---------------------------------------------------------

SINGLE_PACKET_FEATURES = (
    "frame_length direction_up direction_down direction_unknown iat_sec transport_tcp transport_udp tcp_syn tcp_ack "
    "tcp_fin tcp_rst retransmission tls_record_count tls_record_size_sum tls_record_size_mean tls_record_size_max"
).split()


def number_packets(packets: DataFrame, keys: Sequence[str] = TRACE, limit: int = DEFAULT_LIMIT) -> Sequenced:
    """0-based position, predecessor and trace size for packet-count groupings."""
    trace = sequence(packets, keys, ORDER, limit).numbered("position")
    trace = trace.with_columns({"position": F.col("position") - 1})
    trace = trace.previous(
        {
            "prev_t": F.col("timestamp_epoch"),
            "prev_known": F.when(
                F.col("direction").isin("up", "down"),
                F.struct(F.col("position").alias("p"), F.col("direction").alias("d")),
            ),
        }
    )
    trace = trace.key_stats({"trace_packets": F.count(F.lit(1))})
    return Sequenced(cut_lineage(trace.df), trace.keys, trace.order, True) if trace.sliced else trace


def single_packet_rows(trace: Sequenced) -> DataFrame:
    """K=1: one 16-value row per packet; the first packet has gap 0."""
    tls = F.transform(F.col("tls_record_lengths"), lambda v: v.cast("double"))
    count = F.size("tls_record_lengths")

    def flag(c: Column) -> Column:
        return c.cast("double")

    return trace.df.select(
        *trace.keys,
        F.lit(1).alias("packet_budget"),
        F.col("position").alias("block_index"),
        F.col("position").alias("packet_start_index"),
        F.col("position").alias("packet_end_index"),
        F.col("frame_length").cast("double").alias("frame_length"),
        flag(F.col("direction") == "up").alias("direction_up"),
        flag(F.col("direction") == "down").alias("direction_down"),
        flag(F.col("direction") == "unknown").alias("direction_unknown"),
        zero(gap_before()).alias("iat_sec"),
        flag(F.col("transport_protocol") == "TCP").alias("transport_tcp"),
        flag(F.col("transport_protocol") == "UDP").alias("transport_udp"),
        *[flag(F.col(n)).alias(n) for n in ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst", "retransmission")],
        flag(count).alias("tls_record_count"),
        X.array_sum(tls).alias("tls_record_size_sum"),
        X.safe_divide(X.array_sum(tls), count).alias("tls_record_size_mean"),
        zero(F.array_max(tls)).alias("tls_record_size_max"),
    )


def packet_blocks(
    packets: DataFrame,
    budgets: Sequence[int] = PACKET_BUDGETS,
    keys: Sequence[str] = TRACE,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Exact-K, non-overlapping blocks for every K above 1; short tails are dropped."""
    if any(int(k) <= 0 for k in budgets):
        raise ValueError("packet budgets must be positive")
    trace = number_packets(packets, keys, limit)
    return blocks_of(trace, [int(k) for k in budgets if int(k) > 1])


def blocks_of(trace: Sequenced, budgets: Sequence[int]) -> DataFrame:
    budget = F.explode(F.array(*[F.lit(k) for k in budgets])).alias("packet_budget")
    measures = {n: c for n, c in _measures().items() if n not in ("burst_id", "new_burst", "conn")}
    rows = trace.df.select(
        *trace.keys, "position", "trace_packets", "prev_t", "prev_known", *[c.alias(n) for n, c in measures.items()], budget
    )
    k = F.col("packet_budget")
    block = F.floor(F.col("position") / k)
    rows = (
        rows.withColumn("block_index", block)
        .where(F.col("block_index") < F.floor(F.col("trace_packets") / k))
        .withColumns(
            {
                "iat": F.when(F.col("position") % k != 0, F.greatest(F.col("t") - F.col("prev_t"), F.lit(0.0))),
                "switched": F.when(
                    F.col("dir").isin("up", "down")
                    & (F.col("prev_known.p") >= F.col("block_index") * k),
                    (F.col("dir") != F.col("prev_known.d")).cast("long"),
                ),
            }
        )
    )
    group = [*trace.keys, "packet_budget", "block_index"]
    length, iat = F.col("len"), F.col("iat")
    n = F.count(F.lit(1)).cast("double")
    up = F.count(F.when(F.col("dir") == "up", 1)).cast("double")
    down = F.count(F.when(F.col("dir") == "down", 1)).cast("double")
    span = F.greatest(F.max("t") - F.min("t"), F.lit(0.0))
    known = up + down

    def share(c: Column) -> Column:
        return F.sum(c).cast("double") / n

    tcp, udp = (F.when(F.col("transport") == p, 1).otherwise(0) for p in ("TCP", "UDP"))
    columns = {
        "elapsed_span_sec": span,
        "upload_packet_fraction": up / n,
        "download_packet_fraction": down / n,
        "unknown_packet_fraction": (n - up - down) / n,
        "upload_download_packet_ratio": X.safe_divide(up, down),
        "direction_switch_rate": X.safe_divide(
            F.coalesce(F.sum("switched"), F.lit(0)), F.greatest(known - 1, F.lit(0.0))
        ),
        "packets_per_second": X.safe_divide(n, span),
        "bytes_per_second": X.safe_divide(F.sum(length), span),
        "tcp_fraction": share(tcp),
        "udp_fraction": share(udp),
        "tcp_syn_fraction": share(F.col("syn")),
        "tcp_ack_fraction": share(F.col("ack")),
        "tcp_fin_fraction": share(F.col("fin")),
        "tcp_rst_fraction": share(F.col("rst")),
        "retransmission_fraction": share(F.col("retr")),
        "tls_records_per_packet": share(F.col("tls_n")),
        **four("packet_size", length),
        **quantile_columns("packet_size", length),
        **four("iat_sec", iat),
        **quantile_columns("iat_sec", iat),
        **pooled("tls_record_size", F.col("tls_n"), F.col("tls_sum"), F.col("tls_sq"), F.col("tls_min"), F.col("tls_max")),
    }
    # A block holds K packets, so the flat list of its TLS lengths is short.
    table = rows.groupBy(*group).agg(
        *[c.alias(name) for name, c in columns.items()],
        F.array_sort(F.flatten(F.collect_list("tls_list"))).alias("_tls"),
    )
    sorted_tls = F.col("_tls")
    table = table.withColumns(
        {f"tls_record_size_{name}": sorted_array_quantile(sorted_tls, p) for name, p in QUANTILES.items()}
    )
    stats = "mean std min max q25 median q75 p90 p95".split()
    plain = [c for c in columns if not c.startswith(("packet_size", "iat_sec", "tls_record_size"))]
    return table.select(
        *group,
        (F.col("block_index") * k).alias("packet_start_index"),
        (F.col("block_index") * k + k - 1).alias("packet_end_index"),
        *plain,
        *[f"{prefix}_{s}" for prefix in ("packet_size", "iat_sec", "tls_record_size") for s in stats],
    )


def sorted_array_quantile(values: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array, 0 when empty."""
    rank = F.lit(float(p)) * (F.size(values) - 1)
    low = F.get(values, F.floor(rank).cast("int"))
    high = F.get(values, F.ceil(rank).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (rank - F.floor(rank))).otherwise(F.lit(0.0))
