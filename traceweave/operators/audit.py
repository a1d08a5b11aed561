"""Audits: capture quality, inventories, coverage, policy and completeness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import DEFAULT_LIMIT, exact_quantiles

OVERSIZE_DEFAULT = 2048
OVERSIZE_ALLOWANCE = 64


def capture_quality(packets: DataFrame, keys: Sequence[str], interface_mtu: int | None = None) -> DataFrame:
    """Frames too large for the wire point to offloading in the capture host."""
    threshold = interface_mtu + OVERSIZE_ALLOWANCE if interface_mtu else OVERSIZE_DEFAULT
    over = F.count(F.when(F.col("frame_length") > threshold, 1))
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packet_count"),
        over.alias("oversized_frame_count"),
        X.safe_divide(over, F.count(F.lit(1))).alias("oversized_frame_fraction"),
        F.max("frame_length").alias("max_frame_length_bytes"),
        (over > 0).cast("int").alias("possible_offload_coalescing"),
        F.lit(threshold).alias("oversized_frame_threshold_bytes"),
    )


def best_setting(grid: DataFrame, scope: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Lexicographic argmax of a parameter grid."""
    top = F.max_by(F.struct(*keep), F.struct(*order))
    return grid.groupBy(*scope).agg(top.alias("_top")).select(*scope, *[F.col(f"_top.{k}").alias(k) for k in keep])


def rows_per_trace(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def packet_inventory(
    units: DataFrame, budgets: Sequence[int], roles: Sequence[str], experiment: str, trace: Sequence[str]
) -> DataFrame:
    """Available and written units, traces and experiments for every (K, role), zeros included.

    ``units`` has packet_budget, source_role, available, written per trace.
    The full grid is a short fixed list, so it is unioned as zero rows.
    """
    spark = units.sparkSession
    grid = spark.range(1).select(
        F.explode(F.array(*[F.lit(int(k)) for k in budgets])).alias("packet_budget"),
        F.array(*[F.lit(r) for r in roles]).alias("_roles"),
    ).select("packet_budget", F.explode("_roles").alias("source_role"))
    key = ["packet_budget", "source_role"]
    per_trace = units.groupBy(*key, experiment, *trace).agg(
        F.sum("available").alias("available"), F.sum("written").alias("written")
    )
    per_experiment = per_trace.groupBy(*key, experiment).agg(
        F.sum("available").alias("available"), F.sum("written").alias("written"), F.count(F.lit(1)).alias("traces")
    )
    found = per_experiment.groupBy(*key).agg(
        F.sum("available").alias("available"),
        F.sum("written").alias("written"),
        F.sum("traces").alias("traces"),
        F.count(F.lit(1)).alias("experiments"),
    )
    return grid.join(found, key, "left").fillna(0, ["available", "written", "traces", "experiments"])


def coverage_modes(inventory: DataFrame) -> list[str]:
    """Vantage modes the K=1 coverage allows: without endpoint samples only the proxy's own."""
    endpoint = inventory.where("packet_budget = 1 and source_role in ('client', 'server') and written > 0")
    if endpoint.isEmpty():
        return ["proxy_to_proxy"]
    return ["client_to_proxy", "server_to_proxy", "both_to_proxy", "proxy_to_proxy"]


def representation_inventory(df: DataFrame, group: Sequence[str], experiment: str, trace: Sequence[str]) -> DataFrame:
    """Rows, experiments, traces and sparse rows per representation (and labels)."""
    sparse = (F.col("packet_information_ok") == 0).cast("long")
    per_trace = df.groupBy(*group, experiment, *trace).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(sparse).alias("sparse")
    )
    per_experiment = per_trace.groupBy(*group, experiment).agg(
        F.sum("rows").alias("rows"), F.sum("sparse").alias("sparse"), F.count(F.lit(1)).alias("traces")
    )
    return per_experiment.groupBy(*group).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("experiments"),
        F.sum("traces").alias("traces"),
        F.sum("sparse").alias("sparse_rows"),
        (F.sum("sparse") / F.sum("rows")).alias("sparse_fraction"),
    )


def dimension_counts(df: DataFrame, base: str, dimensions: Sequence[str]) -> DataFrame:
    """Counts per base value and each dimension alone, in long form (grouping sets)."""
    sets = [[base, d] for d in dimensions]
    grouped = df.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [base, *dimensions]]
    ).agg(F.count(F.lit(1)).alias("rows"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for d in reversed(dimensions):
        name = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select(base, name.alias("dimension"), value.alias("value"), "rows")


def coverage_sets(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per column, each counted in two hash aggregations."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*group, F.explode(pairs).alias("p")).select(*group, "p.column", "p.value")
    return long.where(F.col("value").isNotNull()).distinct().groupBy(*group, "column").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )


def telemetry_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: Sequence[str],
    prefix: str = "",
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Mean, spread, median, min, max and last-minus-first of text or number columns.

    Medians come from one percentile state per key, or, when some key has more
    than ``limit`` rows, from sliced ranks for all keys.
    """
    values = {c: X.finite(F.col(c).cast("string").try_cast("double")) for c in columns}
    names = {c: f"{prefix}{c.strip('_').lower()}" for c in columns}
    large = not df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()
    out = []
    for c, v in values.items():
        at = F.when(v.isNotNull(), F.struct(*order))
        out += [
            F.avg(v).alias(f"{names[c]}__mean"),
            F.stddev_pop(v).alias(f"{names[c]}__std"),
            F.min(v).alias(f"{names[c]}__min"),
            F.max(v).alias(f"{names[c]}__max"),
            F.when(F.count(v) > 1, F.max_by(v, at) - F.min_by(v, at)).alias(f"{names[c]}__delta"),
        ]
        if not large:
            out.append(F.percentile(v, F.lit(0.5)).alias(f"{names[c]}__median"))
    table = df.groupBy(*keys).agg(*out)
    if large:
        for c, v in values.items():
            one = df.select(*keys, v.alias("_v"))
            table = table.join(exact_quantiles(one, keys, "_v", [0.5], [f"{names[c]}__median"], limit), list(keys), "left")
    return table


def coverage_problems(expected: DataFrame, written: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Traces that are missing from or extra in the written set, with a verdict per group."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    w = written.select(*keys).distinct().withColumn("_w", F.lit(1))
    both = e.join(w, list(keys), "full_outer")
    missing, extra = F.count(F.when(F.col("_w").isNull(), 1)), F.count(F.when(F.col("_e").isNull(), 1))
    return both.groupBy(*group).agg(
        missing.alias("missing"), extra.alias("extra"), F.when((missing == 0) & (extra == 0), "valid").otherwise("invalid").alias("status")
    )


def set_difference(expected: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The missing and extra keys themselves."""
    a, b = expected.select(*keys), written.select(*keys)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def rate_mismatches(df: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Window rows whose stored rates differ from count over interval."""
    pairs = {
        "packets_per_second": "packet_count_total",
        "bytes_per_second": "bytes_total",
        "upload_packets_per_second": "packet_count_up",
        "download_packets_per_second": "packet_count_down",
        "upload_bytes_per_second": "bytes_up",
        "download_bytes_per_second": "bytes_down",
    }
    interval = F.col("window_end_sec") - F.col("window_start_sec")
    bad = F.lit(False)
    for rate, count in pairs.items():
        want = X.safe_divide(F.col(count), interval)
        bad = bad | (F.abs(F.col(rate) - want) > tolerance * F.greatest(F.abs(want), F.lit(1.0)))
    return df.where((F.col("row_type") == "window") & bad)


def run_completeness(runs: DataFrame) -> DataFrame:
    """Status ladder of a run from its counts; see the column names for the inputs."""
    c = F.col
    target, expected = c("target_rounds"), c("expected_clients")
    rounds_done = (target > 0) & (c("last_completed_round") >= target)
    metrics_done = (
        (target > 0)
        & (c("server_round_rows") >= target)
        & (expected > 0)
        & (c("client_update_rows") >= target * expected)
        & (c("incomplete_clients") == 0)
    )
    capture_done = ~c("proxy_present") | (
        (F.upper(c("proxy_status")) == "COMPLETED")
        & c("capture_complete")
        & (c("pcap_chunks") > 0)
        & (c("total_capture_bytes") > 0)
        & (c("total_packets") > 0)
    )
    status = (
        F.when(~rounds_done, F.when(c("last_completed_round") > 0, "PARTIAL").otherwise("FAILED"))
        .when(~metrics_done, "METRICS_INCOMPLETE")
        .when(~F.coalesce(capture_done, F.lit(False)), "CAPTURE_INCOMPLETE")
        .when(F.upper(c("server_status")) == "COMPLETED", "COMPLETED")
        .otherwise("FAILED")
    )
    return runs.withColumn("run_status", status)


def collection_validation(participants: DataFrame, run: str) -> DataFrame:
    """VALID or PARTIAL per run, with its issues, from one row per participant.

    ``participants``: participant, has_receipt, status, feature_files,
    truth_files, expected_clients (set on the server's row).
    """
    name = F.col("participant")
    client = name.startswith("client")
    per = participants.groupBy(run).agg(
        F.max((name == "server").cast("int")).alias("_server"),
        F.max((name == "proxy").cast("int")).alias("_proxy"),
        F.count(F.when(client, 1)).alias("collected_clients"),
        F.max(F.when(name == "server", F.col("expected_clients"))).alias("expected_clients"),
        F.count(F.when(~F.col("has_receipt"), 1)).alias("_no_receipt"),
        F.count(F.when(F.col("status").isNull(), 1)).alias("_no_status"),
        F.count(F.when(F.upper("status") != "COMPLETED", 1)).alias("_unfinished"),
        F.coalesce(F.sum(F.when(name == "proxy", F.col("feature_files"))), F.lit(0)).alias("_features"),
        F.coalesce(F.sum(F.when(client, F.col("truth_files"))), F.lit(0)).alias("_truth"),
    )
    c = F.col
    issues = F.filter(
        F.array(
            F.when(c("_server") == 0, "missing server copy"),
            F.when(c("_proxy") == 0, "missing proxy copy"),
            F.when(c("collected_clients") != c("expected_clients"), "unexpected number of clients"),
            F.when(c("collected_clients") == 0, "no client copies collected"),
            F.when(c("_no_receipt") > 0, "missing collector receipt"),
            F.when(c("_no_status") > 0, "missing experiment status"),
            F.when(c("_unfinished") > 0, "experiment not completed"),
            F.when((c("_proxy") == 1) & (c("_features") == 0), "no extracted features"),
            F.when(c("_truth") == 0, "no ground truth files"),
        ),
        lambda i: i.isNotNull(),
    )
    return per.select(
        run,
        "collected_clients",
        "expected_clients",
        F.when(F.size(issues) == 0, "VALID").otherwise("PARTIAL").alias("status"),
        issues.alias("issues"),
    )


def valid_runs(df: DataFrame, validation: DataFrame, run: str) -> DataFrame:
    return df.join(validation.where("status = 'VALID'").select(run), run, "left_semi")


def reason_counts(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    """Skip reasons, most common first."""
    return skipped.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), reason)


def split_by_label(sources: DataFrame, labels: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sources with a label, and the others with the reason they are skipped."""
    known = labels.select(*keys).distinct()
    kept = sources.join(known, list(keys), "left_semi")
    skipped = sources.join(known, list(keys), "left_anti").withColumn("reason", F.lit("no_matching_ground_truth_label"))
    return kept, skipped


def class_histograms(df: DataFrame, partition: str, label: str) -> DataFrame:
    counts = df.groupBy(partition, label).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col(label).cast("string").alias("key"), F.col("n").alias("value"))
    return counts.groupBy(partition).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("class_histogram"), F.sum("n").alias("rows")
    )


def fold_statistics(df: DataFrame, fold: str, label: str, experiment: str) -> DataFrame:
    """Rows, experiments and classes of every fold."""
    cells = df.groupBy(fold, label, experiment).agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy(fold, label).agg(F.sum("n").alias("n"))
    by_class = classes.groupBy(fold).agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows"))
    by_experiment = cells.select(fold, experiment).distinct().groupBy(fold).agg(F.count(F.lit(1)).alias("experiments"))
    return by_class.join(by_experiment, fold)


def metric_spread(folds: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over folds of each value, as rows (keys, metric, folds, mean, std)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    ).alias("_p")
    return (
        folds.select(*keys, pairs)
        .groupBy(*keys, F.col("_p.metric").alias("metric"))
        .agg(
            F.count("_p.value").alias("folds"),
            F.avg("_p.value").alias("mean"),
            F.stddev_pop("_p.value").alias("std"),
        )
    )


def parameter_counts(folds: DataFrame, keys: Sequence[str], parameter: str) -> DataFrame:
    """In how many folds each parameter was the chosen one."""
    return folds.groupBy(*keys, parameter).agg(F.count(F.lit(1)).alias("folds"))


def comparison(summaries: DataFrame, order: Sequence[str], name: str = "representation") -> DataFrame:
    """Evaluated rows only, in display order."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
    return summaries.where("status = 'evaluated'").withColumn("position", rank).orderBy("position", name)


def matrix_evidence(df: DataFrame, keys: Sequence[str], largest: str = "B") -> DataFrame:
    """Packets and rows behind an aggregate matrix; the label has units up to ``largest``."""
    packets = F.sum("packet_count_total")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), packets.alias("packets"), X.compact_count(packets, largest).alias("label")
    )
