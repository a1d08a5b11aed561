"""Time-series operators for resource telemetry and round logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import DEFAULT_LIMIT, sequence


def counter_deltas(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Step and since-start growth of counters, never below zero (resets)."""
    series = sequence(df, keys, order, limit)
    series = series.previous({f"_p_{c}": F.col(c) for c in counters})
    series = series.key_stats(
        {f"_b_{c}": F.min_by(F.col(c), F.struct(*order)) for c in counters}
    )
    out: dict[str, Column] = {}
    for c in counters:
        step = F.col(c) - F.coalesce(f"_p_{c}", F.col(c))
        out[f"{c}_delta"] = F.greatest(step, F.lit(0))
        out[f"{c}_since_start"] = F.greatest(F.col(c) - F.col(f"_b_{c}"), F.lit(0))
    return series.with_columns(out).rows().drop(*[f"_{p}_{c}" for c in counters for p in "pb"])


def integrated_energy(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time_sec: str,
    powers: Mapping[str, str],
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Cumulative energy by the trapezoid rule; steps next to a missing power add nothing."""
    series = sequence(df, keys, order, limit)
    series = series.previous(
        {"_last": F.struct(F.col(time_sec).alias("t"), *[F.col(p).alias(p) for p in powers])}
    )
    dt = F.greatest(F.col(time_sec) - F.col("_last.t"), F.lit(0.0))
    steps = {
        out: F.coalesce((F.col(p) + F.col(f"_last.{p}")) / 2.0 * dt, F.lit(0.0)) for p, out in powers.items()
    }
    return series.running_sum(steps).rows().drop("_last")


def sampling_intervals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time_sec: str,
    duration_ms: str,
    wanted_ms: float,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Time since the previous sample and how far sampling overran its period."""
    series = sequence(df, keys, order, limit).previous({"_t": F.col(time_sec)})
    return series.with_columns(
        {
            "actual_interval_ms": (F.col(time_sec) - F.col("_t")) * 1000.0,
            "sampling_overrun_ms": F.greatest(F.col(duration_ms) - wanted_ms, F.lit(0.0)),
        }
    ).rows().drop("_t")


def round_deltas(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    metrics: Mapping[str, str],
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Change of metrics from the previous round; ``down`` metrics improve when they fall."""
    series = sequence(df, keys, order, limit)
    series = series.previous({"_last": F.struct(*[F.col(m).alias(m) for m in metrics])})
    return series.with_columns(
        {f"{m}_delta": X.metric_delta(F.col(m), F.col(f"_last.{m}"), way) for m, way in metrics.items()}
    ).rows().drop("_last")


def metric_summary(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    metrics: Sequence[str],
    last_values: Sequence[str] = (),
) -> DataFrame:
    """Mean, min and max of finite values, plus the latest value of counters."""
    position = F.struct(*order)
    out = [F.count(F.lit(1)).alias("sample_count")]
    for m in metrics:
        value = X.finite(F.col(m))
        out += [F.avg(value).alias(f"{m}_mean"), F.min(value).alias(f"{m}_min"), F.max(value).alias(f"{m}_max")]
    out += [F.max_by(F.col(c), position).alias(c) for c in last_values]
    return df.groupBy(*keys).agg(*out)


def stability_gate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: str,
    accepted: Column,
    elapsed: str,
    windows: int = 3,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Stable once ``windows`` accepted labels in a row agree; any rejection clears.

    A run is a stretch of accepted windows with one label; its length so far is
    the count since the run began, taken from two running sums.
    """
    series = sequence(df.withColumn("_ok", F.coalesce(accepted, F.lit(False))), keys, order, limit)
    series = series.numbered("_n").previous({"_last": F.struct(F.col("_ok").alias("ok"), F.col(label).alias("label"))})
    begins = F.col("_ok") & ~F.coalesce(F.col("_last.ok") & (F.col("_last.label") == F.col(label)), F.lit(False))
    series = series.with_columns({"_begins": begins})
    series = series.running_sum({"_run": F.col("_begins").cast("long")})
    rows = series.df
    runs = rows.where("_begins").groupBy(*keys, "_run").agg(F.min("_n").alias("_first"))
    rows = rows.join(runs, [*keys, "_run"], "left")
    length = F.when(F.col("_ok"), F.col("_n") - F.col("_first") + 1).otherwise(F.lit(0))
    stable = length >= windows
    return rows.select(
        *df.columns,
        F.col("_ok").cast("int").alias("accepted"),
        length.alias("run_length"),
        stable.cast("int").alias("stable"),
        F.when(stable, F.col(label)).alias("stable_label"),
    )


def first_stable(gated: DataFrame, keys: Sequence[str], elapsed: str) -> DataFrame:
    return gated.where("stable = 1").groupBy(*keys).agg(F.min(elapsed).alias("first_stable_sec"))


def batch_rollup(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], samples: str) -> DataFrame:
    """Mean of the finite batch metrics and total of samples per key."""
    return df.groupBy(*keys).agg(
        *[F.avg(X.finite(F.col(m))).alias(m) for m in metrics],
        *[F.stddev_pop(X.finite(F.col(m))).alias(f"{m}_std") for m in metrics],
        F.coalesce(F.sum(samples), F.lit(0)).cast("long").alias("evaluated_samples"),
    )


def transaction_timing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upload, waiting for the barrier and whole exchange in ms per round and client."""
    return df.groupBy(*keys).agg(
        F.sum(F.col("upload_ms")).alias("upload_ms"),
        F.sum(F.greatest(F.col("transaction_ms") - F.col("upload_ms"), F.lit(0.0))).alias("sync_wait_ms"),
        F.sum("transaction_ms").alias("transaction_ms"),
    )
