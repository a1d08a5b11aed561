"""Telemetry, round-log and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.scalars import PROBS_SQL, probabilities
from traceweave.catalog.tables import epoch_seconds, table
from traceweave.functions import exprs as X
from traceweave.functions.exprs import rounded
from traceweave.operators import telemetry as T
from traceweave.operators import vectors as V

ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey"]
TELE_SQL = """WITH base AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) / 1e6 / 86400 AS day,
 CASE WHEN l_linenumber <> 3 THEN l_quantity END AS power, CAST(l_extendedprice AS BIGINT) AS counter FROM lineitem),
tele AS (SELECT *, lag(day) OVER o AS pday, lag(power) OVER o AS ppower, lag(counter) OVER o AS pcounter, first_value(counter) OVER o AS fcounter
 FROM base WINDOW o AS (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber, l_partkey))"""


def telemetry(spark, sf_dir):
    """lineitem as per-supplier telemetry samples."""
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (epoch_seconds("l_shipdate") / 86400.0).alias("day"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("power"),
        F.rint("l_extendedprice").cast("long").alias("counter"),
    )


@query(
    TELE_SQL
    + """ SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, greatest(counter - coalesce(pcounter, counter), 0) AS counter_delta, greatest(counter - fcounter, 0) AS counter_since_start FROM tele"""
)
def counter_delta(spark, sf_dir):
    df = T.counter_deltas(telemetry(spark, sf_dir), ["l_suppkey"], ORDER, ["counter"])
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "counter_delta", "counter_since_start")


@query(
    TELE_SQL
    + f""", st AS (SELECT *, coalesce((power + ppower) / 2.0 * (day - pday), 0) AS step FROM tele)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {r6("sum(step) OVER (PARTITION BY l_suppkey ORDER BY day, l_orderkey, l_linenumber, l_partkey)")} AS energy FROM st"""
)
def energy(spark, sf_dir):
    df = T.integrated_energy(telemetry(spark, sf_dir), ["l_suppkey"], ORDER, "day", {"power": "energy"})
    return rounded(df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "energy"))


@query(
    TELE_SQL
    + f""" SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {r6("(day - pday) * 1000")} AS actual_interval_ms, {r6("CASE WHEN power IS NULL THEN 0 ELSE greatest(power - 20, 0) END")} AS sampling_overrun_ms FROM tele"""
)
def sampling_interval(spark, sf_dir):
    df = T.sampling_intervals(telemetry(spark, sf_dir), ["l_suppkey"], ORDER, "day", "power", 20.0)
    return rounded(
        df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "actual_interval_ms", "sampling_overrun_ms")
    )


@query(
    TELE_SQL
    + f""" SELECT l_suppkey, count(*) AS sample_count, {r6("avg(power)")} AS power_mean, {r6("min(power)")} AS power_min, {r6("max(power)")} AS power_max,
 {r6("avg(day)")} AS day_mean, {r6("min(day)")} AS day_min, {r6("max(day)")} AS day_max,
 arg_max(counter, (day, l_orderkey, l_linenumber, l_partkey)) AS counter FROM tele GROUP BY 1"""
)
def resource_summary(spark, sf_dir):
    return rounded(T.metric_summary(telemetry(spark, sf_dir), ["l_suppkey"], ORDER, ["power", "day"], ["counter"]))


RUN_SQL = "WITH r AS (SELECT o_orderkey, 'run_' || (o_custkey % 12) AS run_id, o_orderkey AS round, o_totalprice / 1e5 AS loss, 1 - o_totalprice / 1e6 AS accuracy FROM orders)"


def round_log(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), (F.col("o_custkey") % 12).cast("string")).alias("run_id"),
        F.col("o_orderkey").alias("round"),
        (F.col("o_totalprice") / 1e5).alias("loss"),
        (1 - F.col("o_totalprice") / 1e6).alias("accuracy"),
    )


@query(
    RUN_SQL
    + f""" SELECT run_id, round, {r6("lag(loss) OVER o - loss")} AS loss_delta, {r6("accuracy - lag(accuracy) OVER o")} AS accuracy_delta FROM r WINDOW o AS (PARTITION BY run_id ORDER BY round)"""
)
def round_delta(spark, sf_dir):
    """Twelve runs hold all rounds, so runs are long: the sliced order applies at scale."""
    df = T.round_deltas(round_log(spark, sf_dir), ["run_id"], ["round"], {"loss": "down", "accuracy": "up"})
    return rounded(df.select("run_id", "round", "loss_delta", "accuracy_delta"))


@query(
    RUN_SQL
    + f""", b AS (SELECT run_id, CASE WHEN round % 5 <> 0 THEN loss END AS loss, accuracy, round % 100 AS samples FROM r)
SELECT run_id, {r6("avg(loss)")} AS loss, {r6("avg(accuracy)")} AS accuracy, {r6("stddev_pop(loss)")} AS loss_std, {r6("stddev_pop(accuracy)")} AS accuracy_std, sum(samples)::BIGINT AS evaluated_samples FROM b GROUP BY 1"""
)
def batch_rollup(spark, sf_dir):
    """Means over batches; missing and non-finite values do not count."""
    loss = F.when(F.col("round") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("loss"))
    df = round_log(spark, sf_dir).withColumns({"loss": loss, "samples": F.col("round") % 100})
    return rounded(T.batch_rollup(df, ["run_id"], ["loss", "accuracy"], "samples"))


@query(
    f"""SELECT conv_id, role, {r6("sum(length(text) * 0.25)")} AS upload_ms, {r6("sum(length(text) * 0.75)")} AS sync_wait_ms, {r6("sum(length(text))")} AS transaction_ms FROM conversations GROUP BY 1, 2"""
)
def transaction_timing(spark, sf_dir):
    size = F.length("text").cast("double")
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "role", (size * 0.25).alias("upload_ms"), size.alias("transaction_ms")
    )
    return rounded(T.transaction_timing(df, ["conv_id", "role"]))


GATE_SQL = (
    PROBS_SQL
    + """, lab AS (SELECT packet_index, experiment_id, client_id, list_max(p) >= 0.5 AS ok, list_position(p, list_max(p)) AS label FROM prob),
n AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY packet_index) AS rn, lag(ok) OVER o AS pok, lag(label) OVER o AS pl FROM lab WINDOW o AS (PARTITION BY experiment_id, client_id ORDER BY packet_index)),
b AS (SELECT *, CASE WHEN ok AND NOT coalesce(pok AND pl = label, false) THEN rn END AS st FROM n),
r AS (SELECT *, CASE WHEN ok THEN rn - max(st) OVER (PARTITION BY experiment_id, client_id ORDER BY packet_index) + 1 ELSE 0 END AS run_length FROM b)"""
)


def _gated(spark, sf_dir):
    p = F.col("p")
    df = probabilities(spark, sf_dir).select(
        "packet_index",
        "experiment_id",
        "client_id",
        F.array_position("p", F.array_max("p")).alias("label"),
        F.array_max(p).alias("confidence"),
    )
    return T.stability_gate(
        df, ["experiment_id", "client_id"], ["packet_index"], "label", F.col("confidence") >= 0.5, "packet_index"
    )


@query(
    GATE_SQL
    + " SELECT packet_index, experiment_id, client_id, ok::INT AS accepted, run_length, (run_length >= 3)::INT AS stable, CASE WHEN run_length >= 3 THEN label END AS stable_label FROM r"
)
def stability_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select(
        "packet_index", "experiment_id", "client_id", "accepted", "run_length", "stable", "stable_label"
    )


@query(GATE_SQL + " SELECT experiment_id, client_id, min(packet_index) AS first_stable_sec FROM r WHERE run_length >= 3 GROUP BY 1, 2")
def first_stable(spark, sf_dir):
    return T.first_stable(_gated(spark, sf_dir), ["experiment_id", "client_id"], "packet_index")


@query(
    f"""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS position, 1 + vec_id % 7 AS w FROM embeddings)
SELECT label, position, {r6("sum(w * x) / sum(w)")} AS value, sum(w)::DOUBLE AS total_weight, count(*) AS clients FROM e GROUP BY 1, 2"""
)
def fedavg(spark, sf_dir):
    """Example-weighted mean vector per round (label)."""
    df = table(spark, sf_dir, "embeddings").withColumn("examples", F.lit(1) + F.col("vec_id") % 7)
    return rounded(V.weighted_elements(df, ["label"], "embedding", "examples"))


@query(
    f"""SELECT label, {r6("sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))")} AS l2_norm FROM embeddings GROUP BY 1"""
)
def vector_norms(spark, sf_dir):
    return rounded(V.vector_norms(table(spark, sf_dir, "embeddings"), ["label"], "embedding"))


PAIR_SQL = """WITH p AS (SELECT a.vec_id, a.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS sq, len(a.embedding) AS n
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def vector_pairs(spark, sf_dir):
    """Each vector with the one numbered after it."""
    a = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("next"))
    return a.join(b, "vec_id").select("vec_id", "label", "e", "next")


@query(PAIR_SQL + f" SELECT label, {r6('sqrt(sum(sq))')} AS l2_norm FROM p GROUP BY 1")
def vector_delta_norms(spark, sf_dir):
    return rounded(V.vector_norms(vector_pairs(spark, sf_dir), ["label"], "e", "next"))


@query(PAIR_SQL + f" SELECT vec_id, {r6('sq / n')} AS reconstruction_error FROM p")
def reconstruction_error(spark, sf_dir):
    df = vector_pairs(spark, sf_dir)
    return rounded(
        df.select("vec_id", X.mean_squared_difference(F.col("e"), F.col("next")).alias("reconstruction_error"))
    )


@query(
    f"""WITH n AS (SELECT label, vec_id, CASE WHEN vec_id % 11 <> 0 THEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) END AS nrm, 4 * len(embedding) AS b FROM embeddings)
SELECT label, count(*) AS clients_received, {r6("avg(nrm)")} AS update_norm_mean, {r6("stddev_pop(nrm)")} AS update_norm_std, sum(greatest(vec_id % 7, 1))::BIGINT AS examples_total, sum(b)::BIGINT AS bytes_total FROM n GROUP BY 1"""
)
def update_norm_stats(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        "label",
        F.when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).otherwise(X.l2_norm(F.col("embedding"))).alias("norm"),
        (F.col("vec_id") % 7).alias("examples"),
        (4 * F.size("embedding")).alias("size"),
    )
    return rounded(V.update_statistics(df, ["label"], "norm", "examples", "size"))
