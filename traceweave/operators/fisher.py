"""Fisher feature ranking, sample weights, folds and stage expansion."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceweave.operators.ordered import DEFAULT_LIMIT, salted_attach, sequence
from traceweave.operators.sampling import draw

FLOOR = 1e-12
TOP_FEATURES = 10


def _scores(stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Between over within dispersion from (feature, class, n, mean, var) rows."""
    overall = stats.groupBy(*scope, "feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_all"), F.count(F.lit(1)).alias("_classes")
    )
    gap = F.col("mean") - F.col("_all")
    return (
        stats.join(overall, [*scope, "feature"])
        .groupBy(*scope, "feature")
        .agg(
            F.when(
                F.max("_classes") >= 2,
                F.sum(F.col("n") * gap * gap) / F.greatest(F.sum(F.col("n") * F.col("var")), F.lit(FLOOR)),
            )
            .otherwise(F.lit(0.0))
            .alias("score")
        )
    )


def fisher_wide(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Scores of many columns from one aggregation per class, without unpivoting rows."""
    columns = [F.col(f).cast("double") for f in features]
    if weight is None:
        aggs = [F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var")) for c in columns]
        size = F.count(F.lit(1)).cast("double")
    else:
        w = F.col(weight).cast("double")
        # Shifting by a fixed centre keeps the weighted squares small.
        centre = df.agg(*[F.avg(c) for c in columns]).first()
        shifted = [c - F.lit(float(m if m is not None else 0.0)) for c, m in zip(columns, centre)]
        means = [F.sum(w * c) / F.sum(w) for c in shifted]
        aggs = [
            F.struct(
                (m + F.lit(float(z if z is not None else 0.0))).alias("mean"),
                F.greatest(F.sum(w * c * c) / F.sum(w) - m * m, F.lit(0.0)).alias("var"),
            )
            for c, m, z in zip(shifted, means, centre)
        ]
        size = F.sum(w)
    wide = df.groupBy(*scope, F.col(label).alias("_class")).agg(
        size.alias("n"), *[a.alias(f"_f{i}") for i, a in enumerate(aggs)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"_f{i}.mean").alias("mean"), F.col(f"_f{i}.var").alias("var"))
            for i, f in enumerate(features)
        ]
    )
    stats = wide.select(*scope, "_class", "n", F.explode(entries).alias("e")).select(*scope, "_class", "n", "e.*")
    return _scores(stats, scope)


def fisher_long(
    long: DataFrame, feature: str, value: str, label: str, weight: Column | None = None
) -> DataFrame:
    """Scores from (feature, value, class) rows, for vectors with many positions."""
    w = weight if weight is not None else F.lit(1.0)
    rows = long.select(
        F.col(feature).alias("feature"),
        F.col(label).alias("_class"),
        F.col(value).cast("double").alias("x"),
        w.cast("double").alias("w"),
    )
    centre = rows.groupBy("feature").agg(F.avg("x").alias("_c"))
    rows = salted_attach(rows, centre, ["feature"], F.col("x"), how="inner").withColumn("x", F.col("x") - F.col("_c"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    stats = rows.groupBy("feature", "_class").agg(
        F.sum("w").alias("n"),
        mean.alias("mean"),
        F.greatest(F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w") - mean * mean, F.lit(0.0)).alias("var"),
    )
    return _scores(stats, [])


def top_features(scores: DataFrame, scope: Sequence[str], k: int = TOP_FEATURES) -> DataFrame:
    """Best ``k`` features per scope (a few hundred rows each), ties by name."""
    order = Window.partitionBy(*scope).orderBy(F.desc("score"), "feature")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# ---- sample weights ---------------------------------------------------------


def experiment_weights(df: DataFrame, experiment: str, spread: Column) -> DataFrame:
    """Each experiment has total weight 1."""
    sizes = df.groupBy(experiment).agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return salted_attach(df, sizes, [experiment], spread, how="inner")


def _nested_weights(df: DataFrame, experiment: str, inner: str) -> DataFrame:
    sizes = df.groupBy(experiment, inner).agg(F.count(F.lit(1)).alias("_n"))
    parts = sizes.groupBy(experiment).agg(F.count(F.lit(1)).alias("_parts"))
    return sizes.join(parts, experiment).withColumn("weight", 1.0 / F.col("_parts") / F.col("_n"))


def source_weights(df: DataFrame, experiment: str, source: str, spread: Column) -> DataFrame:
    """Equal experiments, equal sources inside, equal rows inside a source."""
    w = _nested_weights(df, experiment, source).select(experiment, source, "weight")
    return salted_attach(df, w, [experiment, source], spread, how="inner")


def trace_weights(df: DataFrame, experiment: str, trace: str, spread: Column) -> DataFrame:
    """Equal experiments, traces and rows, scaled to mean 1.

    Raw weights add up to one per experiment, so the mean is experiments/rows.
    """
    w = _nested_weights(df, experiment, trace)
    scale = w.agg(F.sum("_n") / F.sum(F.col("_n") * F.col("weight"))).scalar()
    w = w.withColumn("weight", F.col("weight") * scale).select(experiment, trace, "weight")
    return salted_attach(df, w, [experiment, trace], spread, how="inner")


# ---- folds and stages -------------------------------------------------------


def fold_count(df: DataFrame, scope: Sequence[str], label: str, experiment: str, most: int = 5) -> DataFrame:
    """min(most, experiments of the rarest class) per scope."""
    pairs = df.select(*scope, label, experiment).distinct()
    per = pairs.groupBy(*scope, label).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*scope).agg(F.least(F.lit(most), F.min("_n")).cast("int").alias("folds"))


def experiment_folds(
    df: DataFrame,
    label: str,
    experiment: str,
    folds: int | Column,
    seed: int = 42,
    scope: Sequence[str] = (),
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Group-disjoint folds on the (experiment, label) table.

    Experiments of a class are put in hash order and dealt round-robin from a
    class-dependent first fold.  An experiment with two labels is an error.
    """
    k = folds if isinstance(folds, Column) else F.lit(int(folds))
    carried = [k.alias("_k")]
    pairs = df.groupBy(*scope, experiment).agg(
        F.when(F.min(label) == F.max(label), F.min(label))
        .otherwise(F.raise_error(F.concat(F.lit("experiment with several labels: "), F.col(experiment).cast("string"))))
        .alias(label),
        *([F.max(k).alias("_k")] if isinstance(folds, Column) else []),
    )
    if not isinstance(folds, Column):
        pairs = pairs.select("*", *carried)
    names = [*scope, label]
    dealt = pairs.withColumn("_draw", draw(F.lit(seed), F.col(experiment)))
    ordered = sequence(dealt, names, ["_draw"], limit).numbered("_n").rows()
    first = draw(F.lit(seed), *[F.col(n) for n in names])
    return ordered.withColumn("fold", F.pmod(F.col("_n") - 1 + first, F.col("_k")).cast("int")).drop("_n", "_draw", "_k")


def _class_counts(df: DataFrame, group: str, label: str | None, scope: Sequence[str]) -> DataFrame:
    """scope, group, rows and ``counts``: class -> rows (one row per group, whatever the number of rows)."""
    name = F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")
    cells = df.groupBy(*scope, group, name.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "_n"))))
    return cells.groupBy(*scope, group).agg(F.sum("_n").alias("rows"), entries.alias("counts"))


def _placed(table: DataFrame, group: str, scope: Sequence[str], place) -> DataFrame:
    """scope, group, fold: ``place(rows)`` gives one fold per group; a scope's groups come in hash order of the draw."""
    kinds = dict(table.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*scope, group]) + ", fold int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_draw", kind="stable").reset_index(drop=True)
        return rows[[*scope, group]].assign(fold=np.array(place(rows), np.int32))

    return table.withColumn("_all", F.lit(0)).groupBy("_all", *scope).applyInPandas(run, schema)


def group_folds(df: DataFrame, group: str, folds: int, seed: int = 42, scope: Sequence[str] = ()) -> DataFrame:
    """Group-disjoint folds of nearly equal rows: from large to small, each group joins the fold with the fewest rows.

    Equal groups come in hash order, of equal folds the first is taken. The walk sees one row per group, not the data.
    """
    table = _class_counts(df, group, None, scope).drop("counts").withColumn("_draw", draw(F.lit(seed), F.col(group)))

    def place(rows: pd.DataFrame) -> np.ndarray:
        held, out = np.zeros(folds, np.int64), np.zeros(len(rows), np.int32)
        for i in np.argsort(-rows["rows"].to_numpy(), kind="stable"):
            out[i] = held.argmin()
            held[out[i]] += rows["rows"].iloc[i]
        return out

    return _placed(table, group, scope, place)


def stratified_group_folds(
    df: DataFrame, label: str, group: str, folds: int, seed: int = 42, scope: Sequence[str] = ()
) -> DataFrame:
    """Group-disjoint folds in which every class is spread evenly, for groups of one class or several.

    Groups with the most uneven class counts are placed first. Each joins the fold after which the classes' shares
    vary least between folds (mean over the classes of the standard deviation), then the one with fewer rows, then the
    first. The walk sees one row per group and class, not the data.
    """
    table = _class_counts(df, group, label, scope).withColumn("_draw", draw(F.lit(seed), F.col(group)))

    def place(rows: pd.DataFrame) -> np.ndarray:
        counts = [dict(c) for c in rows["counts"]]
        classes = sorted({c for own in counts for c in own})
        matrix = np.array([[own.get(c, 0) for c in classes] for own in counts], float)
        total, held, out = matrix.sum(0), np.zeros((folds, len(classes))), np.zeros(len(rows), np.int32)
        for i in np.argsort(-matrix.std(1).round(9), kind="stable"):
            spread = np.empty(folds)
            for f in range(folds):
                held[f] += matrix[i]
                spread[f] = (held / total).std(0).mean()
                held[f] -= matrix[i]
            out[i] = np.lexsort((held.sum(1), spread.round(9)))[0]
            held[out[i]] += matrix[i]
        return out

    return _placed(table, group, scope, place)


def fold_problems(assigned: DataFrame, label: str, folds: int, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, class, fold) combinations without an experiment; empty when all is well."""
    seen = assigned.groupBy(*scope, label).agg(F.collect_set("fold").alias("_seen"))
    wanted = F.sequence(F.lit(0), F.lit(folds - 1))
    return seen.select(*scope, label, F.explode(F.array_except(wanted, "_seen")).alias("fold"))


def stage_rows(df: DataFrame, levels: Sequence[str] = ("family", "architecture", "variant", "application")) -> DataFrame:
    """Every row once per hierarchy stage: level, parent path and target class."""
    stages = []
    for depth, level in enumerate(levels):
        parent = F.concat_ws("::", *levels[:depth]) if depth else F.lit("all")
        stages.append(F.struct(F.lit(level).alias("level"), parent.alias("parent"), F.col(level).alias("target")))
    return df.withColumn("_stage", F.explode(F.array(*stages))).select("*", "_stage.*").drop("_stage")


def distilled(probs: Column, hard_index: Column, alpha: float, copies: int) -> Column:
    """Copies of a sample per class: ``copies`` shared out by largest remainder.

    The target mixes the hard label with the teacher's softened probabilities.
    """
    target = F.transform(
        probs,
        lambda p, i: F.lit(float(alpha)) * F.when(i == hard_index, 1.0).otherwise(0.0) + (1.0 - float(alpha)) * p,
    )
    total = F.aggregate(target, F.lit(0.0), lambda a, v: a + v)
    scaled = F.transform(target, lambda v: v / total * copies)
    whole = F.transform(scaled, lambda v: F.floor(v).cast("int"))
    left = F.lit(copies) - F.aggregate(whole, F.lit(0), lambda a, v: a + v)
    ranked = F.array_sort(F.transform(scaled, lambda v, i: F.struct((F.floor(v) - v).alias("neg"), i.alias("i"))))
    lucky = F.transform(F.slice(ranked, F.lit(1), F.greatest(left, F.lit(0))), lambda e: e["i"])
    return F.transform(whole, lambda v, i: v + F.array_contains(lucky, i).cast("int"))


def distill_rows(df: DataFrame, probs: str, hard_index: str, classes: Sequence[str], alpha: float, copies: int = 20) -> DataFrame:
    """Weighted pseudo rows: one per (sample, class) with its number of copies."""
    counts = distilled(F.col(probs), F.col(hard_index), alpha, copies)
    rows = df.select("*", F.posexplode(counts).alias("_i", "copies")).where("copies > 0")
    names = F.array(*[F.lit(c) for c in classes])
    return rows.withColumn("pseudo_label", F.get(names, F.col("_i"))).drop("_i")
