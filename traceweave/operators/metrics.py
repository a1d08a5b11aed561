"""Classification, ranking and anomaly metrics as aggregates.

Everything starts from small tables: confusion cells (one row per true and
predicted class) or threshold counts (one row per distinct score).  Both merge
map side; ordered steps over scores use sliced running sums, so one huge group
is never sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import DEFAULT_LIMIT, exact_quantiles, salted_attach, sequence


def confusion_cells(df: DataFrame, keys: Sequence[str], true: str, pred: str, weight: Column | None = None) -> DataFrame:
    """Observed (true, predicted) pairs with counts."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, F.col(true).alias("true_class"), F.col(pred).alias("pred_class")).agg(n.alias("n"))


def confusion_matrix(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    """Every class pair with its count and share of the true class (0 for unseen rows)."""
    cells = confusion_cells(df, keys, true, pred)
    classes = cells.select(*keys, F.explode(F.array("true_class", "pred_class")).alias("c")).groupBy(*keys).agg(
        F.array_sort(F.collect_set("c")).alias("_classes")
    )
    grid = classes.select(*keys, F.explode("_classes").alias("true_class"), "_classes").select(
        *keys, "true_class", F.explode("_classes").alias("pred_class")
    )
    support = cells.groupBy(*keys, "true_class").agg(F.sum("n").alias("support"))
    return (
        grid.join(cells, [*keys, "true_class", "pred_class"], "left")
        .join(support, [*keys, "true_class"], "left")
        .select(
            *keys,
            "true_class",
            "pred_class",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce(F.col("n") / F.col("support"), F.lit(0.0)).alias("share"),
        )
    )


def per_class(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1, specificity and support of every class seen."""
    n = F.col("n")
    hit = F.when(F.col("true_class") == F.col("pred_class"), n).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("true_class").alias("c"), n.alias("t"), F.lit(0).cast("long").alias("p"), hit.alias("h")),
        F.struct(
            F.col("pred_class").alias("c"), F.lit(0).cast("long").alias("t"), n.alias("p"), F.lit(0).cast("long").alias("h")
        ),
    )
    sides = cells.select(*keys, F.explode(roles).alias("r"))
    counts = sides.groupBy(*keys, F.col("r.c").alias("class")).agg(
        F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.h").alias("tp")
    )
    if keys:
        total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
        counts = counts.join(total, list(keys))
    else:
        counts = counts.withColumn("total", cells.agg(F.sum("n")).scalar())
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    negatives = F.col("total") - support
    return counts.select(
        *keys,
        "class",
        "support",
        "predicted",
        "tp",
        "total",
        X.safe_divide(tp, predicted).alias("precision"),
        X.safe_divide(tp, support).alias("recall"),
        X.safe_divide(2 * tp, support + predicted).alias("f1"),
        X.safe_divide(negatives - (predicted - tp), negatives).alias("specificity"),
    )


def summary(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro and micro scores, MCC and kappa."""
    s = F.max("total").cast("double")
    correct = F.sum("tp").cast("double")
    agree = F.sum(F.col("support").cast("double") * F.col("predicted"))
    spread_t = s * s - F.sum(F.col("support").cast("double") * F.col("support"))
    spread_p = s * s - F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    expected = agree / (s * s)
    root = F.sqrt(spread_t * spread_p)
    return classes.groupBy(*keys).agg(
        (correct / s).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (correct / s).alias("micro_f1"),
        F.when(root > 0, (correct * s - agree) / root).otherwise(F.lit(0.0)).alias("mcc"),
        F.when(expected < 1, (correct / s - expected) / (1 - expected)).otherwise(F.lit(0.0)).alias("kappa"),
        F.max("total").alias("evaluated_samples"),
    )


def classification(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    return summary(per_class(confusion_cells(df, keys, true, pred), keys), keys)


def log_loss(df: DataFrame, keys: Sequence[str], p_true: Column) -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    safe = F.least(F.greatest(p_true, F.lit(1e-15)), F.lit(1.0))
    return df.groupBy(*keys).agg(F.avg(-F.log(safe)).alias("log_loss"))


def experiment_accuracy(df: DataFrame, keys: Sequence[str], experiment: str, true: str, pred: str) -> DataFrame:
    """Mean over experiments of each experiment's accuracy."""
    each = df.groupBy(*keys, experiment).agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("_a"))
    return each.groupBy(*keys).agg(F.avg("_a").alias("experiment_accuracy"), F.count(F.lit(1)).alias("experiments"))


# ---- score thresholds -------------------------------------------------------


def threshold_counts(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """Rows and positives per distinct score."""
    positive = (F.col(truth) == 1).cast("long")
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(positive).alias("pos")
    )


def _cumulative(counts: DataFrame, keys: Sequence[str], falling: bool, limit: int) -> DataFrame:
    order = "_falling" if falling else "score"
    table = counts.withColumn("_falling", -F.col("score"))
    ordered = sequence(table, keys, [order], limit)
    return ordered.running_sum({"cum_n": F.col("n"), "cum_pos": F.col("pos")}).rows().drop("_falling")


def _with_totals(table: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    return salted_attach(table, totals, keys, F.col("score"), how="inner")


def average_ranks(df: DataFrame, keys: Sequence[str], score: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rank of every row with ties averaged."""
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sequence(counts, keys, [score], limit).running_sum({"_upto": F.col("_n")}).rows()
    ranks = ranks.select(*keys, score, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("average_rank"))
    return df.join(ranks, [*keys, score])


def auroc(df: DataFrame, keys: Sequence[str], truth: str, score: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rank-sum AUROC with averaged ties; null when a class is absent."""
    counts = threshold_counts(df, keys, truth, score)
    up = _cumulative(counts, keys, False, limit)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2.0
    sums = up.groupBy(*keys).agg(
        F.sum(rank * F.col("pos")).alias("_r"),
        F.sum("pos").cast("double").alias("positives"),
        F.sum(F.col("n") - F.col("pos")).cast("double").alias("negatives"),
    )
    p, q = F.col("positives"), F.col("negatives")
    return sums.select(
        *keys,
        F.when((p > 0) & (q > 0), (F.col("_r") - p * (p + 1) / 2) / (p * q)).alias("auroc"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], truth: str, score: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Area under the precision-recall steps; rows of one score move together."""
    counts = threshold_counts(df, keys, truth, score)
    down = _cumulative(counts, keys, True, limit)
    return down.groupBy(*keys).agg(
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.sum("pos")).alias("average_precision")
    )


def curve_points(df: DataFrame, keys: Sequence[str], truth: str, score: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """ROC and precision-recall point at every distinct score, from high to low."""
    counts = threshold_counts(df, keys, truth, score)
    table = _with_totals(_cumulative(counts, keys, True, limit), counts, keys)
    tp, seen = F.col("cum_pos"), F.col("cum_n")
    return table.select(
        *keys,
        "score",
        X.safe_divide(tp, F.col("_p")).alias("tpr"),
        X.safe_divide(seen - tp, F.col("_n") - F.col("_p")).alias("fpr"),
        X.safe_divide(tp, seen).alias("precision"),
    )


def precision_at_k(
    df: DataFrame, keys: Sequence[str], truth: str, score: str, tie: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Position, hits so far and precision in falling score order (ties by ``tie``)."""
    rows = df.withColumn("_falling", -F.col(score).cast("double"))
    ordered = sequence(rows, keys, ["_falling", tie], limit).numbered("k")
    ordered = ordered.running_sum({"cumulative_tp": (F.col(truth) == 1).cast("long")})
    return ordered.rows().drop("_falling").withColumn("precision_at_k", F.col("cumulative_tp") / F.col("k"))


def stable_average_precision(
    df: DataFrame, keys: Sequence[str], truth: str, score: str, tie: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Mean precision at the positions of the positives, rows taken one by one."""
    rows = precision_at_k(df, keys, truth, score, tie, limit)
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col(truth) == 1, F.col("precision_at_k"))).alias("auprc"))


def multiclass_scores(
    df: DataFrame, keys: Sequence[str], truth: str, probs: Sequence[str], classes: Sequence[str], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """One-vs-rest AUROC and AP per class, plus macro and micro rows."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("class"), (F.col(truth) == c).cast("int").alias("y"), F.col(p).alias("s"))
            for p, c in zip(probs, classes)
        ]
    )
    long = df.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.class", "r.y", "r.s")
    both = long.unionByName(long.withColumn("class", F.lit("micro")))
    k = [*keys, "class"]
    each = auroc(both, k, "y", "s", limit).join(average_precision(both, k, "y", "s", limit), k)
    macro = each.where("class <> 'micro'").groupBy(*keys).agg(
        F.avg("auroc").alias("auroc"), F.avg("average_precision").alias("average_precision")
    )
    return each.unionByName(macro.withColumn("class", F.lit("macro")).select(*each.columns))


def anomaly_evaluation(
    calibration: DataFrame,
    scored: DataFrame,
    keys: Sequence[str],
    truth: str,
    score: str,
    percentile: float = 95.0,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Threshold from normal calibration rows per key, then binary metrics above it."""
    normal = calibration.where(F.col(truth) == 0)
    tau = exact_quantiles(normal, keys, score, [percentile / 100.0], ["threshold"], limit)
    rows = salted_attach(scored, tau, keys, F.col(score), how="inner")
    y, p = F.col(truth) == 1, F.col(score) > F.col("threshold")
    tp, fp, fn, tn = (F.count(F.when(c, 1)) for c in (y & p, ~y & p, y & ~p, ~y & ~p))
    cells = rows.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        F.avg(F.when(~y, F.col(score))).alias("normal_error_mean"),
        F.avg(F.when(y, F.col(score))).alias("anomaly_error_mean"),
    )
    c = F.col
    return cells.withColumns(
        {
            "accuracy": (c("tp") + c("tn")) / (c("tp") + c("tn") + c("fp") + c("fn")),
            "precision": X.safe_divide(c("tp"), c("tp") + c("fp")),
            "recall": X.safe_divide(c("tp"), c("tp") + c("fn")),
            "f1": X.safe_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        }
    )


def late_fusion(df: DataFrame, keys: Sequence[str], probs: Sequence[str], classes: Sequence[str], truth: str) -> DataFrame:
    """Mean probability per key, first best class; one true class per key or an error."""
    means = [F.avg(p).alias(p) for p in probs]
    same = F.when(F.min(truth) == F.max(truth), F.min(truth)).otherwise(
        F.raise_error(F.lit("a fused key has several true classes"))
    )
    fused = df.groupBy(*keys).agg(*means, same.alias("y_true"), F.count(F.lit(1)).alias("observations"))
    all_probs = F.array(*[F.col(p) for p in probs])
    best = F.array_position(all_probs, F.array_max(all_probs)).cast("int")
    return fused.withColumn("y_pred", F.element_at(F.array(*[F.lit(c) for c in classes]), best))
