"""Model queries over vectors and trace features (row checks, tested for invariants)."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query
from traceweave.catalog.evaluation import hierarchy_labels
from traceweave.catalog.tables import BURST_GAP, DAY, IDLE, parsed_packets, table
from traceweave.functions.exprs import rounded
from traceweave.operators import features as FE
from traceweave.operators import models as ML
from traceweave.session import cut_lineage

QUICK = ML.ForestConfig(trees=20, depth=6)


def vectors(spark, sf_dir):
    """embeddings as a feature table: 64 columns, a class and an experiment."""
    df = table(spark, sf_dir, "embeddings")
    experiment = F.concat(F.lit("exp_"), ((F.col("vec_id") % 20) * 100 + F.col("label")).cast("string"))
    return df.select(
        "vec_id",
        F.concat(F.lit("class_"), (F.col("label") % 3).cast("string")).alias("family"),
        experiment.alias("experiment_id"),
        F.when(F.col("vec_id") % 2 == 0, "proxy").otherwise("client").alias("source_role"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i:02d}") for i in range(64)],
    )


NAMES = [f"f{i:02d}" for i in range(64)]


@query()
def stage_out_of_fold(spark, sf_dir):
    """Out-of-fold class probabilities of every vector."""
    found, _ = ML.out_of_fold(vectors(spark, sf_dir), NAMES, "family", "experiment_id", F.col("vec_id"), QUICK, 3)
    return rounded(found.select("vec_id", "experiment_id", "fold", "y_true", "y_pred", "prob_class_0", "prob_class_1", "prob_class_2"))


@query()
def teacher_crossfit(spark, sf_dir):
    found, _ = ML.crossfit_teacher(
        vectors(spark, sf_dir), NAMES, "family", "experiment_id", F.col("vec_id"), ML.ForestConfig(trees=20, depth=6, top_k=64)
    )
    return rounded(found.select("vec_id", "fold", "y_true", "y_pred", "prob_class_0", "prob_class_1", "prob_class_2"))


def trace_rows(spark, sf_dir):
    rows = FE.feature_rows(parsed_packets(spark, sf_dir), [7 * DAY], BURST_GAP, IDLE)
    return cut_lineage(hierarchy_labels(rows))


TRACE_FEATURES = list(FE.PREDICTORS)
#: Every stage is fitted once per fold in `hierarchy_metrics`; the full list takes it several minutes (see README).
SOME_FEATURES = ["packet_count_total", "bytes_total", "iat_sec_mean", "packet_size_mean", "packet_size_std", "burst_count_total"]


@query()
def hierarchy_prediction(spark, sf_dir):
    """Family, architecture, variant and application of every trace."""
    rows = trace_rows(spark, sf_dir)
    train = rows.where("row_type = 'window'").withColumn("weight", F.lit(1.0))
    models = ML.train_hierarchy(train, TRACE_FEATURES, "weight", ML.ForestConfig(trees=5, depth=4, top_k=4))
    whole = rows.where("row_type = 'overall'").select("experiment_id", "client_id", *TRACE_FEATURES)
    return rounded(ML.predict_hierarchy(whole, models).drop(*TRACE_FEATURES))


@query()
def hierarchy_metrics(spark, sf_dir):
    """Out-of-fold metrics, or the status, of every stage of all four levels over weekly windows."""
    rows = trace_rows(spark, sf_dir).where("row_type = 'window'")
    found = ML.hierarchy_evaluation(
        rows, SOME_FEATURES, "experiment_id", F.struct("client_id", "window_index"),
        ML.ForestConfig(trees=5, depth=4, top_k=4),
    )
    return rounded(found)


@query()
def cross_vantage_oof(spark, sf_dir):
    found = ML.cross_vantage_evaluation(
        vectors(spark, sf_dir), NAMES, "family", "experiment_id", F.col("vec_id"), ML.VANTAGE_MODES,
        ML.ForestConfig(trees=10, depth=5),
    )
    return found


@query()
def student_prediction(spark, sf_dir):
    """A student network distilled from cross-fitted teacher probabilities."""
    df = vectors(spark, sf_dir)
    found, report = ML.crossfit_teacher(
        df, NAMES, "family", "experiment_id", F.col("vec_id"), ML.ForestConfig(trees=10, depth=5, top_k=64)
    )
    classes = report["classes"]
    taught = cut_lineage(
        df.select("vec_id", *NAMES).join(
            found.select(
                "vec_id",
                "experiment_id",
                F.array(*[F.col(f"prob_{c}") for c in classes]).alias("teacher"),
                (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true")) - 1).cast("int").alias("hard"),
            ),
            "vec_id",
        )
    )
    model = ML.train_student(taught, NAMES, "teacher", "hard", classes, 0.5, 2.0)
    return rounded(model.predict(taught, "student_label", "confidence").select("vec_id", "student_label", "confidence"))
