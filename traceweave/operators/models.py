"""Grouped evaluation and hierarchical classifiers on pyspark.ml.

Data steps are DataFrame jobs; only class names, folds and feature names (short
lists) steer the driver loop over stages and folds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators import dataset, fisher, metrics
from traceweave.operators.dataset import LEVELS
from traceweave.session import cut_lineage

TREES = 300
TEACHER_TREES = 500
DEPTH = 10
SEED = 42


@dataclass
class ForestConfig:
    trees: int = TREES
    depth: int = DEPTH
    min_leaf: int = 2
    top_k: int = fisher.TOP_FEATURES
    seed: int = SEED


@dataclass
class StageModel:
    """A classifier of one hierarchy stage: unavailable, constant or fitted."""

    level: str
    parent: str
    classes: list[str]
    features: list[str] = field(default_factory=list)
    model: PipelineModel | None = None

    @property
    def kind(self) -> str:
        return "unavailable" if not self.classes else "constant" if self.model is None else "forest"

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``probs``, an array in the order of ``classes``."""
        if self.kind == "unavailable":
            return df.withColumn("probs", F.lit(None).cast("array<double>"))
        if self.kind == "constant":
            return df.withColumn("probs", F.array(F.lit(1.0)))
        scored = self.model.transform(df)
        return scored.withColumn("probs", vector_to_array("probability")).select(*df.columns, "probs")

    def predict(self, df: DataFrame, label: str, confidence: str) -> DataFrame:
        """First most probable class and its probability; null and 0 without a model."""
        names = F.array(*[F.lit(c) for c in self.classes]) if self.classes else F.lit(None).cast("array<string>")
        top = F.array_max("probs")
        return self.probabilities(df).withColumns(
            {
                label: F.get(names, (F.array_position("probs", top) - 1).cast("int")),
                confidence: F.coalesce(top, F.lit(0.0)),
            }
        ).drop("probs")


def class_list(df: DataFrame, label: str) -> list[str]:
    """Distinct classes; bounded by the label domain, not by the rows."""
    return sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)


def balanced(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Scale row weights so that every class has the same total."""
    totals = {r[label]: r["_t"] for r in df.groupBy(label).agg(F.sum(weight).alias("_t")).collect()}
    totals = {k: v for k, v in totals.items() if k is not None and v}
    if not totals:
        return df.where(F.col(label).isNotNull())
    # One entry per class, written into the expression: rows are not shuffled onto a few class values.
    share = sum(totals.values()) / len(totals)
    factors = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, share / v)])
    return df.where(F.col(label).isin(list(totals))).withColumn(weight, F.col(weight) * factors[F.col(label)])


def forest_pipeline(features: Sequence[str], label: str, classes: Sequence[str], weight: str, cfg: ForestConfig) -> Pipeline:
    indexer = StringIndexerModel.from_labels(list(classes), label, "_label", handleInvalid="skip")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    forest = RandomForestClassifier(
        featuresCol="_features",
        labelCol="_label",
        weightCol=weight,
        numTrees=cfg.trees,
        maxDepth=cfg.depth,
        minInstancesPerNode=cfg.min_leaf,
        seed=cfg.seed,
    )
    return Pipeline(stages=[assembler, indexer, forest])


def scoring_model(fitted: PipelineModel) -> PipelineModel:
    """The fitted pipeline without the label indexer, so it scores unlabelled rows."""
    return PipelineModel([s for s in fitted.stages if not isinstance(s, StringIndexerModel)])


def train_stage(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    weight: str,
    cfg: ForestConfig,
    level: str = "family",
    parent: str = "all",
) -> StageModel:
    """No class: unavailable; one class: constant; else a forest on the best features."""
    classes = class_list(df, label)
    if len(classes) < 2:
        return StageModel(level, parent, classes)
    ranked = fisher.top_features(
        fisher.fisher_wide(df, features, label, weight).withColumn("_s", F.lit(1)), ["_s"], cfg.top_k
    )
    chosen = [r["feature"] for r in ranked.orderBy("rank").select("feature", "rank").collect()]
    fitted = forest_pipeline(chosen, label, classes, weight, cfg).fit(balanced(df, label, weight))
    return StageModel(level, parent, classes, chosen, scoring_model(fitted))


def stage_parents(df: DataFrame, depth: int) -> list[tuple]:
    """Observed label paths above a level (short list)."""
    if depth == 0:
        return [()]
    return sorted(tuple(r) for r in df.select(*LEVELS[:depth]).distinct().collect())


def of_parent(df: DataFrame, path: Sequence[str], columns: Sequence[str]) -> DataFrame:
    condition = F.lit(True)
    for column, value in zip(columns, path):
        condition = condition & (F.col(column) == value)
    return df.where(condition)


def train_hierarchy(df: DataFrame, features: Sequence[str], weight: str, cfg: ForestConfig) -> list[StageModel]:
    """One model per (level, parent path) of the label hierarchy."""
    df = df.persist()
    models = []
    for depth, level in enumerate(LEVELS):
        for path in stage_parents(df, depth):
            rows = of_parent(df, path, LEVELS[:depth])
            models.append(train_stage(rows, level, features, weight, cfg, level, "::".join(path) or "all"))
    df.unpersist()
    return models


def predict_hierarchy(df: DataFrame, models: Sequence[StageModel]) -> DataFrame:
    """The predicted parent selects the child model; a missing one gives null and 0."""
    by_stage = {(m.level, m.parent): m for m in models}
    out = df.withColumn("_path", F.lit("all"))
    for depth, level in enumerate(LEVELS):
        label, confidence = f"predicted_{level}", f"{level}_confidence"
        parents = sorted(p for lv, p in by_stage if lv == level)
        parts = [by_stage[(level, p)].predict(out.where(F.col("_path") == p), label, confidence) for p in parents]
        missing = out.where(~F.col("_path").isin(parents) | F.col("_path").isNull())
        parts.append(missing.withColumns({label: F.lit(None).cast("string"), confidence: F.lit(0.0)}))
        joined = parts[0]
        for part in parts[1:]:
            joined = joined.unionByName(part)
        step = F.col(label) if depth == 0 else F.concat_ws("::", "_path", label)
        out = joined.withColumn("_path", F.when(F.col(label).isNotNull(), step))
    return out.drop("_path").withColumn(
        "inference_status", F.when(F.col("predicted_family").isNull(), "model_unavailable").otherwise("ok")
    )


def save_bundle(models: Sequence[StageModel], folder: str, spark) -> None:
    """Pipelines under the stage path and a manifest table next to them."""
    rows = []
    for m in models:
        path = f"{folder}/{m.level}/{m.parent.replace('::', '/')}"
        if m.model is not None:
            m.model.write().overwrite().save(path)
        rows.append((m.level, m.parent, m.kind, m.classes, m.features, path))
    schema = "level string, parent string, kind string, classes array<string>, features array<string>, path string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def load_bundle(folder: str, spark) -> list[StageModel]:
    models = []
    for r in spark.read.parquet(f"{folder}/manifest").collect():
        model = PipelineModel.load(r["path"]) if r["kind"] == "forest" else None
        models.append(StageModel(r["level"], r["parent"], list(r["classes"]), list(r["features"]), model))
    return models


# ---- out-of-fold evaluation ---------------------------------------------------


def out_of_fold(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    experiment: str,
    spread: Column,
    cfg: ForestConfig | None = None,
    most_folds: int = 5,
) -> tuple[DataFrame | None, dict]:
    """(predictions, report): every row is scored by a model that never saw its experiment.

    Classes with a single experiment are left out and reported.  Features are
    ranked inside each training fold, with every experiment weighted equally.
    """
    cfg = cfg or ForestConfig()
    classes = dataset.eligible_classes(df, label, experiment)
    counts = {r[label]: (r["experiments"], r["eligible"]) for r in classes.collect()}
    kept = sorted(c for c, (_, ok) in counts.items() if ok)
    report = {"excluded_classes": sorted(c for c, (_, ok) in counts.items() if not ok), "classes": kept}
    if len(kept) < 2:
        return None, report | {"status": "insufficient_independent_experiments"}
    rows = df.where(F.col(label).isin(kept))
    folds = min([most_folds] + [counts[c][0] for c in kept])
    assigned = fisher.experiment_folds(rows, label, experiment, folds, cfg.seed).select(experiment, "fold")
    # Read once per fold; the copy lies in the shared folder and goes with its last reference.
    rows = cut_lineage(fisher.experiment_weights(rows.join(assigned, experiment), experiment, spread))
    parts = []
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        model = train_stage(train, label, features, "weight", cfg)
        scored = model.probabilities(test)
        known = F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes]), F.col("probs"))
        parts.append(scored.withColumn("probs", X.align_probabilities(known, kept)))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    names = F.array(*[F.lit(c) for c in kept])
    top = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    predictions = predictions.select(
        *[c for c in df.columns if c not in features],
        "fold",
        F.col(label).alias("y_true"),
        F.get(names, top).alias("y_pred"),
        *[F.get("probs", F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(kept)],
    )
    return predictions, report | {"status": "evaluated", "folds": folds}


def descriptive(df: DataFrame, features: Sequence[str], label: str, weight: str, cfg: ForestConfig) -> DataFrame:
    """In-sample fit for stages without enough experiments, marked as such."""
    model = train_stage(df, label, features, weight, cfg)
    return model.predict(df, "y_pred", "confidence").withColumn("status", F.lit("descriptive_only"))


def _stage_row(
    rows: DataFrame, features: Sequence[str], level: str, parent: str, experiment: str, spread: Column, cfg: ForestConfig
) -> DataFrame:
    """One row for a stage: metrics where it can be evaluated or at least fitted, and the status that says which.

    ``evaluated``: out of fold; ``descriptive_only``: in sample, for want of independent experiments; ``constant``: one
    class; ``unavailable``: none.
    """
    scope = [F.lit(level).alias("level"), F.lit(parent).alias("parent")]
    predictions, report = out_of_fold(rows, features, level, experiment, spread, cfg)
    status, folds = report["status"], report.get("folds")
    if predictions is None:
        classes = class_list(rows, level)
        if len(classes) < 2:
            status = "constant" if classes else "unavailable"
            return rows.sparkSession.createDataFrame([(level, parent, status)], "level string, parent string, status string")
        status = "descriptive_only"
        weighted = cut_lineage(fisher.experiment_weights(rows.where(F.col(level).isNotNull()), experiment, spread))
        predictions = descriptive(weighted, features, level, "weight", cfg).withColumn("y_true", F.col(level))
    found = predictions.select(*scope, "y_true", "y_pred")
    found = metrics.classification(found, ["level", "parent"], "y_true", "y_pred")
    return found.withColumns({"folds": F.lit(folds).cast("int"), "status": F.lit(status)})


def hierarchy_evaluation(
    df: DataFrame,
    features: Sequence[str],
    experiment: str,
    spread: Column,
    cfg: ForestConfig | None = None,
    levels: Sequence[str] = LEVELS,
) -> DataFrame | None:
    """Metrics and status of every stage (one row each)."""
    results = None
    for depth, level in enumerate(levels):
        for path in stage_parents(df, depth):
            rows = of_parent(df, path, LEVELS[:depth])
            row = _stage_row(rows, features, level, "::".join(path) or "all", experiment, spread, cfg or ForestConfig())
            results = row if results is None else results.unionByName(row, allowMissingColumns=True)
    return results


def evaluation_grid(
    representations: Mapping[str, DataFrame],
    trace: Sequence[str],
    experiment: str,
    spread: Column,
    feature_modes: Sequence[str] = ("full", "size_normalized"),
    cfg: ForestConfig | None = None,
    levels: Sequence[str] = LEVELS,
) -> DataFrame | None:
    """A row per representation, feature mode and stage.

    ``representations`` are labelled feature tables by name (whole traces, windows of one scale, packet blocks of one K,
    rounds); their predictors are the columns that the policy leaves of those a mode keeps. A representation without
    rows or predictors has one row that says so.
    """
    results = None
    for name, table in representations.items():
        for mode in feature_modes:
            kept = dataset.feature_mode(table, mode)
            columns = [c for c in kept.columns if c not in (*trace, *LEVELS)]
            features = [c for c, role in dataset.column_roles(columns).items() if role == "predictor"]
            if not features or kept.isEmpty():
                status = "no_predictors" if kept.head(1) else "no_rows"
                rows = table.sparkSession.createDataFrame([(status,)], "status string")
            else:
                rows = hierarchy_evaluation(kept, features, experiment, spread, cfg, levels)
            rows = rows.select(F.lit(name).alias("representation"), F.lit(mode).alias("feature_mode"), "*")
            results = rows if results is None else results.unionByName(rows, allowMissingColumns=True)
    return results


def feature_importances(models: Sequence[StageModel], spark, top: int = 25) -> DataFrame:
    """level, parent, rank, feature, importance: the `top` columns of each fitted stage, ties by name."""
    rows = []
    for m in models:
        if m.model is not None:
            weights = m.model.stages[-1].featureImportances.toArray().tolist()
            ranked = sorted(zip(m.features, weights, strict=True), key=lambda x: (-x[1], x[0]))[:top]
            rows += [(m.level, m.parent, i, name, float(w)) for i, (name, w) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "level string, parent string, rank int, feature string, importance double")


VANTAGE_ROLES = {
    "client_to_proxy": ["client"],
    "server_to_proxy": ["server"],
    "both_to_proxy": ["client", "server"],
    "proxy_to_proxy": ["proxy"],
}
VANTAGE_MODES = tuple(VANTAGE_ROLES)


def _vantage_mode(
    df: DataFrame, features: Sequence[str], label: str, experiment: str, spread: Column, mode: str, cfg: ForestConfig
) -> DataFrame:
    kind = df.schema[label].dataType.simpleString()
    schema = f"mode string, y_true {kind}, y_pred string, fold int, status string"

    def only(status: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(mode, None, None, None, status)], schema)

    present = {r[0] for r in df.select("source_role").distinct().collect()}  # three roles
    if not {"proxy", *VANTAGE_ROLES[mode]} <= present:
        return only("missing_vantage")
    train_all, test_all = dataset.cross_vantage(df, VANTAGE_ROLES[mode], label, experiment)
    train_all, test_all = dataset.keep_eligible(train_all, label, experiment), dataset.keep_eligible(test_all, label, experiment)
    counts = [r["experiments"] for r in dataset.eligible_classes(test_all, label, experiment).collect()]
    if not counts:
        return only("no_shared_experiments")
    if len(counts) < 2 or min(counts) < 2:
        return only("insufficient_independent_experiments")
    folds = min(5, *counts)
    assigned = fisher.experiment_folds(test_all, label, experiment, folds, cfg.seed).select(experiment, "fold")
    train_all, test_all = train_all.join(assigned, experiment), test_all.join(assigned, experiment)
    train_all = cut_lineage(fisher.experiment_weights(train_all, experiment, spread))
    results = None
    for fold in range(folds):
        model = train_stage(train_all.where(F.col("fold") != fold), label, features, "weight", cfg)
        part = model.predict(test_all.where(F.col("fold") == fold), "y_pred", "confidence").select(
            F.lit(mode).alias("mode"),
            F.col(label).alias("y_true"),
            "y_pred",
            F.col("fold").cast("int").alias("fold"),
            F.lit("evaluated").alias("status"),
        )
        results = part if results is None else results.unionByName(part)
    return results


def cross_vantage_evaluation(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    experiment: str,
    spread: Column,
    modes: Sequence[str],
    cfg: ForestConfig | None = None,
) -> DataFrame | None:
    """Train on endpoint or proxy rows, test on proxy rows of other experiments.

    A row per tested row with status ``evaluated``; a mode that cannot be evaluated has one row that says why.
    """
    cfg = cfg or ForestConfig()
    results = None
    for mode in modes:
        found = _vantage_mode(df, features, label, experiment, spread, mode, cfg)
        results = found if results is None else results.unionByName(found)
    return results


# ---- teacher and student --------------------------------------------------------


def crossfit_teacher(
    df: DataFrame, features: Sequence[str], label: str, experiment: str, spread: Column, cfg: ForestConfig | None = None
) -> tuple[DataFrame | None, dict]:
    """Teacher probabilities of each row from models without its experiment."""
    cfg = cfg or ForestConfig(trees=TEACHER_TREES, top_k=len(features))
    return out_of_fold(df, features, label, experiment, spread, cfg)


def student_pipeline(features: Sequence[str], label: str, classes: Sequence[str], hidden: Sequence[int] = (32,), iterations: int = 100) -> Pipeline:
    """Median imputation, scaling and a small neural network."""
    filled = [f"_i_{f}" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="error"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
            StringIndexerModel.from_labels(list(classes), label, "_label", handleInvalid="skip"),
            MultilayerPerceptronClassifier(
                featuresCol="_features",
                labelCol="_label",
                layers=[len(features), *hidden, len(classes)],
                maxIter=iterations,
                seed=SEED,
            ),
        ]
    )


def train_student(
    df: DataFrame, features: Sequence[str], probs: str, hard_index: str, classes: Sequence[str], alpha: float, temperature: float
) -> StageModel:
    """A student fitted on pseudo rows that share out the softened teacher targets."""
    soft = df.withColumn(probs, X.soften(F.col(probs), temperature))
    pseudo = fisher.distill_rows(soft, probs, hard_index, classes, alpha)
    pseudo = pseudo.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_copy")
    fitted = student_pipeline(features, "pseudo_label", classes).fit(pseudo)
    return StageModel("student", "all", list(classes), list(features), scoring_model(fitted))


def select_student(
    df: DataFrame,
    features: Sequence[str],
    probs: str,
    hard_index: str,
    classes: Sequence[str],
    experiment: str,
    grid: Sequence[tuple[float, float]],
    folds: int = 3,
) -> tuple[float, float]:
    """(alpha, temperature) with the best experiment-fused score in inner folds."""
    names = F.array(*[F.lit(c) for c in classes])
    rows = df.withColumn("y_true", F.get(names, F.col(hard_index)))
    assigned = fisher.experiment_folds(rows, "y_true", experiment, folds).select(experiment, "fold")
    rows = rows.join(assigned, experiment).persist()
    scores = []
    for alpha, temperature in grid:
        fused = None
        for fold in range(folds):
            model = train_student(rows.where(F.col("fold") != fold), features, probs, hard_index, classes, alpha, temperature)
            scored = model.probabilities(rows.where(F.col("fold") == fold).drop(probs))
            wide = scored.select(experiment, "y_true", *[F.get("probs", F.lit(i)).alias(f"p{i}") for i in range(len(classes))])
            part = metrics.late_fusion(wide.withColumnRenamed("y_true", "truth"), [experiment], [f"p{i}" for i in range(len(classes))], classes, "truth")
            fused = part if fused is None else fused.unionByName(part)
        got = metrics.classification(fused, [], "y_true", "y_pred").select("balanced_accuracy", "macro_f1").first()
        scores.append(((got[0], got[1], alpha), (alpha, temperature)))
    rows.unpersist()
    return max(scores)[1]
