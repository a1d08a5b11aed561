"""Grouped evaluation on a small separable table."""

import pytest
from pyspark.sql import functions as F

from traceweave.operators import fisher as FI
from traceweave.operators import models as ML

CFG = ML.ForestConfig(trees=5, depth=4, top_k=1)


@pytest.fixture(scope="module")
def table(spark):
    e = F.floor(F.col("id") / 10)
    df = spark.range(120).select(
        "id",
        F.concat(F.lit("e"), e.cast("string")).alias("experiment_id"),
        F.concat(F.lit("fam_"), (e % 2).cast("string")).alias("family"),
        F.concat(F.lit("arch_"), (e % 4).cast("string")).alias("architecture"),
        F.concat(F.lit("var_"), (e % 4).cast("string")).alias("variant"),
        F.lit("app").alias("application"),
        (e % 2 * 10 + (F.col("id") * 7 % 5)).cast("double").alias("signal"),
        (F.col("id") * 13 % 11).cast("double").alias("noise"),
    )
    return df


def test_separating_feature_first(table):
    scores = {r["feature"]: r["score"] for r in FI.fisher_wide(table, ["noise", "signal"], "family").collect()}
    assert scores["signal"] > 10 * scores["noise"]


def test_out_of_fold(table):
    found, report = ML.out_of_fold(table, ["signal", "noise"], "family", "experiment_id", F.col("id"), CFG)
    rows = found.collect()
    assert report["status"] == "evaluated" and len(rows) == 120
    assert all(r["y_true"] == r["y_pred"] for r in rows)
    assert all(abs(r["prob_fam_0"] + r["prob_fam_1"] - 1) < 1e-9 for r in rows)
    none, report = ML.out_of_fold(table, ["signal"], "application", "experiment_id", F.col("id"), CFG)
    assert none is None and report["status"] == "insufficient_independent_experiments"


def test_hierarchy_save_and_predict(table, spark, tmp_path):
    models = ML.train_hierarchy(table.withColumn("weight", F.lit(1.0)), ["signal", "noise"], "weight", CFG)
    kinds = {(m.level, m.parent): m.kind for m in models}
    assert kinds[("family", "all")] == "forest" and set(k for (lv, _), k in kinds.items() if lv == "application") == {"constant"}
    ML.save_bundle(models, str(tmp_path / "bundle"), spark)
    again = ML.load_bundle(str(tmp_path / "bundle"), spark)
    got = ML.predict_hierarchy(table.select("id", "family", "signal", "noise"), again).collect()
    assert len(got) == 120 and all(r["predicted_family"] == r["family"] for r in got)
    assert all(r["predicted_application"] == "app" and r["application_confidence"] == 1.0 for r in got)
    none = ML.predict_hierarchy(table.select("id", "signal", "noise"), [m for m in again if m.level != "family"])
    assert {r["inference_status"] for r in none.collect()} == {"model_unavailable"}


def test_student_grid(table, spark):
    df = table.select(
        "experiment_id", "signal", "noise",
        F.when(F.col("family") == "fam_0", 0).otherwise(1).alias("hard"),
        F.when(F.col("family") == "fam_0", F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.2), F.lit(0.8))).alias("teacher"),
    )
    best = ML.select_student(df, ["signal"], "teacher", "hard", ["fam_0", "fam_1"], "experiment_id", [(0.5, 2.0), (1.0, 1.0)], folds=2)
    assert best in [(0.5, 2.0), (1.0, 1.0)]


def test_vantage_modes_have_a_status_each(table):
    roles = table.withColumn("source_role", F.when(F.col("id") % 2 == 0, "proxy").otherwise("client"))
    found = ML.cross_vantage_evaluation(roles, ["signal"], "family", "experiment_id", F.col("id"), ML.VANTAGE_MODES, CFG)
    rows = found.collect()
    status = {r["mode"]: r["status"] for r in rows}
    assert status == {
        "client_to_proxy": "evaluated",
        "server_to_proxy": "missing_vantage",
        "both_to_proxy": "missing_vantage",
        "proxy_to_proxy": "evaluated",
    }
    assert all(r["y_true"] == r["y_pred"] for r in rows if r["status"] == "evaluated")
    assert sum(r["mode"] == "client_to_proxy" for r in rows) == 60


def test_every_stage_has_a_row_and_a_status(table):
    """Families are evaluated, an architecture with one experiment per class is only described, one class is constant."""
    few = table.where("experiment_id in ('e0', 'e1', 'e2', 'e3', 'e4')")
    found = ML.hierarchy_evaluation(few, ["signal", "noise"], "experiment_id", F.col("id"), CFG)
    rows = {(r["level"], r["parent"]): r for r in found.collect()}
    assert rows["family", "all"]["status"] == "evaluated" and rows["family", "all"]["accuracy"] == 1.0
    assert rows["architecture", "fam_1"]["status"] == "descriptive_only" and rows["architecture", "fam_1"]["folds"] is None
    assert rows["application", "fam_0::arch_0::var_0"]["status"] == "constant"
    assert len(rows) == 1 + 2 + 4 + 4


def test_grid_of_representations_and_modes(table, spark):
    wide = table.withColumnsRenamed({"signal": "bytes_total", "noise": "iat_sec_mean"}).drop("id").withColumn("row_id", F.monotonically_increasing_id())
    found = ML.evaluation_grid(
        {"overall": wide, "none": wide.limit(0)}, ["client_id"], "experiment_id", F.col("row_id"), cfg=CFG, levels=("family",)
    ).collect()
    rows = {(r["representation"], r["feature_mode"]): r for r in found}
    assert rows["overall", "full"]["accuracy"] == 1.0 > rows["overall", "size_normalized"]["accuracy"]
    assert {rows["none", m]["status"] for m in ("full", "size_normalized")} == {"no_rows"}


def test_importances_are_ranked(table, spark):
    cfg = ML.ForestConfig(trees=5, depth=4, top_k=2)
    models = [ML.train_stage(table.withColumn("weight", F.lit(1.0)), "family", ["noise", "signal"], "weight", cfg)]
    found = ML.feature_importances(models, spark).orderBy("rank").collect()
    assert [r["feature"] for r in found] == ["signal", "noise"] and found[0]["importance"] > 0.8
    assert len(ML.feature_importances(models, spark, top=1).collect()) == 1
