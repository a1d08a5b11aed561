"""Column policy, partitions, sinks and guards."""

import json

import pytest
from pyspark.sql import functions as F

from traceweave.operators import dataset as D
from traceweave.operators import fisher as FI
from traceweave.operators import identity as I
from traceweave.operators import sampling as S
from traceweave.operators import vectors as V
from traceweave.sources import scan, sinks


def test_predictors():
    names = ["experiment_id", "row_type", "packet_information_ok", "bytes_total"]
    assert D.predictors_of(names) == ["bytes_total"]
    for bad in ("loss", "gpu_usage_percent", "Family"):
        with pytest.raises(D.PolicyError):
            D.predictors_of([*names, bad])
        assert D.leakage([*names, bad]) == [bad]
    with pytest.raises(D.PolicyError):
        D.predictors_of(["experiment_id", "row_type"])
    with pytest.raises(D.PolicyError):
        D.predictors_of(["bytes_total"])


def test_teacher_and_student_columns():
    assert D.teacher_columns(["cpu_mean", "train_loss_mean"]) == ["cpu_mean"]
    assert D.student_columns(["row_id", "packet_count_total", "bytes_total", "loss"]) == ["packet_count_total", "bytes_total"]


def test_union_rejects_drift(spark):
    a = spark.createDataFrame([("r", 1.0)], "experiment_id string, bytes_total double")
    b = spark.createDataFrame([("r", 1.0)], "experiment_id string, bytes_up double")
    with pytest.raises(D.PolicyError):
        D.union_parts([a, b])


def test_local_deployment_fails(spark):
    rows = spark.createDataFrame([("Local",)], "deployment string")
    with pytest.raises(Exception, match="local deployment"):
        D.reject_local(rows).collect()


def test_registration_conflict(spark):
    schema = "run_id string, event string, local_ip string, local_port string, client_id string"
    rows = [("r", I.REGISTERED, "1.1.1.1", "5", "a"), ("r", I.CONFIRMED, "1.1.1.1", "5", "b")]
    with pytest.raises(Exception, match="two clients"):
        I.registrations(spark.createDataFrame(rows, schema)).collect()


def test_fold_leak_and_coverage(spark):
    df = spark.createDataFrame([(f"e{i}", f"c{i % 3}") for i in range(30)], "e string, c string")
    folds = FI.experiment_folds(df, "c", "e", 5)
    assert folds.count() == 30
    assert FI.fold_problems(folds, "c", 5).count() == 0
    D.assert_disjoint(folds.where("fold = 0"), folds.where("fold <> 0"), "e")
    with pytest.raises(D.PolicyError):
        D.assert_disjoint(folds, folds, "e")
    two = spark.createDataFrame([("e", "a"), ("e", "b")], "e string, c string")
    with pytest.raises(Exception, match="several labels"):
        FI.experiment_folds(two, "c", "e", 2).collect()


@pytest.mark.parametrize("clients", [3, 40])
def test_dirichlet_split(spark, clients):
    rows = spark.range(200).select("id", (F.col("id") % 4).cast("int").alias("y"))
    parts = S.dirichlet_partitions(rows, "id", "y", clients, 0.2, 5)
    got = parts.collect()
    assert sorted(r["id"] for r in got) == list(range(200))
    assert {r["client_index"] for r in got} == set(range(clients))
    again = S.dirichlet_partitions(rows, "id", "y", clients, 0.2, 5).collect()
    assert sorted((r["id"], r["client_index"]) for r in got) == sorted((r["id"], r["client_index"]) for r in again)


def test_partition_names():
    assert S.partition_token("IID") == "iid" and S.partition_token("non-iid", 0.5) == "non_iid_alpha_0p5"
    for bad in (("non_iid", None), ("non_iid", -1.0), ("odd", 1.0)):
        with pytest.raises(ValueError):
            S.normalize_partition_type(*bad)


def test_weighted_mean_checks_length(spark):
    schema = "r int, v array<double>, n int"
    good = spark.createDataFrame([(1, [1.0, 3.0], 1), (1, [4.0, 6.0], 2)], schema)
    vector = V.assemble_vectors(V.weighted_elements(good, ["r"], "v", "n"), ["r"]).first()["values"]
    assert vector == pytest.approx([3.0, 5.0])
    whole = V.weighted_elements(good, ["r"], "v", "n", integer=F.lit(True))
    assert V.assemble_vectors(whole, ["r"]).first()["values"] == [3.0, 5.0]
    bad = spark.createDataFrame([(1, [1.0], 1), (1, [4.0, 6.0], 2)], schema)
    with pytest.raises(Exception, match="differ in length"):
        V.weighted_elements(bad, ["r"], "v", "n").collect()


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(1, "r", 2.0)], "row_id int, experiment_id string, bytes_total double")
    y = spark.createDataFrame([(1, "a")], "row_id int, family string")
    sinks.write_dataset(x, y, ["bytes_total"], f"{tmp_path}/d")
    declared = json.loads((tmp_path / "d" / "schema.json").read_text())
    assert declared == {"predictors": ["bytes_total"], "metadata": ["row_id", "experiment_id"], "labels": ["family"]}
    target = f"{tmp_path}/out"
    assert sinks.publish(x, target, lambda df: []) is None
    backup = sinks.publish(x.withColumn("bytes_total", F.lit(9.0)), target, lambda df: [])
    assert backup and spark.read.parquet(target).first()["bytes_total"] == 9.0
    with pytest.raises(ValueError):
        sinks.publish(x, target, lambda df: ["bad"])
    assert spark.read.parquet(target).first()["bytes_total"] == 9.0
    sinks.write_by_partition(x, "iid", f"{tmp_path}/p")
    sinks.write_by_partition(x, "non_iid_alpha_0p5", f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_file_sources(spark, tmp_path):
    line = "1\t10.5\t100\t1.1.1.1\t2.2.2.2\t\t\t5\t80\t\t\t6\t\t0x12\n2\t10.25\t60\n"
    (tmp_path / "a.tsv").write_text(line)
    rows = {r["packet_index"]: r for r in scan.read_decoded(spark, f"{tmp_path}/a.tsv").collect()}
    assert (rows[1]["tcp_syn"], rows[1]["tcp_ack"], rows[1]["src_port"]) == (1, 1, 5)
    assert rows[2]["transport_protocol"] == "OTHER" and rows[2]["src_ip"] == ""
    (tmp_path / "bad.csv").write_text("packet_index\n1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        scan.read_raw_packets(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "e.jsonl").write_text('{"run_id":"r"}\nnot json\n')
    assert scan.read_events(spark, f"{tmp_path}/e.jsonl", "run_id string", strict=False).where("run_id = 'r'").count() == 1
    with pytest.raises(Exception):
        scan.read_events(spark, f"{tmp_path}/e.jsonl", "run_id string").collect()
    chunk = tmp_path / "chunk_1"
    chunk.mkdir()
    manifest = {
        "experiment_id": "r",
        "capture": {"capture_start_epoch": 5.0},
        "outputs": {"per_client": {"a": {"client_ip": "1.1.1.1", "client_port": 7, "packet_count": 3, "trace_start_offset_sec": 0.5}}},
    }
    (chunk / "x_manifest.json").write_text(json.dumps(manifest))
    found = scan.read_manifests(spark, str(tmp_path)).first()
    assert (found["run_id"], found["client_port"], found["base_epoch"]) == ("r", 7, 5.5)
    (tmp_path / "c1.pcap").write_bytes(b"abc")
    (tmp_path / "c2.pcap").write_bytes(b"")
    chunks = scan.chunk_summary(scan.read_chunks(spark, str(tmp_path)), ["folder"]).first()
    assert (chunks["pcap_chunks"], chunks["total_capture_bytes"]) == (1, 3)
    bundle = scan.read_bundle(spark, str(tmp_path), [".pcap", ".json"])
    assert bundle.count() == 2  # Spark's file sources pass over empty files


def test_pairing_fails_on_other_keys(spark):
    from traceweave.operators import dataset as D

    x = spark.createDataFrame([(1, 2.0), (2, 3.0)], "row_id long, a double")
    y = spark.createDataFrame([(1, "p"), (2, "q")], "row_id long, family string")
    assert sorted(map(tuple, D.paired_rows(x, y).collect())) == [(1, 2.0, "p"), (2, 3.0, "q")]
    for other in (y.where("row_id = 1"), y.union(y), y.union(spark.createDataFrame([(3, "r")], y.schema))):
        with pytest.raises(Exception, match="partner"):
            D.paired_rows(x, other).collect()


def test_matrix_takes_finite_predictors_only(spark):
    from traceweave.operators import dataset as D

    x = spark.createDataFrame(
        [(1, "7", 1.0, "2", float("nan"), "x", 1.0, 3.0), (2, "8", 2.0, None, 1.0, "3", 1.0, 4.0)],
        "row_id long, before string, packet_count_total double, b string, c double, d string, Device_load double, client_partition double",
    )
    assert D.student_predictors(x) == ["packet_count_total", "b"]
    y = spark.createDataFrame([(1, "p"), (2, "q")], "row_id long, family string")
    rows = D.labelled_matrix(x, y, ["packet_count_total"], "family").collect()
    assert sorted(map(tuple, rows)) == [(1, [1.0], "p"), (2, [2.0], "q")]
    for names, match in ((["c"], "finite"), (["d"], "finite")):
        with pytest.raises(Exception, match=match):
            D.labelled_matrix(x, y, names, "family").collect()
    with pytest.raises(D.PolicyError):
        D.labelled_matrix(x, y, ["missing"], "family")


def test_slot_index_is_checked(spark):
    from traceweave.operators import sampling as S

    parts = S.iid_partitions(spark.range(20).withColumn("label", F.col("id") % 2), "id", 4, 1)
    assert S.slot_assignment(parts, 3, 4, "id", "label").first()["row_count"] == 5
    for index, clients in ((4, 4), (-1, 4), (0, 0)):
        with pytest.raises(ValueError):
            S.slot_assignment(parts, index, clients, "id", "label")


def test_spread_over_folds(spark):
    from traceweave.operators import audit as A

    folds = spark.createDataFrame([("m", 0, 1.0, "x"), ("m", 1, 3.0, "x"), ("m", 2, None, "y")], "k string, fold int, v double, best string")
    assert [tuple(r) for r in A.metric_spread(folds, ["k"], ["v"]).collect()] == [("m", "v", 2, 2.0, 1.0)]
    assert sorted(map(tuple, A.parameter_counts(folds, ["k"], "best").collect())) == [("m", "x", 2), ("m", "y", 1)]


def test_policy_error_names_every_problem():
    with pytest.raises(D.PolicyError, match="no column run; .*'gpu_x', 'loss'.*; no predictor column"):
        D.predictors_of(["row_id", "loss", "gpu_x"], "run")
    assert D.column_roles(["row_id", "loss", "bytes_total"]) == {"row_id": "metadata", "loss": "forbidden", "bytes_total": "predictor"}


def test_group_folds_are_disjoint_and_even(spark):
    rows = [(f"g{i}", "s" if i % 2 else "t", "ab"[j % 2] if i % 3 else "c") for i in range(40) for j in range(1 + i % 7)] + [(None, "s", None)]
    df = spark.createDataFrame(rows, "g string, scope string, c string")
    sizes = {}
    for g, scope, _ in rows:
        sizes[scope, g] = sizes.get((scope, g), 0) + 1
    for found in (FI.group_folds(df, "g", 4, scope=["scope"]), FI.stratified_group_folds(df, "c", "g", 4, scope=["scope"])):
        placed = {(r["scope"], r["g"]): r["fold"] for r in found.collect()}
        assert set(placed) == set(sizes)
        for scope in "st":
            held = [sum(n for k, n in sizes.items() if k[0] == scope and placed[k] == f) for f in range(4)]
            assert max(held) - min(held) <= 7
    assert FI.group_folds(df.limit(0), "g", 3).count() == 0
