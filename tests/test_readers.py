"""File readers on folders with mixed headers, overlapping patterns and misleading names."""

import pytest
from pyspark.sql import functions as F

from traceweave.operators.isolate import chunk_global_index, dedupe_packets
from traceweave.sources import scan

from conftest import PACKET_SCHEMA, packet_rows


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)


def test_endpoint_tables_keep_their_columns(spark, tmp_path):
    root = tmp_path / "run_1 live"
    write(root / "server", a_resource="cpu_percent,power_w\n5,1\n", anomaly_metrics_resource="cpu_percent,power_w\n6,2\n")
    write(root / "client_3", resource="power_w,client_id,cpu_percent\n55,client_3,7\n")
    rows = scan.read_endpoint_tables(spark, str(tmp_path)).collect()
    # One file matches two patterns and is read once.
    assert sorted((r["cpu_percent"], r["power_w"], r["endpoint_role"]) for r in rows) == [
        ("5", "1", "server"),
        ("6", "2", "server"),
        ("7", "55", "client"),
    ]
    assert {r["endpoint_client"] for r in rows} == {None, "client_3"}
    with pytest.raises(ValueError):
        scan.read_endpoint_tables(spark, str(root / "server" / "none") if (root / "server" / "none").mkdir() else str(root / "server" / "none"))


def test_features_in_a_folder_called_live(spark, tmp_path):
    root = tmp_path / "live-deliveries"
    write(root, one_features="experiment_id,x\nrun_1,1\n", two_features="x,experiment_id\n2,run_2\n", run_3_live_features="experiment_id,x\nrun_3,3\n")
    rows = scan.discover_features(spark, str(root)).collect()
    assert sorted((r["run_id"], r["x"]) for r in rows) == [("run_1", "1"), ("run_2", "2")]


def test_raw_packets_of_files_with_other_column_orders(spark, tmp_path):
    names = "packet_index timestamp_epoch frame_length src_ip dst_ip src_port dst_port transport_protocol tcp_flags_hex retransmission tls_record_lengths".split()
    values = dict(zip(names, "1 10.5 100 10.0.0.1 10.0.0.2 5 80 TCP 0x02 0 180;250".split()))
    for name, order in (("a", names), ("b", names[::-1])):
        write(tmp_path, **{name: ",".join(order) + "\n" + ",".join(values[n] for n in order) + "\n"})
    rows = scan.read_raw_packets(spark, str(tmp_path)).collect()
    assert [(r["packet_index"], r["frame_length"], r["tls_record_lengths"]) for r in rows] == [(1, 100, [180, 250])] * 2


def test_equal_packets_of_two_runs_stay(spark):
    one = [(1.0, 100, "up", [], 0, 0), (1.0000001, 100, "up", [], 0, 0), (2.0, 100, "up", [], 0, 0)]
    rows = packet_rows(one) + packet_rows(one, experiment="run_2")
    kept = dedupe_packets(spark.createDataFrame(rows, PACKET_SCHEMA)).collect()
    assert sorted((r["experiment_id"], r["packet_index"]) for r in kept) == [("run_1", 0), ("run_1", 2), ("run_2", 0), ("run_2", 2)]


@pytest.mark.parametrize("limit", [10**6, 5])
def test_chunk_numbers_are_unique(spark, limit):
    rows = packet_rows([(float(i % 7), 100, "up", [], 0, 0) for i in range(60)])
    df = spark.createDataFrame(rows, PACKET_SCHEMA).withColumns(
        {"chunk_number": (F.col("packet_index") % 2), "connection_number": F.col("packet_index") % 150}
    )
    found = chunk_global_index(df, ["experiment_id", "client_id"], limit)
    assert sorted(r["global_index"] for r in found.collect()) == list(range(1, 61))


def test_bundles_with_one_path_stay_apart(spark):
    from traceweave.sources.scan import bundle_identity, bundle_inventory, verify_bundle

    rows = [(1, "a", "x"), (2, "a", "yy"), (2, "b", "z")]
    actual = bundle_inventory(spark.createDataFrame(rows, "bundle long, path string, content string"), ["bundle"])
    states = verify_bundle(actual, actual.where("path = 'a'"), ["bundle"]).collect()
    assert sorted(map(tuple, states)) == [(1, "a", "ok"), (2, "a", "ok"), (2, "b", "unlisted")]
    found = bundle_identity(actual, ["bundle"]).select("bundle", "file_count", "total_bytes").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1), (2, 2, 3)]


@pytest.mark.parametrize("name", ["bundle_verify", "bundle_identity", "alias_unique"])
def test_repeated_urls_and_placeholders_as_in_the_sql(spark, tmp_path, name):
    """Pages that share a url, and suppliers from 1000 on, whose placeholders clash."""
    import duckdb

    import __spark_entry__ as entry_module

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create table pages as select page_id, 'u' || page_id % 30 AS url, html from '{folder}/pages.parquet'")
    con.execute(f"create table supplier as select s.* replace (s_suppkey + i AS s_suppkey) from '{folder}/supplier.parquet' s, (select unnest([0, 90, 990]) i)")
    for t in ("pages", "supplier"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    got = sorted(map(tuple, entry_module.queries()[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(entry_module.oracle_sql()[name]).fetchall())
