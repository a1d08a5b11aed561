"""Readers: decoded packet text, packet CSV, event JSONL, manifests, bundles.

Files are read by Spark's own sources; the functions add schemas, column checks
and the projections that turn text into typed packet rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceweave.functions import exprs as X
from traceweave.operators.isolate import RAW_REQUIRED, require_columns

# ---- fixed values -------------------------------------------------------
DECODED_COLUMNS = (
    "frame_number frame_time_epoch frame_len ip_src ip_dst ipv6_src ipv6_dst tcp_srcport tcp_dstport udp_srcport "
    "udp_dstport ip_proto ipv6_nxt tcp_flags tcp_flags_syn tcp_flags_ack tcp_flags_fin tcp_flags_reset "
    "tcp_retransmission tls_record_length tls_handshake_length"
).split()
CLIENT_COLUMNS = ("resolved_client_id", "client_capture_id", "client_id", "client")
ENDPOINT_PATTERNS = (
    "*resource*.csv",
    "*round_metrics*.csv",
    "*client_update_metrics*.csv",
    "*anomaly_metrics*.csv",
    "*anomaly_detection_metrics*.csv",
)
# -------------------------------------------------------------------------


def decoded_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in DECODED_COLUMNS])


def decoded_packets(lines: DataFrame) -> DataFrame:
    """Typed packets from the 21 text columns of a packet decoder."""
    c = F.col
    flagged = X.with_flags(
        lines,
        "tcp_flags",
        {
            "tcp_syn": "tcp_flags_syn",
            "tcp_ack": "tcp_flags_ack",
            "tcp_fin": "tcp_flags_fin",
            "tcp_rst": "tcp_flags_reset",
        },
    )
    return flagged.select(
        X.lenient_int("frame_number").alias("packet_index"),
        X.lenient_float("frame_time_epoch").alias("timestamp_epoch"),
        X.lenient_int("frame_len").cast("int").alias("frame_length"),
        X.first_nonempty("ip_src", "ipv6_src").alias("src_ip"),
        X.first_nonempty("ip_dst", "ipv6_dst").alias("dst_ip"),
        X.lenient_int(X.first_nonempty("tcp_srcport", "udp_srcport")).cast("int").alias("src_port"),
        X.lenient_int(X.first_nonempty("tcp_dstport", "udp_dstport")).cast("int").alias("dst_port"),
        X.transport_name("ip_proto", "ipv6_nxt").alias("transport_protocol"),
        X.text("tcp_flags").alias("tcp_flags_hex"),
        *[c(n) for n in ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst")],
        (X.text("tcp_retransmission") != "").cast("int").alias("retransmission"),
        X.int_list("tls_record_length").alias("tls_record_lengths"),
    )


def read_decoded(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated decoder output; short lines are padded with nulls."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.schema(decoded_schema()).option("sep", "\t").option("mode", "PERMISSIVE").csv(paths)
    return decoded_packets(lines)


def split_decoded_line(line: Column | str) -> list[Column]:
    """The same columns from one text line (streams, pipes)."""
    parts = F.split(X.col(line), "\t", -1)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(DECODED_COLUMNS)]


def raw_packets(rows: DataFrame) -> DataFrame:
    """Packets from the text columns of a raw packet table; flags are recomputed."""
    require_columns(rows, RAW_REQUIRED, "packet CSV")
    fallback = {n: n for n in ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst") if n in rows.columns}
    carried = [n for n in ("experiment_id", "client_id") if n in rows.columns]
    flagged = X.with_flags(
        rows.withColumnsRenamed({n: f"_in_{n}" for n in fallback}), "tcp_flags_hex", {n: f"_in_{n}" for n in fallback}
    )
    return flagged.select(
        *carried,
        X.lenient_int("packet_index").alias("packet_index"),
        X.lenient_float("timestamp_epoch").alias("timestamp_epoch"),
        X.lenient_int("frame_length").cast("int").alias("frame_length"),
        X.text("src_ip").alias("src_ip"),
        X.text("dst_ip").alias("dst_ip"),
        X.lenient_int("src_port").cast("int").alias("src_port"),
        X.lenient_int("dst_port").cast("int").alias("dst_port"),
        X.text("transport_protocol").alias("transport_protocol"),
        X.text("tcp_flags_hex").alias("tcp_flags_hex"),
        *[F.col(n) for n in ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst")],
        (X.lenient_int("retransmission") != 0).cast("int").alias("retransmission"),
        X.int_list("tls_record_lengths").alias("tls_record_lengths"),
    )


def read_raw_packets(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return raw_packets(read_by_header(spark, path).drop("path"))


def is_safe_sequence(columns: Sequence[str]) -> bool:
    """A classifier-safe table has a size, a direction and some time column."""
    names = {c.strip() for c in columns}
    return {"frame_length", "direction"} <= names and bool(names & set(X.TIME_ALIASES))


def safe_sequence(rows: DataFrame, role: str) -> DataFrame:
    """Vantage-neutral observations from a safe table of the given role."""
    if not is_safe_sequence(rows.columns):
        raise ValueError("table has no frame_length, direction and time column")
    times = [X.filled(n) for n in X.TIME_ALIASES if n in rows.columns]
    proto = next((n for n in ("transport_protocol", "protocol") if n in rows.columns), None)
    name = F.upper(X.first_nonempty(proto, F.lit("OTHER"))) if proto else F.lit("OTHER")

    def flag(n: str) -> Column:
        return (X.lenient_int(n) != 0).cast("int") if n in rows.columns else F.lit(0)

    tls = X.tolerant_list("tls_record_lengths") if "tls_record_lengths" in rows.columns else F.array().cast("array<double>")
    carried = [n for n in ("experiment_id", *CLIENT_COLUMNS, "packet_index") if n in rows.columns]
    return rows.select(
        *carried,
        X.lenient_float(F.coalesce(*times)).alias("timestamp_epoch"),
        F.greatest(X.lenient_float("frame_length"), F.lit(0.0)).alias("frame_length"),
        X.normalized_direction("direction", F.lit(role)).alias("direction"),
        name.alias("transport_protocol"),
        *[flag(n).alias(n) for n in ("tcp_syn", "tcp_ack", "tcp_fin", "tcp_rst", "retransmission")],
        tls.alias("tls_record_lengths"),
    )


def with_client(rows: DataFrame, role: str, path: Column, participant: Column) -> DataFrame:
    """Client identity of sequence rows; rows whose client is ambiguous are dropped.

    A client column wins; else the only ``client_N`` in path or participant;
    else a client participant itself.  Clients are never mixed.
    """
    present = next((n for n in CLIENT_COLUMNS if n in rows.columns), None)
    if present:
        label = F.nullif(X.canonical_client(present), F.lit("unknown"))
    else:
        found = F.array_distinct(
            F.regexp_extract_all(F.lower(F.concat_ws("/", participant, path)), F.lit(r"client[_-]?(\d+)"), F.lit(1))
        )
        label = F.when(F.size(found) == 1, F.concat(F.lit("client_"), F.get(found, F.lit(0))))
        if role == "client":
            label = F.coalesce(label, F.nullif(X.canonical_client(participant), F.lit("unknown")))
    return rows.withColumn("client_label", label).where(F.col("client_label").isNotNull())


def event_fields(df: DataFrame, line: str, fields: Mapping[str, str]) -> DataFrame:
    """Typed fields of JSON event lines plus ``run_id`` (else experiment_id)."""
    names = {"run_id": "string", "experiment_id": "string", **fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in names.items())
    record = df.withColumn("_r", F.from_json(line, schema))
    keep = [c for c in df.columns if c != line]
    return record.select(
        *keep,
        X.first_nonempty(F.col("_r.run_id"), F.col("_r.experiment_id")).alias("run_id"),
        *[F.col(f"_r.{n}").alias(n) for n in fields],
    )


def read_events(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """Event JSONL; a bad line is an error (strict) or skipped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("mode", mode).json(path)


MANIFEST_SCHEMA = (
    "run_id string, experiment_id string, capture struct<capture_start_epoch: double>, "
    "outputs struct<per_client: map<string, struct<client_ip: string, client_port: string, packet_count: string, "
    "trace_start_offset_sec: string, fingerprint_sequence_csv: string>>>"
)


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """One row per (manifest, alias) with an address; a missing capture start is an error."""
    start = F.when(F.col("capture.capture_start_epoch").isNotNull(), F.col("capture.capture_start_epoch")).otherwise(
        F.raise_error(F.lit("manifest without capture_start_epoch")).cast("double")
    )
    keep = [c for c in manifests.columns if c not in ("run_id", "experiment_id", "capture", "outputs")]
    return (
        manifests.select(
            *keep,
            X.first_nonempty("run_id", "experiment_id").alias("run_id"),
            start.alias("_start"),
            F.explode("outputs.per_client").alias("alias", "item"),
        )
        .select(
            *keep,
            "run_id",
            "alias",
            X.text("item.client_ip").alias("client_ip"),
            X.lenient_int("item.client_port").alias("client_port"),
            X.lenient_int("item.packet_count").alias("packet_count"),
            (F.col("_start") + X.lenient_float("item.trace_start_offset_sec")).alias("base_epoch"),
        )
        .where("client_ip <> '' and client_port > 0")
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Nested capture manifests below ``path`` (chunk folders)."""
    files = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_manifest.json")
        .json(path)
    )
    return manifest_entries(files.withColumn("path", F.col("_metadata.file_path")))


def read_by_header(spark: SparkSession, root: str | Sequence[str], patterns: Sequence[str] = ("*",)) -> DataFrame:
    """CSV files below ``root`` as text columns plus ``path``, each file under its own header.

    Files are grouped by their first line and united by column name, so files with other columns or another column
    order do not mix. A file that several patterns match is read once. Without files the result has no columns.
    """
    lines = None
    for pattern in patterns:
        found = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .text(root)
            .select(
                F.col("_metadata.file_path").alias("path"),
                F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
                "value",
            )
        )
        lines = found if lines is None else lines.unionByName(found)
    firsts = lines.groupBy("path").agg(F.min_by("value", "place").alias("header"))
    headers: dict[str, list[str]] = {}
    for row in firsts.collect():  # one short row per file; Spark's own file listing is as long
        headers.setdefault(row["header"], []).append(unquote(row["path"]))
    table = spark.createDataFrame([], T.StructType([]))
    for i, header in enumerate(sorted(headers)):
        part = spark.read.option("header", "true").csv(sorted(headers[header]))
        part = part.withColumn("path", F.col("_metadata.file_path"))
        table = part if i == 0 else table.unionByName(part, allowMissingColumns=True)
    return table


def discover_features(spark: SparkSession, root: str, allowed_runs: DataFrame | None = None) -> DataFrame:
    """Feature CSV rows below ``root``; per-client files win over combined ones per run."""
    rows = read_by_header(spark, root, ("*_features.csv",))
    # Only the file's own name tells; folders may be called anything.
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(~name.contains("_X_proxy") & ~name.endswith("_live_features.csv"))
    return prefer_per_client(rows, allowed_runs)


def prefer_per_client(rows: DataFrame, allowed_runs: DataFrame | None = None) -> DataFrame:
    """Rows with a client capture id replace combined rows of the same run."""
    embedded = F.col("experiment_id")
    rows = rows.withColumns(
        {
            "run_id": X.run_id_from_path("path", embedded),
            "_has": (X.text("client_capture_id") != "").cast("int") if "client_capture_id" in rows.columns else F.lit(0),
        }
    )
    if allowed_runs is not None:
        rows = rows.join(allowed_runs.select("run_id").distinct(), "run_id", "left_semi")
    best = rows.groupBy("run_id").agg(F.max("_has").alias("_best"))
    return rows.join(best, "run_id").where("_has = _best").drop("_has", "_best")


def read_endpoint_tables(spark: SparkSession, root: str) -> DataFrame:
    """Endpoint metric rows as text with run, role and client from columns or path."""
    table = read_by_header(spark, root, ENDPOINT_PATTERNS)
    if not table.columns:
        raise ValueError(f"no endpoint tables below {root}")
    return endpoint_identity(table)


def endpoint_identity(table: DataFrame) -> DataFrame:
    path = F.lower(F.col("path"))
    from_path = F.when(path.contains("/server"), "server").when(path.contains("/client"), "client").otherwise("unknown")
    role = X.first_nonempty(F.lower(F.col("role")), from_path) if "role" in table.columns else from_path
    client = X.endpoint_client("client_id") if "client_id" in table.columns else F.lit(None).cast("string")
    folder = F.regexp_extract(path, r"(client[_-]?\d+)", 1)
    return table.withColumns(
        {
            "run_id": X.last_run_folder("path"),
            "endpoint_role": role,
            "endpoint_client": F.coalesce(client, X.endpoint_client(F.nullif(folder, F.lit("")))),
        }
    )


def bundle_inventory(files: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Size and digest of every file (``path``, binary or text ``content``), with the columns that name its bundle."""
    return files.select(
        *scope,
        "path",
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
    )


def read_bundle(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.lower("path").endswith(suffix)
    return bundle_inventory(files.where(wanted))


def verify_bundle(actual: DataFrame, manifest: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every file with its state: ok, missing, unlisted, size or digest mismatch.

    A path names one file of a bundle; ``scope`` has the columns that name the bundle where there are several.
    """
    keys = [*scope, "path"]
    a = actual.select(*keys, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    both = manifest.join(a, keys, "full_outer")
    state = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("size_bytes") != F.col("_size"), "size_mismatch")
        .when(F.col("sha256") != F.col("_sha"), "digest_mismatch")
        .otherwise("ok")
    )
    return both.select(*keys, state.alias("state"))


def bundle_identity(inventory: DataFrame, bundle: Sequence[str]) -> DataFrame:
    """Content id per bundle: digest over all (path, size, digest) entries in path order.

    Entries are digested in groups of one first path letter pair, then the group
    digests are combined, so a huge bundle is not listed in one task.
    """
    entry = F.concat_ws("|", "path", F.col("size_bytes").cast("string"), "sha256")
    grouped = inventory.groupBy(*bundle, F.substring(F.sha2("path", 256), 1, 3).alias("_g")).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(entry))), 256).alias("_d"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("size_bytes").alias("_b"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_g", "_d"))), lambda e: e["_d"])
    return grouped.groupBy(*bundle).agg(
        F.sha2(F.concat_ws("\n", parts), 256).alias("bundle_id"),
        F.sum("_n").alias("file_count"),
        F.sum("_b").alias("total_bytes"),
    )


def chunk_inventory(files: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Non-empty capture chunks numbered by modification time and name."""
    order = Window.partitionBy(*scope).orderBy("modificationTime", "path")
    return files.where("length > 0").withColumn("chunk_number", F.row_number().over(order))


def chunk_summary(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    return chunks.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("pcap_chunks"), F.sum("length").alias("total_capture_bytes")
    )


def read_chunks(spark: SparkSession, root: str, pattern: str = "*.pcap*") -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "modificationTime", "length")
    )
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return chunk_inventory(files.withColumn("folder", folder), ["folder"])
