"""Dataset, audit, partition and set-operation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.evaluation import LABELS_SQL, hierarchy_labels
from traceweave.catalog.tables import BURST_GAP, DAY, IDLE, PACKETS_SQL, packets, parsed_packets, table
from traceweave.catalog.traces import features_sql
from traceweave.functions.exprs import rounded
from traceweave.operators import audit as A
from traceweave.operators import dataset as D
from traceweave.operators import features as FE
from traceweave.operators import sampling as S

DAYS = (DAY, 7 * DAY)

# ---- windows as a dataset --------------------------------------------------------

WINDOWS_SQL = f"""WITH {PACKETS_SQL},
tb AS (SELECT *, min(timestamp_epoch) OVER w AS t0, max(timestamp_epoch) OVER w AS t1 FROM pp WINDOW w AS (PARTITION BY experiment_id, client_id)),
wi AS (SELECT experiment_id, client_id, t0, t1, s, unnest(range(0, greatest(1, ceil((t1 - t0) / s))::BIGINT)) AS w FROM (SELECT DISTINCT experiment_id, client_id, t0, t1 FROM tb) CROSS JOIN (SELECT unnest([{DAYS[0]}, {DAYS[1]}]) AS s)),
pw AS (SELECT tb.*, s, least(floor((timestamp_epoch - t0 - (timestamp_epoch - t0) % s) / s + 0.5), greatest(1, ceil((t1 - t0) / s)) - 1)::BIGINT AS w FROM tb CROSS JOIN (SELECT unnest([{DAYS[0]}, {DAYS[1]}]) AS s)),
ct AS (SELECT experiment_id, client_id, s, w, count(*) AS n, sum(frame_length) AS b FROM pw GROUP BY ALL),
al AS (SELECT experiment_id, client_id, s, w, coalesce(n, 0) AS n, coalesce(b, 0)::BIGINT AS b, 'window' AS row_type, t1 - t0 AS d FROM wi LEFT JOIN ct USING (experiment_id, client_id, s, w)
 UNION ALL SELECT experiment_id, client_id, 0, -1, count(*), sum(frame_length)::BIGINT, 'overall', 0 FROM tb GROUP BY 1, 2),
ds AS (SELECT *, CASE WHEN row_type = 'overall' THEN 'Aggregated' WHEN s = {DAYS[0]} THEN '1 d' ELSE '7 d' END AS representation, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS ok,
 CAST(regexp_extract(experiment_id, '[0-9]+') AS INT) AS e FROM al)"""


def window_dataset(spark, sf_dir):
    """Daily, weekly and whole-trace rows with labels and a representation name."""
    rows = FE.feature_rows(parsed_packets(spark, sf_dir), DAYS, BURST_GAP, IDLE)
    name = (
        F.when(F.col("row_type") == "overall", "Aggregated")
        .when(F.abs(F.col("window_size_sec") - DAYS[0]) < 1e-9, "1 d")
        .otherwise("7 d")
    )
    return hierarchy_labels(rows.withColumn("representation", name))


@query(
    WINDOWS_SQL
    + f" SELECT representation, count(*) AS rows, count(DISTINCT experiment_id) AS experiments, count(DISTINCT (experiment_id, client_id)) AS traces, count(*) FILTER (WHERE ok = 0) AS sparse_rows, {r6('count(*) FILTER (WHERE ok = 0) / count(*)')} AS sparse_fraction FROM ds GROUP BY 1"
)
def representation_inventory(spark, sf_dir):
    df = window_dataset(spark, sf_dir)
    return rounded(A.representation_inventory(df, ["representation"], "experiment_id", ["client_id"]))


@query(
    WINDOWS_SQL
    + " SELECT representation, 'family_' || (e % 3) AS family, 'architecture_' || (e % 6) AS architecture, count(*) AS rows, count(DISTINCT experiment_id) AS experiments FROM ds GROUP BY 1, 2, 3"
)
def inventory(spark, sf_dir):
    df = window_dataset(spark, sf_dir)
    full = A.representation_inventory(df, ["representation", "family", "architecture"], "experiment_id", ["client_id"])
    return full.select("representation", "family", "architecture", "rows", "experiments")


@query(
    WINDOWS_SQL
    + """, l AS (SELECT representation, client_id, 'family_' || (e % 3) AS family, 'architecture_' || (e % 6) AS architecture FROM ds)
SELECT representation, 'client_id' AS dimension, client_id AS value, count(*) AS rows FROM l GROUP BY 1, 3 UNION ALL SELECT representation, 'family', family, count(*) FROM l GROUP BY 1, 3 UNION ALL SELECT representation, 'architecture', architecture, count(*) FROM l GROUP BY 1, 3"""
)
def inventory_grouping_sets(spark, sf_dir):
    df = window_dataset(spark, sf_dir).select("representation", "client_id", "family", "architecture")
    return A.dimension_counts(df, "representation", ["client_id", "family", "architecture"])


@query(WINDOWS_SQL + " SELECT experiment_id, client_id, w AS window_index, n AS packet_count_total, 'family_' || (e % 3) AS family FROM ds WHERE row_type = 'window' AND s = 604800 AND n >= 12")
def realtime_eligibility(spark, sf_dir):
    rows = D.realtime_rows(window_dataset(spark, sf_dir), DAYS[1], 12)
    return rows.select("experiment_id", "client_id", "window_index", "packet_count_total", "family")


@query(WINDOWS_SQL + " SELECT representation, sum(n)::BIGINT AS packets, count(*) AS rows, CASE WHEN sum(n) >= 1000 THEN printf('%.1fK', sum(n) / 1000) ELSE sum(n) || '' END AS label FROM ds GROUP BY 1")
def matrix_evidence(spark, sf_dir):
    """Packets behind each representation; the label is in thousands, however many, as in its SQL."""
    return A.matrix_evidence(window_dataset(spark, sf_dir), ["representation"], "K")


@query(WINDOWS_SQL + " SELECT count(*) AS mismatches FROM ds WHERE row_type = 'window' AND n > 0 AND w % 7 = 3")
def rate_audit(spark, sf_dir):
    """Rates of every seventh window are spoilt on purpose; the audit must find just those."""
    df = window_dataset(spark, sf_dir)
    spoilt = F.when(F.col("window_index") % 7 == 3, F.col("packets_per_second") * 1.5).otherwise(F.col("packets_per_second"))
    bad = A.rate_mismatches(df.withColumn("packets_per_second", spoilt), 1e-9 / DAY)
    return bad.agg(F.count(F.lit(1)).alias("mismatches"))


@query(
    WINDOWS_SQL
    + f""", o AS (SELECT *, row_number() OVER (ORDER BY experiment_id, client_id, s, w) AS row_id FROM ds)
SELECT row_id, experiment_id, client_id, s::DOUBLE AS window_size_sec, w AS window_index, n::DOUBLE AS packet_count_total, b::DOUBLE AS bytes_total, 'family_' || (e % 3) AS family, 'application_' || (e % 2) AS application FROM o"""
)
def fingerprint_dataset(spark, sf_dir):
    """Policy check, labels, row ids, then X and Y joined back on the row id."""
    from traceweave.plans.jobs import fingerprint_dataset as build

    rows = FE.feature_rows(parsed_packets(spark, sf_dir), DAYS, BURST_GAP, IDLE)
    labels = hierarchy_labels(packets(spark, sf_dir).select("experiment_id", "client_id").distinct())
    x, y, _ = build(rows, labels, ["family", "application"])
    both = D.join_xy(x, y.drop("experiment_id", "client_id"))
    return rounded(
        both.select(
            "row_id", "experiment_id", "client_id", "window_size_sec", "window_index", "packet_count_total", "bytes_total", "family", "application"
        )
    )


@query(
    f"""WITH {PACKETS_SQL}, c AS (SELECT experiment_id, min(timestamp_epoch) AS c0 FROM pp GROUP BY 1),
t AS (SELECT experiment_id, client_id, count(*) AS n, sum(frame_length)::BIGINT AS b, min(timestamp_epoch) AS t0, max(timestamp_epoch) AS t1 FROM pp GROUP BY 1, 2)
SELECT experiment_id, client_id, n AS packet_count_total, b AS bytes_total, {r6("t0 - c0")} AS window_start_global_sec, {r6("t1 - c0")} AS window_end_global_sec FROM t JOIN c USING (experiment_id)"""
)
def capture_job(spark, sf_dir):
    """Capture to features: connection isolation, whole-trace rows, run clock."""
    from traceweave.plans.jobs import capture_features

    p = parsed_packets(spark, sf_dir)
    key, back = F.col("client_id"), F.col("direction") == "down"
    # One listening port per client keeps every packet on exactly one connection.
    port = F.regexp_extract(key, r"(\d+)$", 1).cast("int") + 20000
    p = p.withColumns(
        {
            "src_port": F.when(back, F.col("src_port")).otherwise(port),
            "dst_port": F.when(back, port).otherwise(F.col("dst_port")),
        }
    )
    client_ip = F.when(back, F.col("dst_ip")).otherwise(F.col("src_ip"))
    connections = p.select("experiment_id", client_ip.alias("client_ip"), port.alias("client_port"), key.alias("alias")).distinct()
    made = capture_features(p, connections, scales=[], burst_gap_sec=BURST_GAP, idle_threshold_sec=IDLE)
    return rounded(
        made["features"].select(
            "experiment_id", "client_id", "packet_count_total", "bytes_total", "window_start_global_sec", "window_end_global_sec"
        )
    )


@query()
def round_dataset(spark, sf_dir):
    """Inferred rounds as labelled feature rows (see round_boundaries)."""
    from traceweave.catalog.rounds import CFG
    from traceweave.plans.jobs import round_dataset as build

    p = parsed_packets(spark, sf_dir)
    labels = hierarchy_labels(p.select("experiment_id", "client_id").distinct())
    made = build(p, labels, ["family"], CFG, burst_gap_sec=BURST_GAP, idle_threshold_sec=IDLE)
    return rounded(D.join_xy(made["x"], made["y"].drop("experiment_id", "client_id")))


#: Units per trace and K that sampling keeps at most.
UNIT_CAP = 5_000
BUDGET_SQL = f"""WITH {PACKETS_SQL}, t AS (SELECT experiment_id, client_id, count(*) AS n FROM pk GROUP BY 1, 2), k AS (SELECT unnest({list(FE.PACKET_BUDGETS)}) AS packet_budget),
u AS (SELECT experiment_id, client_id, packet_budget, n // packet_budget AS units FROM t CROSS JOIN k),
r AS (SELECT *, CASE WHEN CAST(regexp_extract(experiment_id, '[0-9]+') AS INT) % 3 = 0 THEN 'client' ELSE 'proxy' END AS source_role FROM u)"""


@query(
    BUDGET_SQL
    + f""", o AS (SELECT experiment_id, client_id, frame_length, direction, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY timestamp_epoch, packet_index) AS i FROM pk)
SELECT experiment_id, client_id, packet_budget, any_value(units) AS samples, {r6("sum(frame_length)")} AS bytes, {r6("sum((direction = 'up')::INT)")} AS packets_up
FROM u JOIN o USING (experiment_id, client_id) WHERE i <= units * packet_budget GROUP BY 1, 2, 3"""
)
def packet_budget_dataset(spark, sf_dir):
    """All exact-K blocks of all budgets: their number, bytes and packets that go up, per trace and K."""
    from traceweave.plans.jobs import packet_budget_dataset as build

    made = build(parsed_packets(spark, sf_dir))
    key = ["experiment_id", "client_id", "packet_budget"]
    k = F.col("packet_budget")
    single = made["single"].select(*key, F.col("frame_length").cast("double").alias("b"), F.col("direction_up").alias("u"))
    blocks = made["blocks"].select(*key, (F.col("packet_size_mean") * k).alias("b"), (F.col("upload_packet_fraction") * k).alias("u"))
    both = single.unionByName(blocks).groupBy(*key)
    return rounded(both.agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("b"), 3).alias("bytes"), F.round(F.sum("u"), 3).alias("packets_up")))


@query(
    BUDGET_SQL
    + f""",
g AS (SELECT packet_budget, source_role FROM k CROSS JOIN (SELECT unnest(['client', 'server', 'proxy']) AS source_role)),
s AS (SELECT packet_budget, source_role, sum(units)::BIGINT AS available, sum(least(units, {UNIT_CAP}))::BIGINT AS written, count(*) AS traces, count(DISTINCT experiment_id) AS experiments FROM r GROUP BY 1, 2)
SELECT packet_budget, source_role, coalesce(available, 0) AS available, coalesce(written, 0) AS written, coalesce(traces, 0) AS traces, coalesce(experiments, 0) AS experiments FROM g LEFT JOIN s USING (packet_budget, source_role)"""
)
def packet_inventory(spark, sf_dir):
    return _stock(spark, sf_dir)


def _stock(spark, sf_dir):
    sizes = packets(spark, sf_dir).groupBy("experiment_id", "client_id").agg(F.count(F.lit(1)).alias("n"))
    e = F.regexp_extract("experiment_id", r"(\d+)$", 1).cast("int")
    units = F.floor(F.col("n") / F.col("packet_budget"))
    table_ = sizes.withColumn("packet_budget", F.explode(F.array(*[F.lit(k) for k in FE.PACKET_BUDGETS]))).select(
        "experiment_id",
        "client_id",
        "packet_budget",
        F.when(e % 3 == 0, "client").otherwise("proxy").alias("source_role"),
        units.alias("available"),
        F.least(units, F.lit(UNIT_CAP)).alias("written"),
    )
    return A.packet_inventory(table_, FE.PACKET_BUDGETS, ("client", "server", "proxy"), "experiment_id", ["client_id"])


@query(
    BUDGET_SQL
    + """, e AS (SELECT coalesce(bool_or(source_role IN ('client', 'server') AND units > 0), false) AS held FROM r WHERE packet_budget = 1)
SELECT mode FROM e CROSS JOIN (SELECT unnest(['client_to_proxy', 'server_to_proxy', 'both_to_proxy', 'proxy_to_proxy']) AS mode) WHERE held OR mode = 'proxy_to_proxy'"""
)
def coverage_mode(spark, sf_dir):
    """Vantage modes the K=1 inventory allows; some clients captured packets here."""
    stock = _stock(spark, sf_dir)
    modes = A.coverage_modes(stock)
    return stock.where("packet_budget = 1 and source_role = 'proxy'").select(
        F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode")
    )


@query("SELECT 'run_' || (user_id % 12) AS experiment_id, 'client_' || user_id AS client_id, count(*) AS rows FROM events GROUP BY 1, 2")
def rows_per_trace(spark, sf_dir):
    return A.rows_per_trace(packets(spark, sf_dir), ["experiment_id", "client_id"])


@query(
    f"""WITH {LABELS_SQL} SELECT 'family' AS "column", count(DISTINCT family) AS distinct_values FROM lb UNION ALL SELECT 'architecture', count(DISTINCT architecture) FROM lb UNION ALL SELECT 'variant', count(DISTINCT variant) FROM lb UNION ALL SELECT 'client_id', count(DISTINCT user_id) FROM events"""
)
def coverage_sets(spark, sf_dir):
    df = hierarchy_labels(packets(spark, sf_dir).select("experiment_id", "client_id"))
    return A.coverage_sets(df, [], ["family", "architecture", "variant", "client_id"])


@query(
    f"""SELECT l_suppkey, {r6("avg(l_quantity)")} AS p_l_quantity__mean, {r6("stddev_pop(l_quantity)")} AS p_l_quantity__std, {r6("quantile_cont(l_quantity, 0.5)")} AS p_l_quantity__median, {r6("min(l_quantity)")} AS p_l_quantity__min, {r6("max(l_quantity)")} AS p_l_quantity__max,
 {r6("arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey)) - arg_min(l_quantity, (l_orderkey, l_linenumber, l_partkey))")} AS p_l_quantity__delta FROM lineitem GROUP BY 1"""
)
def telemetry_aggregate(spark, sf_dir):
    df = A.telemetry_aggregates(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity"], ["l_orderkey", "l_linenumber", "l_partkey"], "p_"
    )
    return rounded(df)


@query(
    """SELECT 'cpu_load' AS "column", 1.0 AS numeric_share, 1 AS selected UNION ALL
SELECT 'memory_mb', floor(avg((l_linenumber <> 3)::INT) * 1e6 + 0.5) / 1e6, (avg((l_linenumber <> 3)::INT) >= 0.9)::INT FROM lineitem UNION ALL
SELECT 'client_bytes_sent', 1.0, 1"""
)
def endpoint_predictors(spark, sf_dir):
    """Columns whose name hints at a measurement and whose text is mostly numeric."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("string").alias("cpu_load"),
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_tax").cast("string")).alias("memory_mb"),
        F.col("l_discount").alias("client_bytes_sent"),
        F.col("l_orderkey").alias("trace_id"),
        F.col("l_returnflag").alias("label"),
    )
    return rounded(D.endpoint_predictors(df))


# ---- joins on the labels table -----------------------------------------------------


@query("SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels USING (doc_id)")
def xy_join(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return D.join_xy(x, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT source, count(*) AS rows, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def xy_missing(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "source")
    return D.missing_labels(x, table(spark, sf_dir, "labels"), ["doc_id"], ["source"])


@query("SELECT doc_id, 'only_x' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only_y' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def xy_key_check(spark, sf_dir):
    x, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return D.key_mismatches(x, y, "doc_id")


@query("SELECT source, count(*) AS kept, 0::BIGINT AS skipped FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1 UNION ALL SELECT source, 0, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def source_semi_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    kept, skipped = A.split_by_label(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    zero = F.lit(0).cast("long")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept")).withColumn("skipped", zero).unionByName(
        skipped.groupBy("source").agg(F.count(F.lit(1)).alias("skipped")).withColumn("kept", zero)
    )


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'no_matching_ground_truth_label' WHEN 'N' THEN 'read_error' ELSE 'no_unambiguous_client_identity' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def skip_reasons(spark, sf_dir):
    flag = F.col("l_returnflag")
    reason = (
        F.when(flag == "A", "no_matching_ground_truth_label")
        .when(flag == "N", "read_error")
        .otherwise("no_unambiguous_client_identity")
    )
    skipped = table(spark, sf_dir, "lineitem").select(reason.alias("reason"))
    return A.reason_counts(skipped)


@query(
    """WITH px AS (SELECT o_custkey % 12 AS run_id, o_orderpriority AS client_id, arg_min(o_totalprice, o_orderkey) AS feature FROM orders GROUP BY 1, 2),
cl AS (SELECT c_nationkey % 12 AS run_id, CASE c_custkey % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS client_id, count(*) AS client_rows FROM customer GROUP BY 1, 2),
sv AS (SELECT s_nationkey % 12 AS run_id, count(*) AS server_rows FROM supplier GROUP BY 1)
SELECT run_id, client_id, feature, client_rows, server_rows, 'fam_' || (run_id % 3) AS family, CASE WHEN client_rows IS NULL AND server_rows IS NULL THEN 'no_endpoint' WHEN client_rows IS NULL THEN 'no_client' WHEN server_rows IS NULL THEN 'no_server' ELSE 'paired' END AS paired
FROM px LEFT JOIN cl USING (run_id, client_id) LEFT JOIN sv USING (run_id)"""
)
def teacher_pairing(spark, sf_dir):
    """Proxy rows with client tables (run, client) and server tables (run)."""
    run = (F.col("o_custkey") % 12).alias("run_id")
    proxy = table(spark, sf_dir, "orders").select(
        run, F.col("o_orderpriority").alias("client_id"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("feature")
    )
    i = F.col("c_custkey") % 4
    clients = (
        table(spark, sf_dir, "customer")
        .select(
            (F.col("c_nationkey") % 12).cast("long").alias("run_id"),
            F.when(i == 0, "1-URGENT").when(i == 1, "2-HIGH").otherwise("5-LOW").alias("client_id"),
        )
        .groupBy("run_id", "client_id")
        .agg(F.count(F.lit(1)).alias("client_rows"))
    )
    servers = (
        table(spark, sf_dir, "supplier")
        .select((F.col("s_nationkey") % 12).cast("long").alias("run_id"))
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("server_rows"))
    )
    labels = proxy.select("run_id", "client_id").distinct().withColumn(
        "family", F.concat(F.lit("fam_"), (F.col("run_id") % 3).cast("string"))
    )
    return D.teacher_pairs(proxy, clients, servers, labels)


VANTAGE_SQL = """WITH v AS (SELECT 'fam_' || (l_suppkey % 3) AS family, l_suppkey AS e, CASE l_returnflag WHEN 'A' THEN 'client' WHEN 'N' THEN 'server' ELSE 'proxy' END AS role FROM lineitem),
sh AS (SELECT family, e FROM v WHERE role IN ('client', 'server') INTERSECT SELECT family, e FROM v WHERE role = 'proxy')"""


def _vantage(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("fam_"), (F.col("l_suppkey") % 3).cast("string")).alias("family"),
        F.col("l_suppkey").alias("e"),
        F.when(flag == "A", "client").when(flag == "N", "server").otherwise("proxy").alias("source_role"),
    )


@query(
    VANTAGE_SQL
    + " SELECT family, role AS source_role, count(*) AS rows FROM v SEMI JOIN sh USING (family, e) GROUP BY 1, 2"
)
def cross_vantage_pairs(spark, sf_dir):
    train, test = D.cross_vantage(_vantage(spark, sf_dir), ["client", "server"], "family", "e")
    return train.unionByName(test).groupBy("family", "source_role").agg(F.count(F.lit(1)).alias("rows"))


@query(VANTAGE_SQL + " SELECT family, e FROM sh")
def shared_experiments(spark, sf_dir):
    df = _vantage(spark, sf_dir)
    return D.shared_experiments(df.where("source_role <> 'proxy'"), df.where("source_role = 'proxy'"), ["family", "e"])


@query(
    """WITH p AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS e FROM lineitem)
SELECT c AS class, count(*) AS experiments, (count(*) >= 25)::INT AS eligible FROM p GROUP BY 1"""
)
def class_eligibility(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("class"), "l_suppkey")
    return D.eligible_classes(df, "class", "l_suppkey", 25)


@query(
    """WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer), w AS (SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT s_suppkey + 1450 FROM supplier),
b AS (SELECT coalesce(e.k, w.k) AS k, e.k AS ek, w.k AS wk FROM e FULL JOIN w ON e.k = w.k)
SELECT k % 100 AS grp, count(*) FILTER (WHERE wk IS NULL) AS missing, count(*) FILTER (WHERE ek IS NULL) AS extra, CASE WHEN count(*) FILTER (WHERE wk IS NULL OR ek IS NULL) = 0 THEN 'valid' ELSE 'invalid' END AS status FROM b GROUP BY 1"""
)
def coverage_validation(spark, sf_dir):
    expected, written = _coverage(spark, sf_dir)
    return A.coverage_problems(expected, written, ["k", "grp"], ["grp"])


def _coverage(spark, sf_dir):
    def keyed(df, name):
        return df.select(F.col(name).alias("k"), (F.col(name) % 100).alias("grp"))

    expected = keyed(table(spark, sf_dir, "customer"), "c_custkey")
    paid = keyed(table(spark, sf_dir, "orders"), "o_custkey")
    more = keyed(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1450).alias("s_suppkey")), "s_suppkey")
    return expected, paid.unionByName(more)


@query(
    """WITH e AS (SELECT c_custkey AS k FROM customer), w AS (SELECT o_custkey AS k FROM orders UNION ALL SELECT s_suppkey + 1450 FROM supplier)
(SELECT k, 'missing' AS side FROM e EXCEPT SELECT k, 'missing' FROM w) UNION ALL (SELECT k, 'extra' FROM w EXCEPT SELECT k, 'extra' FROM e)"""
)
def coverage_except(spark, sf_dir):
    expected, written = _coverage(spark, sf_dir)
    return A.set_difference(expected, written, ["k"])


@query("SELECT DISTINCT o_custkey % 12 AS run_id, o_orderpriority AS client_id, o_orderstatus AS family FROM orders")
def distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 12).alias("run_id"), F.col("o_orderpriority").alias("client_id"), F.col("o_orderstatus").alias("family")
    ).dropDuplicates()


@query("SELECT 'run_' || c_nationkey AS experiment_id, c_acctbal AS packet_count_total, c_mktsegment AS client_capture_id FROM customer UNION ALL SELECT 'run_' || s_nationkey, s_acctbal, NULL FROM supplier")
def union_parts(spark, sf_dir):
    """Parts with equal predictors; a metadata column that one part lacks stays null."""

    def part(name, prefix):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit("run_"), F.col(f"{prefix}_nationkey").cast("string")).alias("experiment_id"),
            F.col(f"{prefix}_acctbal").alias("packet_count_total"),
            *([F.col("c_mktsegment").alias("client_capture_id")] if prefix == "c" else []),
        )

    return D.union_parts([part("customer", "c"), part("supplier", "s")])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS row_id FROM customer")
def surrogate_row_id(spark, sf_dir):
    return D.with_row_id(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "row_id")


@query("SELECT o_orderkey, o_orderpriority AS deployment FROM orders")
def local_deployment_guard(spark, sf_dir):
    """No order is local, so all rows pass; a local one would fail the query."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("deployment"))
    return D.reject_local(rows)


@query(
    f"SELECT experiment_id, client_id, window_size_sec, window_index, 68 AS predictors, packet_size_mean, iat_sec_mean, upload_packet_fraction FROM ({features_sql(DAYS)}) f"
)
def feature_modes(spark, sf_dir):
    """Size-normalised rows: absolute volumes and quality columns are gone."""
    df = FE.feature_rows(parsed_packets(spark, sf_dir), DAYS, BURST_GAP, IDLE)
    kept = D.feature_mode(df, "size_normalized")
    names = D.predictors_of([c for c in kept.columns if c != "client_id"])
    ratios = ["packet_size_mean", "iat_sec_mean", "upload_packet_fraction"]
    return rounded(kept.select("experiment_id", "client_id", "window_size_sec", "window_index", F.lit(len(names)).alias("predictors"), *ratios))


# ---- runs -------------------------------------------------------------------------

RUNS_SQL = """WITH r AS (SELECT c_custkey AS run_id, c_custkey % 6 + CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 5 END AS last_completed_round, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 5 END AS target_rounds,
 2 AS expected_clients, 5 + c_custkey % 2 AS server_round_rows, 10 - (c_custkey % 5 = 0)::INT AS client_update_rows, (c_custkey % 7 = 0)::INT AS incomplete_clients, c_custkey % 3 <> 0 AS proxy_present,
 CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'Completed' END AS proxy_status, c_custkey % 8 <> 1 AS capture_complete, CASE WHEN c_custkey % 13 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS server_status FROM customer)"""


@query(
    RUNS_SQL
    + """ SELECT run_id, CASE WHEN NOT (target_rounds > 0 AND last_completed_round >= target_rounds) THEN CASE WHEN last_completed_round > 0 THEN 'PARTIAL' ELSE 'FAILED' END
 WHEN NOT (server_round_rows >= target_rounds AND client_update_rows >= target_rounds * expected_clients AND incomplete_clients = 0) THEN 'METRICS_INCOMPLETE'
 WHEN proxy_present AND NOT (upper(proxy_status) = 'COMPLETED' AND capture_complete) THEN 'CAPTURE_INCOMPLETE' WHEN server_status = 'COMPLETED' THEN 'COMPLETED' ELSE 'FAILED' END AS run_status FROM r"""
)
def run_status(spark, sf_dir):
    k = F.col("c_custkey")
    five = F.when(k % 11 == 0, 0).otherwise(5)
    runs = table(spark, sf_dir, "customer").select(
        k.alias("run_id"),
        (k % 6 + five).alias("last_completed_round"),
        five.alias("target_rounds"),
        F.lit(2).alias("expected_clients"),
        (k % 2 + 5).alias("server_round_rows"),
        (F.lit(10) - (k % 5 == 0).cast("int")).alias("client_update_rows"),
        (k % 7 == 0).cast("int").alias("incomplete_clients"),
        (k % 3 != 0).alias("proxy_present"),
        F.when(k % 4 == 0, "failed").otherwise("Completed").alias("proxy_status"),
        (k % 8 != 1).alias("capture_complete"),
        F.lit(1).alias("pcap_chunks"),
        F.lit(10).alias("total_capture_bytes"),
        F.lit(10).alias("total_packets"),
        F.when(k % 13 == 0, "RUNNING").otherwise("COMPLETED").alias("server_status"),
    )
    return A.run_completeness(runs).select("run_id", "run_status")


COLLECT_SQL = """WITH p AS (SELECT o_custkey AS run_id, CASE o_orderkey % 5 WHEN 0 THEN 'server' WHEN 1 THEN 'proxy' ELSE 'client_' || (o_orderkey % 5) END AS participant, o_orderkey % 37 <> 0 AS has_receipt,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'failed' ELSE 'completed' END AS status, (o_orderkey % 3 <> 0)::INT AS feature_files, (o_orderkey % 2)::INT AS truth_files, 3 AS expected_clients FROM orders),
g AS (SELECT run_id, max((participant = 'server')::INT) AS sv, max((participant = 'proxy')::INT) AS px, count(*) FILTER (WHERE participant LIKE 'client%') AS collected_clients, max(expected_clients) FILTER (WHERE participant = 'server') AS expected_clients,
 count(*) FILTER (WHERE NOT has_receipt) AS nr, count(*) FILTER (WHERE status IS NULL) AS ns, count(*) FILTER (WHERE upper(status) <> 'COMPLETED') AS uf, coalesce(sum(feature_files) FILTER (WHERE participant = 'proxy'), 0) AS ff, coalesce(sum(truth_files) FILTER (WHERE participant LIKE 'client%'), 0) AS tf FROM p GROUP BY 1),
v AS (SELECT run_id, collected_clients, expected_clients, list_filter([CASE WHEN sv = 0 THEN 'missing server copy' END, CASE WHEN px = 0 THEN 'missing proxy copy' END, CASE WHEN collected_clients <> expected_clients THEN 'unexpected number of clients' END, CASE WHEN collected_clients = 0 THEN 'no client copies collected' END,
 CASE WHEN nr > 0 THEN 'missing collector receipt' END, CASE WHEN ns > 0 THEN 'missing experiment status' END, CASE WHEN uf > 0 THEN 'experiment not completed' END, CASE WHEN px = 1 AND ff = 0 THEN 'no extracted features' END, CASE WHEN tf = 0 THEN 'no ground truth files' END], lambda x: x IS NOT NULL) AS issues FROM g)"""


def _participants(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(k % 5 == 0, "server").when(k % 5 == 1, "proxy").otherwise(F.concat(F.lit("client_"), (k % 5).cast("string"))).alias("participant"),
        (k % 37 != 0).alias("has_receipt"),
        F.when(k % 41 == 0, None).when(k % 43 == 0, "failed").otherwise("completed").alias("status"),
        (k % 3 != 0).cast("int").alias("feature_files"),
        (k % 2).cast("int").alias("truth_files"),
        F.lit(3).alias("expected_clients"),
    )


@query(
    COLLECT_SQL
    + " SELECT run_id, collected_clients, expected_clients, CASE WHEN len(issues) = 0 THEN 'VALID' ELSE 'PARTIAL' END AS status, array_to_string(issues, '; ') AS issues FROM v"
)
def collection_validation(spark, sf_dir):
    checked = A.collection_validation(_participants(spark, sf_dir), "run_id")
    return checked.withColumn("issues", F.concat_ws("; ", "issues"))


@query(COLLECT_SQL + " SELECT run_id, count(*) AS rows FROM p WHERE run_id IN (SELECT run_id FROM v WHERE len(issues) = 0) GROUP BY 1")
def valid_runs(spark, sf_dir):
    rows = _participants(spark, sf_dir)
    kept = A.valid_runs(rows, A.collection_validation(rows, "run_id"), "run_id")
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH w AS (SELECT c_custkey AS run_id, c_mktsegment AS client_id, sha256(CASE WHEN c_custkey % 2 = 0 THEN 'bin=0.25' ELSE 'bin=0.5' END) AS config_sha256 FROM customer),
d AS (SELECT c_custkey AS run_id, c_mktsegment AS client_id, sha256('bin=0.25') AS config_sha256 FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
SELECT run_id, client_id, config_sha256 FROM w ANTI JOIN d USING (run_id, client_id, config_sha256)"""
)
def resumable_work(spark, sf_dir):
    """Traces whose configuration digest has no finished part."""
    cu = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("client_id"))
    config = F.when(F.col("run_id") % 2 == 0, "bin=0.25").otherwise("bin=0.5")
    # Customers with orders are done under one configuration.
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"))
    done = cu.join(buyers, "run_id", "left_semi").withColumn("config_sha256", F.sha2(F.lit("bin=0.25"), 256))
    return D.only_new(cu, done, ["run_id", "client_id"], config)


@query(
    """SELECT o_orderstatus AS representation, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS position, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"""
)
def representation_comparison(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("representation")).agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("status", F.when(F.col("representation") == "P", "insufficient").otherwise("evaluated"))
    return A.comparison(s, ["F", "O", "P"]).select("representation", "position", "n")


# ---- partitions ----------------------------------------------------------------------

IID_SQL = """WITH h AS (SELECT doc_id, quality, ('0x' || substr(md5('42|' || doc_id), 1, 15))::BIGINT AS h FROM labels),
n AS (SELECT *, ntile(7) OVER (ORDER BY h, doc_id) - 1 AS client_index FROM h)"""


def _iid(spark, sf_dir):
    return S.iid_partitions(table(spark, sf_dir, "labels"), "doc_id", 7, 42)


@query(IID_SQL + " SELECT doc_id, client_index FROM n")
def iid_partition(spark, sf_dir):
    return _iid(spark, sf_dir).select("doc_id", "client_index")


@query(IID_SQL + " SELECT client_index, count(*) AS rows, count(*) FILTER (WHERE quality = 0) AS zeros, count(*) FILTER (WHERE quality = 1) AS ones FROM n GROUP BY 1")
def partition_histogram(spark, sf_dir):
    histogram = A.class_histograms(_iid(spark, sf_dir), "client_index", "quality")
    return histogram.select(
        "client_index",
        "rows",
        *[F.coalesce(F.try_element_at("class_histogram", F.lit(k)), F.lit(0)).alias(n) for k, n in (("0", "zeros"), ("1", "ones"))],
    )


@query(
    IID_SQL
    + """, d AS (SELECT client_index, quality, ('0x' || substr(md5('a|' || doc_id), 1, 15))::BIGINT % 1000000007 AS a, ('0x' || substr(md5('b|' || doc_id), 1, 15))::BIGINT % 1000000009 AS b FROM n),
c AS (SELECT client_index, quality, count(*) AS n, sum(a) AS a, sum(b) AS b FROM d GROUP BY 1, 2)
SELECT client_index, sum(n)::BIGINT AS row_count, string_agg(lpad(quality || '', 6, '0') || ':' || n, ',' ORDER BY quality) AS class_histogram, sha256(client_index || '|' || sum(n) || '|' || sum(a) || '|' || sum(b)) AS assignment_id FROM c GROUP BY 1"""
)
def partition_identity(spark, sf_dir):
    return S.assignment_identity(_iid(spark, sf_dir), "doc_id", "quality")


@query(
    """WITH h AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY ('0x' || substr(md5('73043|' || doc_id), 1, 15))::BIGINT, doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN rn <= least(greatest(round(n * 0.1), 1), n - 1) THEN 'calibration' ELSE 'train' END AS split FROM h"""
)
def calibration_holdout(spark, sf_dir):
    return S.calibration_holdout(table(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "split")


def _dirichlet_sql(clients: int, alpha: float, seed: int) -> str:
    d = alpha + 2 / 3
    c = 1 / (9 * d) ** 0.5

    def u(*parts: str) -> str:
        return f"((('0x' || substr(md5({" || '|' || ".join(str(x) for x in parts)}), 1, 15))::BIGINT::DOUBLE + 0.5) / {float(S.HASH_SPACE)!r})"

    key = [f"'{seed}'", "quality", "i"]
    return f"""WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1), cl AS (SELECT unnest(range(0, {clients})) AS i), tr AS (SELECT unnest(range(0, {S.GAMMA_ATTEMPTS})) AS k),
x AS (SELECT quality, i, k, sqrt(-2.0::DOUBLE * ln({u(*key, "k", "'r'")})) * cos({2 * math.pi!r}::DOUBLE * {u(*key, "k", "'t'")}) AS x, ln({u(*key, "k", "'a'")}) AS la, ln({u(*key, "'p'")}) AS lp FROM c, cl, tr),
v AS (SELECT *, pow(1.0::DOUBLE + {c!r}::DOUBLE * x, 3.0::DOUBLE) AS v FROM x), g AS (SELECT quality, i, k, {math.log(d)!r}::DOUBLE + ln(greatest(v, 1e-300::DOUBLE)) + lp / {alpha!r}::DOUBLE AS g FROM v
 WHERE k = {S.GAMMA_ATTEMPTS - 1} OR (v > 0 AND la < 0.5 * x * x + {d!r}::DOUBLE - {d!r}::DOUBLE * v + {d!r}::DOUBLE * ln(greatest(v, 1e-300::DOUBLE))) QUALIFY row_number() OVER (PARTITION BY quality, i ORDER BY k) = 1),
s AS (SELECT quality, i, exp(g - max(g) OVER (PARTITION BY quality)) AS s FROM g), e AS (SELECT quality, i, sum(s) OVER (PARTITION BY quality ORDER BY i) / sum(s) OVER (PARTITION BY quality) AS e FROM s),
cut AS (SELECT quality, i, floor(e * n + 0.5) AS z FROM e JOIN c USING (quality)), p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('{seed}|' || doc_id), 1, 15))::BIGINT, doc_id) AS pos FROM labels)
SELECT doc_id, quality, least(count(*) FILTER (z < pos), {clients - 1})::INTEGER AS client_index FROM p JOIN cut USING (quality) GROUP BY doc_id, quality, pos"""


@query(_dirichlet_sql(7, 0.5, 42))
def dirichlet_partition(spark, sf_dir):
    """Label-skewed split over seven clients, all of which get rows from the draw itself."""
    return S.dirichlet_partitions(table(spark, sf_dir, "labels"), "doc_id", "quality", 7, 0.5, 42).select(
        "doc_id", "quality", "client_index"
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN greatest(c_custkey - 1, 0) END AS slot FROM customer")
def partition_slots(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("client_"), k.cast("string"))).otherwise(F.concat(F.lit("edge_"), k.cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.partition_slot(name).alias("slot"))


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'iid' ELSE 'non_iid_alpha_0p5' END AS partition_token FROM orders")
def partition_tokens(spark, sf_dir):
    token = F.when(F.col("o_orderkey") % 2 == 0, S.partition_token("IID")).otherwise(S.partition_token("non-iid", 0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", token.alias("partition_token"))


@query(
    """WITH v AS (SELECT vec_id, label, (vec_id % 20) * 100 + label AS e FROM embeddings), d AS (SELECT DISTINCT label, e FROM v),
h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42|' || e), 1, 15))::BIGINT) AS rn, ('0x' || substr(md5('42|' || label), 1, 15))::BIGINT AS o FROM d),
f AS (SELECT v.*, ((rn - 1 + o) % 5)::INT AS fold FROM v JOIN h USING (label, e))
SELECT fold, count(DISTINCT label) AS classes, count(*) AS rows, count(DISTINCT e) AS experiments FROM f GROUP BY 1"""
)
def fold_stats(spark, sf_dir):
    from traceweave.operators.fisher import experiment_folds

    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", ((F.col("vec_id") % 20) * 100 + F.col("label")).alias("e"))
    assigned = df.join(experiment_folds(df, "label", "e", 5).drop("label"), "e")
    return A.fold_statistics(assigned, "fold", "label", "e")


@query("SELECT doc_id AS row_id, n_chars, lang FROM documents")
def paired_rows(spark, sf_dir):
    """Two tables of the same rows, paired by id; a row without partner would fail the query."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")
    return D.paired_rows(docs.select("row_id", "n_chars"), docs.select("row_id", "lang"))


@query(
    """SELECT doc_id AS row_id, n_chars::DOUBLE AS f0, octet_length(encode(text))::DOUBLE AS f1, lang AS family FROM documents"""
)
def labelled_matrix(spark, sf_dir):
    """Finite predictors from packet_count_total onward as a matrix with labels, by row id."""
    docs = table(spark, sf_dir, "documents")
    x = docs.select(
        F.col("doc_id").alias("row_id"),
        F.length("text").alias("before"),
        F.col("n_chars").alias("packet_count_total"),
        F.octet_length("text").cast("string").alias("bytes_total"),
        F.col("source").alias("mode"),
        F.col("n_chars").alias("device_load"),
    )
    names = D.student_predictors(x)
    made = D.labelled_matrix(x, docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("family")), names, "family")
    return made.select("row_id", *[F.col("features")[i].alias(f"f{i}") for i in range(len(names))], "family")


@query(
    IID_SQL
    + """, d AS (SELECT client_index, quality, ('0x' || substr(md5('a|' || doc_id), 1, 15))::BIGINT % 1000000007 AS a, ('0x' || substr(md5('b|' || doc_id), 1, 15))::BIGINT % 1000000009 AS b FROM n WHERE client_index = 3),
c AS (SELECT client_index, quality, count(*) AS n, sum(a) AS a, sum(b) AS b FROM d GROUP BY 1, 2)
SELECT client_index, sum(n)::BIGINT AS row_count, string_agg(lpad(quality || '', 6, '0') || ':' || n, ',' ORDER BY quality) AS class_histogram, sha256(client_index || '|' || sum(n) || '|' || sum(a) || '|' || sum(b)) AS assignment_id FROM c GROUP BY 1"""
)
def slot_assignment(spark, sf_dir):
    """The share of one client slot out of seven."""
    return S.slot_assignment(_iid(spark, sf_dir), 3, 7, "doc_id", "quality")


FOLD_SQL = """WITH v AS (SELECT vec_id, label, (vec_id % 20) * 100 + label AS e FROM embeddings), d AS (SELECT DISTINCT label, e FROM v),
h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42|' || e), 1, 15))::BIGINT) AS rn, ('0x' || substr(md5('42|' || label), 1, 15))::BIGINT AS o FROM d),
f AS (SELECT v.*, ((rn - 1 + o) % 5)::INT AS fold FROM v JOIN h USING (label, e)),
s AS (SELECT fold, count(DISTINCT label) AS classes, count(*) AS rows, count(DISTINCT e) AS experiments FROM f GROUP BY 1)"""


@query(
    FOLD_SQL
    + ", u AS (UNPIVOT s ON classes, rows, experiments INTO NAME metric VALUE v)"
    + f" SELECT metric, count(v) AS folds, {r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std FROM u GROUP BY 1"
)
def fold_spread(spark, sf_dir):
    """Mean and deviation over folds of their sizes."""
    return rounded(A.metric_spread(fold_stats(spark, sf_dir), [], ["classes", "rows", "experiments"]))
