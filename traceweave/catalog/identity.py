"""Identity queries: isolation, registrations, aliases and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query
from traceweave.catalog.tables import PACKETS_SQL, packets, parsed_packets, table
from traceweave.functions import exprs as X
from traceweave.operators import identity as I
from traceweave.operators import isolate as S

SHORT = ("experiment_id", "packet_index", "src_ip", "dst_ip", "direction")


def _clients(spark, sf_dir):
    """Addresses of all users, the client side of their packets."""
    user = table(spark, sf_dir, "events").select("user_id").distinct()
    return user.select(
        F.concat(F.lit("run_"), (F.col("user_id") % 12).cast("string")).alias("experiment_id"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("client_ip"),
        (F.lit(50000) + F.col("user_id") % 3).cast("int").alias("client_port"),
        F.concat(F.lit("trace_"), F.col("user_id").cast("string")).alias("alias"),
    )


CLIENTS_SQL = f"""WITH {PACKETS_SQL}, cl AS (SELECT DISTINCT 'run_' || (user_id % 12) AS experiment_id, '10.0.0.' || (user_id % 250) AS client_ip FROM events)"""


@query(
    CLIENTS_SQL
    + """ SELECT experiment_id, packet_index, src_ip, dst_ip, CASE WHEN (experiment_id, src_ip) IN (SELECT (experiment_id, client_ip) FROM cl) THEN 'up' ELSE 'down' END AS direction
FROM raw WHERE (experiment_id, src_ip) IN (SELECT (experiment_id, client_ip) FROM cl) OR (experiment_id, dst_ip) IN (SELECT (experiment_id, client_ip) FROM cl)"""
)
def client_isolation(spark, sf_dir):
    """Client-facing packets with directions from client membership, then server ip."""
    facing = S.client_facing(packets(spark, sf_dir), _clients(spark, sf_dir))
    return S.with_directions(facing, "10.0.0.251").select(*SHORT)


@query(
    f"""WITH {PACKETS_SQL}, cl AS (SELECT DISTINCT user_id FROM events)
SELECT experiment_id, packet_index, src_ip, dst_ip, CASE WHEN direction = 'down' THEN 'down' ELSE 'up' END AS direction, 'trace_' || cl.user_id AS alias
FROM raw JOIN cl ON '10.0.0.' || (cl.user_id % 250) = CASE WHEN direction = 'down' THEN dst_ip ELSE src_ip END AND 50000 + cl.user_id % 3 = CASE WHEN direction = 'down' THEN dst_port ELSE src_port END
 AND experiment_id = 'run_' || (cl.user_id % 12)"""
)
def connection_isolation(spark, sf_dir):
    dim = _clients(spark, sf_dir).withColumns({"proxy_ip": F.lit("10.0.0.251"), "proxy_port": F.lit(8080)})
    found = S.connection_facing(packets(spark, sf_dir), dim)
    return found.select(
        "experiment_id", "packet_index", "src_ip", "dst_ip", F.col("connection_direction").alias("direction"), "alias"
    )


@query(
    CLIENTS_SQL
    + """, both_ends AS (SELECT experiment_id, packet_index, src_ip AS client_ip, 'up' AS direction FROM raw UNION ALL SELECT experiment_id, packet_index, dst_ip, 'down' FROM raw)
SELECT experiment_id, client_ip, direction, count(*) AS packet_count, sum(packet_index)::BIGINT AS index_sum FROM both_ends JOIN cl USING (experiment_id, client_ip) GROUP BY 1, 2, 3"""
)
def per_client_direction(spark, sf_dir):
    seen = S.per_client(packets(spark, sf_dir), _clients(spark, sf_dir))
    return seen.groupBy("experiment_id", "client_ip", "direction").agg(
        F.count(F.lit(1)).alias("packet_count"), F.sum("packet_index").alias("index_sum")
    )


@query(
    f"""WITH {PACKETS_SQL}, r AS (SELECT packet_index, experiment_id, CASE WHEN k % 4 = 0 THEN '10.9.9.9' ELSE src_ip END AS s, dst_ip AS d FROM raw)
SELECT packet_index, CASE WHEN s LIKE '10.0.0.1%' AND NOT d LIKE '10.0.0.1%' THEN 'up' WHEN d LIKE '10.0.0.1%' AND NOT s LIKE '10.0.0.1%' THEN 'down' WHEN d = '10.0.0.251' THEN 'up' WHEN s = '10.0.0.251' THEN 'down' ELSE 'unknown' END AS direction FROM r"""
)
def direction_resolve(spark, sf_dir):
    k = F.col("k")
    src = F.when(k % 4 == 0, F.lit("10.9.9.9")).otherwise(F.col("src_ip"))
    client = "10.0.0.1"
    return packets(spark, sf_dir).select(
        "packet_index",
        X.direction_of(
            src.startswith(client),
            F.col("dst_ip").startswith(client),
            src == "10.0.0.251",
            F.col("dst_ip") == "10.0.0.251",
        ).alias("direction"),
    )


# ---- registrations -------------------------------------------------------------

CUSTOMER_SQL = """WITH cu AS (SELECT c_custkey, c_nationkey % 12 AS run_id, n_name || (c_custkey % 40) AS client_ip, c_custkey AS client_port, c_mktsegment AS client_id, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
oc AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"""


def _customers(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        "c_custkey",
        (F.col("c_nationkey") % 12).alias("run_id"),
        F.concat("n_name", (F.col("c_custkey") % 40).cast("string")).alias("client_ip"),
        F.col("c_custkey").alias("client_port"),
        F.col("c_mktsegment").alias("client_id"),
        "c_acctbal",
    )


def _order_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query(
    CUSTOMER_SQL
    + """, so AS (SELECT run_id, client_ip, any_value(client_id) AS sole FROM cu WHERE c_custkey > 0 GROUP BY 1, 2 HAVING count(DISTINCT client_id) = 1),
m AS (SELECT c_custkey, run_id, client_ip, CASE WHEN c_custkey % 3 = 0 THEN client_port + 100000 ELSE client_port END AS client_port FROM cu)
SELECT m.c_custkey, m.run_id, m.client_ip, coalesce(cu.client_id, sole) AS resolved_client_id, CASE WHEN cu.client_id IS NOT NULL THEN 'exact' WHEN sole IS NOT NULL THEN 'ip_only' ELSE 'none' END AS match
FROM m LEFT JOIN cu ON cu.run_id = m.run_id AND cu.client_ip = m.client_ip AND cu.client_port = m.client_port AND cu.c_custkey > 0 LEFT JOIN so ON so.run_id = m.run_id AND so.client_ip = m.client_ip"""
)
def registration_join(spark, sf_dir):
    """Aliases to clients by exact connection, else by the address's only owner."""
    cu = _customers(spark, sf_dir)
    events = cu.withColumns(
        {
            "event": F.when(F.col("c_custkey") % 2 == 0, I.REGISTERED).otherwise(I.CONFIRMED),
            "local_ip": F.concat(F.lit(" "), F.col("client_ip")),
            "local_port": F.col("client_port").cast("string"),
        }
    )
    moved = F.when(F.col("c_custkey") % 3 == 0, F.col("client_port") + 100000).otherwise(F.col("client_port"))
    manifest = cu.select("c_custkey", "run_id", "client_ip", moved.alias("client_port"))
    found = I.match_manifest(manifest, I.registrations(events))
    return found.select("c_custkey", "run_id", "client_ip", "resolved_client_id", "match")


@query(
    f"""WITH {PACKETS_SQL}, lg AS (SELECT packet_index, client_id, k, direction, e.event_type FROM pk JOIN events e ON e.event_id = packet_index),
reg AS (SELECT packet_index, client_id, 'h' || (packet_index % 50) AS ip, 1 + k AS port FROM lg WHERE event_type = 'click'),
con AS (SELECT packet_index, client_id, k FROM lg WHERE event_type = 'purchase'),
j AS (SELECT con.packet_index, con.client_id, con.k, arg_max(ip, reg.packet_index) AS ip, arg_max(port, reg.packet_index) AS port FROM con LEFT JOIN reg ON reg.client_id = con.client_id AND reg.packet_index < con.packet_index GROUP BY 1, 2, 3)
SELECT packet_index, client_id, CASE WHEN k % 2 = 1 THEN 'own' || k ELSE ip END AS client_ip, CASE WHEN k % 2 = 1 THEN 7 ELSE port END::BIGINT AS client_port FROM j WHERE k % 2 = 1 OR ip IS NOT NULL"""
)
def asof_registration(spark, sf_dir):
    """Address of confirmations: their own, else the latest earlier registration."""
    kinds = table(spark, sf_dir, "events").select(F.col("event_id").alias("packet_index"), "event_type")
    k = F.col("k")
    log = packets(spark, sf_dir).join(kinds, "packet_index")
    own = (F.col("event_type") == "purchase") & (k % 2 == 1)
    reg = F.col("event_type") == "click"
    log = log.select(
        "packet_index",
        "client_id",
        F.when(reg, I.REGISTERED).when(F.col("event_type") == "purchase", I.CONFIRMED).otherwise("other").alias("event"),
        F.when(reg, F.concat(F.lit("h"), (F.col("packet_index") % 50).cast("string")))
        .when(own, F.concat(F.lit("own"), k.cast("string")))
        .otherwise("")
        .alias("local_ip"),
        F.when(reg, (k + 1).cast("string")).when(own, "7").otherwise("0").alias("local_port"),
    )
    found = I.registration_as_of(log, ["client_id"], ["packet_index"])
    return found.select("packet_index", "client_id", "client_ip", "client_port")


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey % 12 AS run_id, o_orderpriority AS client_id, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey % 120 ELSE o_totalprice::BIGINT END AS n FROM orders),
m AS (SELECT *, max(n) OVER (PARTITION BY run_id, client_id) AS big FROM a)
SELECT run_id, client_id, count(*) AS kept, sum(n)::BIGINT AS packet_count FROM m WHERE NOT (n < 100 AND n < big * 0.0001) GROUP BY 1, 2"""
)
def retry_prune(spark, sf_dir):
    key = F.col("o_orderkey")
    count = F.when(key % 50 == 0, key % 120).otherwise(F.rint("o_totalprice").cast("long"))
    aliases = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 12).alias("run_id"), F.col("o_orderpriority").alias("client_id"), count.alias("n")
    )
    kept = I.prune_retries(aliases, ["run_id", "client_id"], "n")
    return kept.groupBy("run_id", "client_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("packet_count"))


@query(
    CUSTOMER_SQL
    + """, ob AS (SELECT run_id, client_ip, client_port, n * CASE WHEN c_custkey % 5 = 0 THEN 1000000 ELSE 1 END AS n FROM cu JOIN oc ON o_custkey = c_custkey),
cf AS (SELECT DISTINCT run_id, client_id, client_ip, client_port FROM cu WHERE c_acctbal > 5000),
rg AS (SELECT run_id, client_id, client_ip, client_port FROM cu WHERE c_acctbal > 0),
lw AS (SELECT rg.*, coalesce(ob.n, 0) AS n FROM rg LEFT JOIN ob USING (run_id, client_ip, client_port) WHERE (run_id, client_id) NOT IN (SELECT (run_id, client_id) FROM cf)),
lb AS (SELECT run_id, client_id, client_ip, client_port FROM (SELECT *, row_number() OVER (PARTITION BY run_id, client_id ORDER BY n DESC, client_ip DESC, client_port DESC) AS rn FROM lw) WHERE rn = 1),
sd AS (SELECT *, 'network_registration_confirmed' AS base FROM cf UNION ALL SELECT *, 'legacy_longest_registered_connection' FROM lb),
ow AS (SELECT run_id, client_ip, count(DISTINCT client_id) AS owners FROM sd GROUP BY 1, 2),
ad AS (SELECT run_id, client_ip, max(n) AS big, count(*) AS seen FROM ob GROUP BY 1, 2),
se AS (SELECT sd.*, owners = 1 AND coalesce(seen, 0) > 0 AS op, big, seen FROM sd JOIN ow USING (run_id, client_ip) LEFT JOIN ad USING (run_id, client_ip)),
ex AS (SELECT DISTINCT se.run_id, se.client_id, se.client_ip, ob.client_port, base, (ob.n < 100 AND ob.n < big * 0.0001) AS tiny, seen FROM se JOIN ob ON ob.run_id = se.run_id AND ob.client_ip = se.client_ip WHERE op),
fl AS (SELECT run_id, client_id, max((seen > 1)::INT) AS more, max(tiny::INT) AS cut FROM ex GROUP BY 1, 2),
un AS (SELECT run_id, client_id, client_ip, client_port, base FROM se WHERE NOT op UNION SELECT run_id, client_id, client_ip, client_port, base FROM ex WHERE NOT tiny)
SELECT u.run_id, u.client_id, u.client_ip, u.client_port, coalesce(ob.n, 0) AS packet_count, base || CASE WHEN coalesce(more, 0) = 1 THEN '_same_ip_reconnects' ELSE '' END || CASE WHEN coalesce(cut, 0) = 1 THEN '_retry_fragments_removed' ELSE '' END AS reason
FROM un u LEFT JOIN ob USING (run_id, client_ip, client_port) LEFT JOIN fl USING (run_id, client_id)"""
)
def connection_resolution(spark, sf_dir):
    """Connections of every client: seeds, reconnects of sole-owner addresses, no retries."""
    cu = _customers(spark, sf_dir)
    scale = F.when(F.col("c_custkey") % 5 == 0, 1000000).otherwise(1)
    observed = cu.join(_order_counts(spark, sf_dir), "c_custkey").select(
        "run_id", "client_ip", "client_port", (F.col("n") * scale).alias("packet_count")
    )
    columns = ["run_id", "client_id", "client_ip", "client_port"]
    confirmed = cu.where("c_acctbal > 5000").select(*columns)
    registered = cu.where("c_acctbal > 0").select(*columns)
    return I.choose_connections(registered, confirmed, observed)


@query(
    CUSTOMER_SQL
    + " SELECT run_id, arg_max(c_custkey, (coalesce(n, 0), c_custkey)) AS c_custkey FROM cu LEFT JOIN oc ON o_custkey = c_custkey GROUP BY 1"
)
def largest_connection(spark, sf_dir):
    joined = _customers(spark, sf_dir).join(_order_counts(spark, sf_dir), "c_custkey", "left")
    return joined.groupBy("run_id").agg(
        F.max_by("c_custkey", F.struct(F.coalesce("n", F.lit(0)), F.col("c_custkey"))).alias("c_custkey")
    )


@query(
    """SELECT l_suppkey AS folder, count(*) AS rows FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey % 100 = l_suppkey AND o_orderkey % 12 = l_partkey % 12 AND o_orderkey % 7 + 1 = l_linenumber) GROUP BY 1"""
)
def manifest_backed(spark, sf_dir):
    features = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("folder"), (F.col("l_partkey") % 12).alias("run_id"), F.col("l_linenumber").cast("long").alias("alias")
    )
    manifest = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("folder"),
        (F.col("o_orderkey") % 12).alias("run_id"),
        (F.col("o_orderkey") % 7 + 1).alias("alias"),
    )
    kept = I.backed_by_manifest(features, manifest, ["folder", "run_id", "alias"])
    return kept.groupBy("folder").agg(F.count(F.lit(1)).alias("rows"))


@query(
    """WITH f AS (SELECT c_custkey, c_custkey % 300 AS run_id, c_custkey % 10 AS alias FROM customer), m AS (SELECT DISTINCT o_custkey % 300 AS run_id, o_custkey % 10 AS alias FROM orders)
SELECT c_custkey, run_id, alias FROM f WHERE (run_id, alias) IN (SELECT (run_id, alias) FROM m) OR run_id NOT IN (SELECT run_id FROM m)"""
)
def unmatched_exclusion(spark, sf_dir):
    features = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 300).alias("run_id"), (F.col("c_custkey") % 10).alias("alias")
    )
    # Customers with orders are mapped.
    mapping = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 300).alias("run_id"), (F.col("o_custkey") % 10).alias("alias")
    ).distinct()
    return I.mapped_only(features, mapping, "run_id", "alias").select("c_custkey", "run_id", "alias")


@query(
    """WITH r AS (SELECT o_custkey % 500 AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'pending_server' ELSE 'final' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS family, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'd' || (o_custkey % 500) END AS dataset FROM orders),
u AS (SELECT run_id, status, 'family' AS field, family AS value FROM r UNION ALL SELECT run_id, status, 'dataset', dataset FROM r),
v AS (SELECT run_id, field, min(CASE WHEN value <> '' AND NOT (status = 'pending_server' AND field = 'dataset') THEN value END) AS lo, max(CASE WHEN value <> '' AND NOT (status = 'pending_server' AND field = 'dataset') THEN value END) AS hi FROM u GROUP BY 1, 2)
SELECT run_id, field, lo AS value, CASE WHEN lo IS NULL THEN 'missing' WHEN lo = hi THEN 'ok' ELSE 'conflict' END AS consensus FROM v"""
)
def label_consensus(spark, sf_dir):
    key = F.col("o_orderkey")
    run = (F.col("o_custkey") % 500).alias("run_id")
    records = table(spark, sf_dir, "orders").select(
        run,
        F.when(key % 3 == 0, "pending_server").otherwise("final").alias("status"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderstatus")).alias("family"),
        F.when(key % 3 == 0, "x").otherwise(F.concat(F.lit("d"), (F.col("o_custkey") % 500).cast("string"))).alias("dataset"),
    )
    return I.label_consensus(records, ["run_id"], ["family", "dataset"])


@query(
    """WITH r AS (SELECT c_custkey, c_custkey % 700 AS run_id FROM customer), p AS (SELECT c_custkey, c_custkey % 700 AS run_id, c_mktsegment AS family FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
s AS (SELECT run_id, min(family) AS family FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT r.c_custkey, r.run_id, coalesce(p.family, s.family) AS family FROM r LEFT JOIN p USING (run_id, c_custkey) LEFT JOIN s USING (run_id)"""
)
def label_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 700).alias("run_id"))
    # Customers with orders are labelled.
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    labels = table(spark, sf_dir, "customer").join(buyers, "c_custkey", "left_semi").select(
        "c_custkey", (F.col("c_custkey") % 700).alias("run_id"), F.col("c_mktsegment").alias("family")
    )
    return I.with_labels(rows, labels, "run_id", "c_custkey", ["family"]).select("c_custkey", "run_id", "family")


@query(
    """WITH m AS (SELECT o_custkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS rk, lpad(o_orderkey || '', 9, '0') AS path, o_orderstatus AS framework, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS runtime FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rk, path) AS rn FROM m) SELECT run_id, framework, runtime FROM n WHERE rn = 1"""
)
def run_metadata(spark, sf_dir):
    key = F.col("o_orderkey")
    manifests = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.when(key % 3 == 0, "proxy").when(key % 3 == 1, "server").otherwise("client").alias("role"),
        F.lpad(key.cast("string"), 9, "0").alias("path"),
        F.col("o_orderstatus").alias("framework"),
        F.when(key % 4 == 0, " ").otherwise(F.col("o_orderpriority")).alias("runtime"),
    )
    return I.run_metadata(manifests, "run_id", ["framework", "runtime"])


@query(
    f"""WITH {PACKETS_SQL}, cl AS (SELECT DISTINCT 'run_' || (user_id % 12) AS experiment_id, '10.0.0.' || (user_id % 250) AS client_ip FROM events),
f AS (SELECT pp.*, src_ip AS cip, 'up' AS d FROM pp WHERE direction <> 'down' UNION ALL SELECT pp.*, dst_ip, 'down' FROM pp WHERE direction = 'down')
SELECT f.experiment_id, cip AS client_ip, count(*) AS packet_count_total, count(*) FILTER (WHERE d = 'up') AS packet_count_up, sum(frame_length)::BIGINT AS bytes_total, sum(tcp_syn)::BIGINT AS tcp_syn_count
FROM f JOIN cl ON cl.experiment_id = f.experiment_id AND cl.client_ip = cip GROUP BY 1, 2"""
)
def trace_repair(spark, sf_dir):
    """An over-broad capture cut down to its clients: isolation, direction, flags, features."""
    from traceweave.plans.jobs import repaired_features

    fixed = repaired_features(packets(spark, sf_dir), _clients(spark, sf_dir), scales=[])
    return fixed.select(
        "experiment_id", "client_ip", "packet_count_total", "packet_count_up", "bytes_total", "tcp_syn_count"
    )


@query(
    f"""WITH {PACKETS_SQL} SELECT experiment_id, client_id, count(*) AS packet_count, sum(tcp_ack)::BIGINT AS acks, count(*) FILTER (WHERE direction = 'up') AS up_packets, sum(len(tls))::BIGINT AS tls_records FROM pp GROUP BY 1, 2"""
)
def raw_packet_scan(spark, sf_dir):
    """Packets written as text columns and parsed back by the raw-packet reader."""
    from traceweave.sources.scan import raw_packets

    text = packets(spark, sf_dir).withColumnRenamed("tls_text", "tls_record_lengths")
    text = text.select(
        *[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) if c == "frame_length" else F.col(c).cast("string").alias(c) for c in text.columns if c != "direction"]
    )
    rows = raw_packets(text).join(packets(spark, sf_dir).select("packet_index", "direction"), "packet_index")
    return rows.groupBy("experiment_id", "client_id").agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("tcp_ack").alias("acks"),
        F.count(F.when(F.col("direction") == "up", 1)).alias("up_packets"),
        F.sum(F.size("tls_record_lengths")).alias("tls_records"),
    )


@query(
    f"""WITH {PACKETS_SQL} SELECT packet_index, timestamp_epoch, frame_length, src_ip, dst_ip, src_port, dst_port, transport_protocol, tcp_syn, tcp_ack, tcp_fin, tcp_rst, retransmission, array_to_string(tls, ';') AS tls FROM pp"""
)
def decoded_packet_scan(spark, sf_dir):
    """Decoder text lines, split and parsed as a stream or pipe would deliver them."""
    from traceweave.sources.scan import decoded_packets, split_decoded_line

    k, tcp = F.col("k"), F.col("transport_protocol") == "TCP"
    v6 = k % 4 == 3

    def only(condition, column):
        return F.when(condition, F.col(column).cast("string")).otherwise("")

    line = F.concat_ws(
        "\t",
        F.col("packet_index").cast("string"),
        F.col("timestamp_epoch").cast("string"),
        F.col("frame_length").cast("string"),
        only(~v6, "src_ip"),
        only(~v6, "dst_ip"),
        only(v6, "src_ip"),
        only(v6, "dst_ip"),
        only(tcp, "src_port"),
        only(tcp, "dst_port"),
        only(~tcp, "src_port"),
        only(~tcp, "dst_port"),
        F.when(~v6, F.when(tcp, "6").otherwise("17")).otherwise(""),
        F.when(v6, F.when(tcp, "6").otherwise("17")).otherwise(""),
        F.col("tcp_flags_hex"),
        F.lit(""),
        F.lit(""),
        F.lit(""),
        F.lit(""),
        F.when(F.col("retransmission") == 1, "1").otherwise(""),
        F.translate("tls_text", ";", ","),
    )
    lines = packets(spark, sf_dir).select(line.alias("line"))
    parsed = decoded_packets(lines.select(*split_decoded_line("line")))
    return parsed.select(
        *[c for c in parsed.columns if c not in ("tls_record_lengths", "tcp_flags_hex")],
        F.concat_ws(";", F.transform("tls_record_lengths", lambda v: v.cast("string"))).alias("tls"),
    )


@query(
    f"""WITH {PACKETS_SQL} SELECT packet_index, client_id AS client_label, timestamp_epoch, frame_length::DOUBLE AS frame_length, direction, transport_protocol FROM pk JOIN raw USING (packet_index, experiment_id, client_id, timestamp_epoch, frame_length, direction)"""
)
def safe_sequence_scan(spark, sf_dir):
    """A server-side safe table: swapped direction words, alias time column, client column."""
    from traceweave.sources.scan import safe_sequence, with_client

    d = F.col("direction")
    rows = packets(spark, sf_dir).select(
        "packet_index",
        F.regexp_replace("client_id", "client_", "Client-").alias("client_id"),
        F.col("timestamp_epoch").cast("string").alias("time_epoch"),
        F.lit("").alias("timestamp"),
        F.col("frame_length").cast("string").alias("frame_length"),
        F.when(d == "up", "RX").when(d == "down", "sent").otherwise("?").alias("direction"),
        F.lower("transport_protocol").alias("protocol"),
    )
    seen = with_client(safe_sequence(rows, "server"), "server", F.lit(""), F.lit("server"))
    return seen.select("packet_index", "client_label", "timestamp_epoch", "frame_length", "direction", "transport_protocol")


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'client_' || (c_custkey % 9) WHEN 2 THEN 'client_' || c_custkey ELSE NULL END AS client_label FROM customer WHERE c_custkey % 4 IN (0, 2)"""
)
def sequence_identity(spark, sf_dir):
    """Client from path or participant; files that name two clients are rejected."""
    from traceweave.sources.scan import with_client

    key, i = F.col("c_custkey"), F.col("c_custkey") % 4
    df = table(spark, sf_dir, "customer").select("c_custkey")
    number = key.cast("string")
    path = (
        F.when(i == 0, F.concat(F.lit("run_1/client"), (key % 9).cast("string"), F.lit("/seq.csv")))
        .when(i == 1, F.lit("run_1/client_1/client_2.csv"))
        .when(i == 2, F.concat(F.lit("run_1/Client-"), number, F.lit("/x.csv")))
        .otherwise(F.lit("run_1/server/x.csv"))
    )
    return with_client(df, "server", path, F.lit("server")).select("c_custkey", "client_label")


@query(
    """WITH m AS (SELECT conv_id, turn, conv_id % 12 AS run, role, length(text) AS n FROM conversations)
SELECT 'run_' || run AS run_id, role || turn AS alias, '10.1.' || conv_id AS client_ip, turn + 1 AS client_port, n AS packet_count, (conv_id * 100 + n * 0.5)::DOUBLE AS base_epoch, conv_id FROM m WHERE turn <> 2"""
)
def manifest_scan(spark, sf_dir):
    """Nested capture manifests (one per conversation) exploded to connections."""
    from traceweave.sources.scan import MANIFEST_SCHEMA, manifest_entries

    item = F.to_json(
        F.struct(
            F.concat(F.lit("10.1."), F.col("conv_id").cast("string")).alias("client_ip"),
            F.when(F.col("turn") == 2, "0").otherwise((F.col("turn") + 1).cast("string")).alias("client_port"),
            F.length("text").cast("string").alias("packet_count"),
            (F.length("text") * 0.5).cast("string").alias("trace_start_offset_sec"),
        )
    )
    entries = table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat(F.lit('"'), F.concat("role", F.col("turn").cast("string")), F.lit('":'), item).alias("e")
    )
    docs = entries.groupBy("conv_id").agg(F.concat_ws(",", F.collect_list("e")).alias("body")).select(
        "conv_id",
        F.concat(
            F.lit('{"run_id":"","experiment_id":"run_'), (F.col("conv_id") % 12).cast("string"),
            F.lit('","capture":{"capture_start_epoch":'), (F.col("conv_id") * 100).cast("string"),
            F.lit('},"outputs":{"per_client":{'), F.col("body"), F.lit("}}}"),
        ).alias("doc"),
    )
    parsed = docs.select("conv_id", F.from_json("doc", MANIFEST_SCHEMA).alias("m")).select("conv_id", "m.*")
    return manifest_entries(parsed)


@query(
    """WITH f AS (SELECT o_orderkey, 'run_' || (o_custkey % 900) AS run_id, (o_custkey % 5 = 0 AND o_orderkey % 2 = 0)::INT AS has FROM orders), b AS (SELECT run_id, max(has) AS best FROM f GROUP BY 1)
SELECT o_orderkey, run_id FROM f JOIN b USING (run_id) WHERE has = best AND run_id IN (SELECT 'run_' || (c_custkey % 900) FROM customer)"""
)
def feature_precedence(spark, sf_dir):
    """Per-client feature files replace combined ones, run by run, for allowed runs."""
    from traceweave.sources.scan import prefer_per_client

    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("run_"), (F.col("o_custkey") % 900).cast("string")).alias("experiment_id"),
        F.when((F.col("o_custkey") % 5 == 0) & (F.col("o_orderkey") % 2 == 0), "c1").otherwise("").alias("client_capture_id"),
        F.lit("/x/features.csv").alias("path"),
    )
    allowed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run_"), (F.col("c_custkey") % 900).cast("string")).alias("run_id")
    ).distinct()
    return prefer_per_client(rows, allowed).select("o_orderkey", "run_id")


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'server' WHEN page_id % 3 = 1 THEN 'client' ELSE 'gateway' END AS endpoint_role, CASE WHEN page_id % 3 = 1 THEN 'client_' || (page_id % 6) WHEN page_id % 3 = 2 THEN 'client_' || page_id END AS endpoint_client, 'run_' || (page_id % 12) AS run_id FROM pages"""
)
def endpoint_scan(spark, sf_dir):
    """Role and client of endpoint tables from columns, else from the path."""
    from traceweave.sources.scan import endpoint_identity

    p = F.col("page_id")
    kind = F.when(p % 3 == 0, F.lit("Server")).otherwise(F.concat(F.lit("client_"), (p % 6).cast("string")))
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("/d/run_"), (p % 12).cast("string"), F.lit("/"), kind, F.lit("/resource.csv")).alias("path"),
        F.when(p % 3 == 2, "Gateway").alias("role"),
        F.when(p % 3 == 2, p.cast("string")).alias("client_id"),
    )
    return endpoint_identity(rows).select("page_id", "endpoint_role", "endpoint_client", "run_id")


@query(
    """WITH a AS (SELECT url AS path, octet_length(encode(html)) AS size_bytes, sha256(html) AS sha FROM pages)
SELECT p.url AS path, CASE WHEN page_id % 50 = 0 THEN 'digest_mismatch' WHEN page_id % 50 = 1 THEN 'size_mismatch' WHEN page_id % 50 = 2 THEN 'unlisted' ELSE 'ok' END AS state FROM pages p"""
)
def bundle_verify(spark, sf_dir):
    """Bundle files against their manifest, where some entries were altered or left out; urls repeat, so a page is a bundle."""
    from traceweave.sources.scan import bundle_inventory, verify_bundle

    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("content"))
    actual = bundle_inventory(pages, ["page_id"])
    p = F.col("page_id")
    manifest = actual.where("page_id % 50 <> 2").select(
        "page_id",
        "path",
        F.when(p % 50 == 1, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(p % 50 == 0, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return verify_bundle(actual, manifest, ["page_id"]).select("path", "state")


@query(
    """WITH a AS (SELECT page_id % 7 AS bundle, url, octet_length(encode(html)) AS b, url || '|' || octet_length(encode(html)) || '|' || sha256(html) AS entry, substr(sha256(url), 1, 3) AS g FROM pages),
d AS (SELECT bundle, g, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS d, count(*) AS n, sum(b) AS b FROM a GROUP BY 1, 2)
SELECT bundle, sha256(string_agg(d, chr(10) ORDER BY g)) AS bundle_id, sum(n)::BIGINT AS file_count, sum(b)::BIGINT AS total_bytes FROM d GROUP BY 1"""
)
def bundle_identity(spark, sf_dir):
    from traceweave.sources.scan import bundle_identity as identity_of
    from traceweave.sources.scan import bundle_inventory

    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 7).alias("bundle"), F.col("url").alias("path"), F.col("html").alias("content")
    )
    return identity_of(bundle_inventory(pages, ["bundle"]), ["bundle"])


CANON_SQL = f"""WITH {PACKETS_SQL}, cn AS (SELECT DISTINCT experiment_id AS run_id, 'trace_' || user_id AS client_id, '10.0.0.' || (user_id % 250) AS client_ip, CAST(50000 + user_id % 3 AS INTEGER) AS client_port FROM raw),
sole AS (SELECT run_id, client_ip, client_port, min(client_id) AS client_id FROM cn GROUP BY 1, 2, 3),
ends AS (SELECT *, CASE WHEN direction = 'down' THEN dst_ip ELSE src_ip END AS client_ip, CASE WHEN direction = 'down' THEN dst_port ELSE src_port END AS client_port FROM raw),
j AS (SELECT s.client_id AS owner, e.* FROM ends e JOIN sole s ON s.run_id = e.experiment_id AND s.client_ip = e.client_ip AND s.client_port = e.client_port),
dd AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, owner, floor(timestamp_epoch * 1e6 + 0.5), frame_length, src_ip, dst_ip, src_port, dst_port, transport_protocol, tcp_flags_hex ORDER BY timestamp_epoch, packet_index) AS rn FROM j),
se AS (SELECT experiment_id, owner AS client_id, count(*) AS packet_count, count(DISTINCT client_ip || ':' || client_port) AS connections_seen, count(DISTINCT k % 4) AS chunk_count FROM dd WHERE rn = 1 GROUP BY 1, 2)"""


@query(
    CANON_SQL
    + """ SELECT run_id AS experiment_id, client_id, count(*) AS connections_chosen, 'registered' AS reason, any_value(packet_count) AS packet_count, any_value(connections_seen) AS connections_seen, any_value(chunk_count) AS chunk_count
FROM sole JOIN se ON se.experiment_id = run_id AND se.client_id = sole.client_id GROUP BY 1, 2, sole.client_id""".replace("client_id, count(*) AS connections", "sole.client_id, count(*) AS connections")
)
def canonical_trace_audit(spark, sf_dir):
    """Audit rows of traces put together from capture chunks and chosen connections."""
    from traceweave.plans.jobs import canonical_traces

    columns = ["experiment_id", "client_ip", "client_port"]
    chosen = _clients(spark, sf_dir).groupBy(*columns).agg(F.min("alias").alias("client_id"))
    chosen = chosen.withColumnRenamed("experiment_id", "run_id").withColumn("reason", F.lit("registered"))
    capture = parsed_packets(spark, sf_dir).withColumn("chunk_number", F.col("k") % 4)
    return canonical_traces(capture, chosen, "chunk_number", scales=[])["audit"]
