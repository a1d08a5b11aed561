"""Trace queries over the events table read as packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.tables import BURST_GAP, DAY, IDLE, PACKETS_SQL, SCALES, parsed_packets
from traceweave.functions import exprs as X
from traceweave.functions.exprs import rounded
from traceweave.operators import features as FE
from traceweave.operators import sampling as S

QS = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p90": 0.9, "p95": 0.95}
G = "experiment_id, client_id, s, w"


def _four(prefix: str, v: str, where: str = "true") -> list[str]:
    f = f"FILTER (WHERE {where})"
    return [
        f"coalesce(avg({v}) {f}, 0) AS {prefix}_mean",
        f"coalesce(stddev_pop({v}) {f}, 0) AS {prefix}_std",
        f"coalesce(min({v}) {f}, 0)::DOUBLE AS {prefix}_min",
        f"coalesce(max({v}) {f}, 0)::DOUBLE AS {prefix}_max",
    ]


def _moments(prefix: str, v: str, m: str, sd: str) -> list[str]:
    return [
        f"CASE WHEN count({v}) >= 3 AND any_value({sd}) > 0 THEN avg(((({v}) - {m}) / {sd}) ** 3) ELSE 0 END AS {prefix}_skewness",
        f"CASE WHEN count({v}) >= 4 AND any_value({sd}) > 0 THEN avg(((({v}) - {m}) / {sd}) ** 4) - 3 ELSE 0 END AS {prefix}_kurtosis",
    ]


def _quantiles(prefix: str, v: str) -> list[str]:
    return [f"coalesce(quantile_cont(({v})::DOUBLE, {p}), 0) AS {prefix}_{n}" for n, p in QS.items()]


def _entropy_cte(name: str, v: str) -> str:
    return f"""
{name}_lim AS (SELECT {G}, min({v})::DOUBLE lo, max({v})::DOUBLE hi, count({v}) n FROM seq WHERE {v} IS NOT NULL GROUP BY ALL),
{name}_bin AS (
  SELECT {G}, n, least(floor(({v} - lo) / (hi - lo) * least(32, greatest(4, floor(sqrt(n))))), least(32, greatest(4, floor(sqrt(n)))) - 1) b, count(*) c
  FROM seq JOIN {name}_lim USING (experiment_id, client_id, s, w) WHERE {v} IS NOT NULL AND hi > lo GROUP BY ALL),
{name}_ent AS (SELECT {G}, -sum((c / n) * log2(c / n)) AS {name}_entropy FROM {name}_bin GROUP BY ALL)"""


def features_sql(scales) -> str:
    scale_list = ", ".join(f"{s}::DOUBLE" for s in (0.0, *scales))
    main = [
        "count(*) AS packet_count_total",
        "count(*) FILTER (WHERE direction = 'up') AS packet_count_up",
        "count(*) FILTER (WHERE direction = 'down') AS packet_count_down",
        "count(*) FILTER (WHERE direction = 'unknown') AS packet_count_unknown",
        "sum(frame_length)::BIGINT AS bytes_total",
        "coalesce(sum(frame_length) FILTER (WHERE direction = 'up'), 0)::BIGINT AS bytes_up",
        "coalesce(sum(frame_length) FILTER (WHERE direction = 'down'), 0)::BIGINT AS bytes_down",
        "max(t) - min(t) AS span",
        "sum(switched)::BIGINT AS direction_switch_count",
        f"count(*) FILTER (WHERE iat > {IDLE}) AS idle_gap_count",
        f"coalesce(sum(iat) FILTER (WHERE iat > {IDLE}), 0) AS idle_time_total_sec",
        f"coalesce(avg(iat) FILTER (WHERE iat > {IDLE}), 0) AS idle_time_mean_sec",
        f"coalesce(max(iat) FILTER (WHERE iat > {IDLE}), 0) AS idle_time_max_sec",
        "count(*) FILTER (WHERE transport_protocol = 'TCP') AS tcp_packet_count",
        "count(*) FILTER (WHERE transport_protocol = 'UDP') AS udp_packet_count",
        *[f"sum(tcp_{f})::BIGINT AS tcp_{f}_count" for f in ("syn", "ack", "fin", "rst")],
        "sum(retransmission)::BIGINT AS tcp_retransmission_count",
        "sum(len(tls))::BIGINT AS tls_record_count",
        "count(DISTINCT conn) AS connection_count",
        "count(*) FILTER (WHERE nb = 1) AS burst_count_total",
        "count(*) FILTER (WHERE nb = 1 AND direction = 'up') AS burst_count_up",
        "count(*) FILTER (WHERE nb = 1 AND direction = 'down') AS burst_count_down",
        *_four("packet_size", "frame_length"),
        *_quantiles("packet_size", "frame_length"),
        *_moments("packet_size", "frame_length", "fm", "fs"),
        *_four("upload_packet_size", "frame_length", "direction = 'up'"),
        *_four("download_packet_size", "frame_length", "direction = 'down'"),
        *_four("iat_sec", "iat"),
        *_quantiles("iat_sec", "iat"),
        *_moments("iat_sec", "iat", "im", "isd"),
        *_four("burst_interval_sec", "iat", "nb = 1"),
    ]
    final_names = FE.PREDICTORS
    derived = {
        "bytes_unknown": "bytes_total - bytes_up - bytes_down",
        "upload_download_packet_ratio": "CASE WHEN packet_count_down = 0 THEN 0 ELSE packet_count_up / packet_count_down END",
        "upload_download_byte_ratio": "CASE WHEN bytes_down = 0 THEN 0 ELSE bytes_up / bytes_down END",
        "upload_packet_fraction": "CASE WHEN packet_count_total = 0 THEN 0 ELSE packet_count_up / packet_count_total END",
        "download_packet_fraction": "CASE WHEN packet_count_total = 0 THEN 0 ELSE packet_count_down / packet_count_total END",
        "upload_byte_fraction": "CASE WHEN bytes_total = 0 THEN 0 ELSE bytes_up / bytes_total END",
        "download_byte_fraction": "CASE WHEN bytes_total = 0 THEN 0 ELSE bytes_down / bytes_total END",
        "direction_switch_rate": "CASE WHEN packet_count_total < 2 THEN 0 ELSE direction_switch_count / (packet_count_total - 1) END",
        **{
            n: f"CASE WHEN duration_sec = 0 THEN 0 ELSE {c} / duration_sec END"
            for n, c in {
                "packets_per_second": "packet_count_total",
                "bytes_per_second": "bytes_total",
                "upload_packets_per_second": "packet_count_up",
                "download_packets_per_second": "packet_count_down",
                "upload_bytes_per_second": "bytes_up",
                "download_bytes_per_second": "bytes_down",
                "burst_frequency_per_second": "burst_count_total",
            }.items()
        },
    }
    integers = [n for n in final_names if n.endswith("_count") or n.startswith(("packet_count_", "bytes_")) or n in ("burst_count_total", "burst_count_up", "burst_count_down", "idle_gap_count")]
    integers = [n for n in integers if n != "bytes_per_second"]
    columns = []
    for n in final_names:
        e = derived.get(n, n)
        columns.append(f"coalesce({e}, 0) AS {n}" if n in integers else f"{r6(f'coalesce({e}, 0)')} AS {n}")
    burst = [
        *_four("burst_bytes", "b_bytes"),
        *_four("burst_packets", "b_packets"),
        *_four("burst_duration_sec", "b_dur"),
    ]
    return f"""
WITH {PACKETS_SQL},
base AS (
  SELECT *, timestamp_epoch AS t, min(timestamp_epoch) OVER tr AS t0, max(timestamp_epoch) OVER tr AS t1,
    transport_protocol || '|' || least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS conn
  FROM pp WINDOW tr AS (PARTITION BY experiment_id, client_id)),
sc AS (SELECT unnest([{scale_list}]) AS s),
bin AS (
  SELECT base.*, s, CASE WHEN s = 0 THEN -1 ELSE CAST(least(floor(((t - t0) - (t - t0) % s) / s + 0.5), greatest(1, ceil((t1 - t0) / s)) - 1) AS BIGINT) END AS w
  FROM base CROSS JOIN sc),
lagged AS (
  SELECT *, lag(t) OVER o AS pt, lag(direction) OVER o AS pd,
    last_value(CASE WHEN direction <> 'unknown' THEN direction END IGNORE NULLS) OVER (PARTITION BY {G} ORDER BY t, packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kd
  FROM bin WINDOW o AS (PARTITION BY {G} ORDER BY t, packet_index)),
seq0 AS (
  SELECT *, CASE WHEN pt IS NOT NULL THEN greatest(t - pt, 0) END AS iat, CASE WHEN direction <> 'unknown' AND kd IS NOT NULL AND kd <> direction THEN 1 ELSE 0 END AS switched,
    CASE WHEN pt IS NULL OR pd <> direction OR greatest(t - pt, 0) > {BURST_GAP} THEN 1 ELSE 0 END AS nb FROM lagged),
seq AS (
  SELECT *, sum(nb) OVER (PARTITION BY {G} ORDER BY t, packet_index) AS bid,
    avg(frame_length) OVER g AS fm, stddev_pop(frame_length) OVER g AS fs, avg(iat) OVER g AS im, stddev_pop(iat) OVER g AS isd
  FROM seq0 WINDOW g AS (PARTITION BY {G})),
main AS (SELECT {G}, {", ".join(main)} FROM seq GROUP BY {G}),
bursts AS (SELECT {G}, bid, sum(frame_length) b_bytes, count(*) b_packets, max(t) - min(t) b_dur FROM seq GROUP BY {G}, bid),
bb AS (SELECT {G}, {", ".join(burst)} FROM bursts GROUP BY {G}),
tls AS (SELECT {G}, unnest(tls) v FROM seq),
tt AS (SELECT {G}, {", ".join(_four("tls_record_size", "v"))} FROM tls GROUP BY {G}),
{_entropy_cte("packet_size", "frame_length").replace("packet_size_lim", "packet_size_lim")},
{_entropy_cte("iat_sec", "iat")},
grid AS (
  SELECT experiment_id, client_id, s, t0, t1, unnest(CASE WHEN s = 0 THEN [-1] ELSE range(0, CAST(greatest(1, ceil((t1 - t0) / s)) AS BIGINT)) END) AS w
  FROM (SELECT DISTINCT experiment_id, client_id, t0, t1 FROM base) CROSS JOIN sc),
joined AS (
  SELECT * FROM grid LEFT JOIN main USING (experiment_id, client_id, s, w) LEFT JOIN bb USING (experiment_id, client_id, s, w)
  LEFT JOIN tt USING (experiment_id, client_id, s, w) LEFT JOIN packet_size_ent USING (experiment_id, client_id, s, w)
  LEFT JOIN iat_sec_ent USING (experiment_id, client_id, s, w)),
timed AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE w * s END AS a,
    CASE WHEN s = 0 THEN t1 - t0 WHEN w = greatest(1, ceil((t1 - t0) / s)) - 1 AND t1 - t0 > w * s THEN least(w * s + s, t1 - t0) ELSE w * s + s END AS z FROM joined),
dur AS (SELECT *, CASE WHEN s = 0 THEN span ELSE greatest(z - a, 0) END AS duration_sec FROM timed)
SELECT experiment_id, client_id, CASE WHEN s = 0 THEN 'overall' ELSE 'window' END AS row_type, w AS window_index,
  {r6("a")} AS window_start_sec, {r6("z")} AS window_end_sec, s AS window_size_sec,
  2 AS packet_information_threshold, CASE WHEN coalesce(packet_count_total, 0) >= 2 THEN 1 ELSE 0 END AS packet_information_ok,
  {", ".join(columns)}
FROM dur"""


def _features(spark, sf_dir, scales):
    return FE.feature_rows(
        parsed_packets(spark, sf_dir), scales=scales, burst_gap_sec=BURST_GAP, idle_threshold_sec=IDLE
    )


@query(features_sql([]))
def trace_overall(spark, sf_dir):
    return rounded(_features(spark, sf_dir, []))


@query(features_sql(SCALES))
def trace_windows(spark, sf_dir):
    return rounded(_features(spark, sf_dir, SCALES))


SEQ_SQL = f"""
WITH {PACKETS_SQL},
lagged AS (
  SELECT *, timestamp_epoch AS t, lag(timestamp_epoch) OVER o AS pt, lag(direction) OVER o AS pd,
   row_number() OVER o - 1 AS position, count(*) OVER (PARTITION BY experiment_id, client_id) AS n,
   min(timestamp_epoch) OVER (PARTITION BY experiment_id, client_id) AS t0
  FROM pp WINDOW o AS (PARTITION BY experiment_id, client_id ORDER BY timestamp_epoch, packet_index)),
seq AS (SELECT *, CASE WHEN pt IS NOT NULL THEN greatest(t - pt, 0) END AS iat,
  CASE WHEN pt IS NULL OR pd <> direction OR greatest(t - pt, 0) > {BURST_GAP} THEN 1 ELSE 0 END AS nb FROM lagged)
"""


def _trace(spark, sf_dir):
    return FE.sequence_packets(parsed_packets(spark, sf_dir), BURST_GAP)


@query(
    SEQ_SQL
    + f""", ids AS (SELECT *, sum(nb) OVER (PARTITION BY experiment_id, client_id ORDER BY t, packet_index) AS burst_id FROM seq),
b AS (SELECT experiment_id, client_id, burst_id, any_value(direction) AS direction, min(t) AS s, max(t) AS e, count(*) AS packet_count,
  sum(frame_length)::BIGINT AS byte_count, any_value(t0) AS t0 FROM ids GROUP BY 1, 2, 3)
SELECT experiment_id, client_id, burst_id::BIGINT AS burst_id, direction, {r6("s - t0")} AS start_sec, {r6("e - t0")} AS end_sec, packet_count, byte_count,
  {r6("CASE WHEN burst_id > 1 THEN greatest(s - lag(e) OVER (PARTITION BY experiment_id, client_id ORDER BY burst_id), 0) END")} AS interval_sec FROM b"""
)
def trace_bursts(spark, sf_dir):
    """Bursts of each trace; the gap to the previous burst is its first packet's gap."""
    df = _trace(spark, sf_dir).rows()
    t = F.col("timestamp_epoch")
    return rounded(
        df.groupBy("experiment_id", "client_id", "burst_id").agg(
            F.first("direction").alias("direction"),
            F.min(t - F.col("trace_start")).alias("start_sec"),
            F.max(t - F.col("trace_start")).alias("end_sec"),
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("frame_length").alias("byte_count"),
            F.max(F.when(F.col("starts_burst") == 1, FE.gap_before())).alias("interval_sec"),
        )
    )


@query(
    SEQ_SQL
    + f"""SELECT experiment_id, client_id, count(*) FILTER (WHERE iat > {IDLE}) AS idle_gap_count,
  {r6(f"coalesce(sum(iat) FILTER (WHERE iat > {IDLE}), 0)")} AS idle_time_total_sec,
  {r6(f"coalesce(avg(iat) FILTER (WHERE iat > {IDLE}), 0)")} AS idle_time_mean_sec,
  {r6(f"coalesce(max(iat) FILTER (WHERE iat > {IDLE}), 0)")} AS idle_time_max_sec,
  {r6("avg(iat)")} AS iat_mean, {r6("max(iat)")} AS iat_max FROM seq GROUP BY 1, 2"""
)
def trace_idle(spark, sf_dir):
    df = _trace(spark, sf_dir).rows()
    iat = FE.gap_before()
    idle = F.when(iat > IDLE, iat)
    return rounded(
        df.groupBy("experiment_id", "client_id").agg(
            F.count(idle).alias("idle_gap_count"),
            FE.zero(F.sum(idle)).alias("idle_time_total_sec"),
            FE.zero(F.avg(idle)).alias("idle_time_mean_sec"),
            FE.zero(F.max(idle)).alias("idle_time_max_sec"),
            F.avg(iat).alias("iat_mean"),
            F.max(iat).alias("iat_max"),
        )
    )


@query(
    f"""WITH {PACKETS_SQL}, known AS (SELECT experiment_id, client_id, direction, lag(direction) OVER (PARTITION BY experiment_id, client_id ORDER BY timestamp_epoch, packet_index) AS pd
FROM pp WHERE direction <> 'unknown')
SELECT experiment_id, client_id, count(*) AS known_packets, count(*) FILTER (WHERE pd <> direction) AS switch_count FROM known GROUP BY 1, 2"""
)
def trace_switches(spark, sf_dir):
    df = _trace(spark, sf_dir).rows().where("direction in ('up', 'down')")
    return df.groupBy("experiment_id", "client_id").agg(
        F.count(F.lit(1)).alias("known_packets"),
        F.count(F.when(F.col("prev_known.d") != F.col("direction"), 1)).alias("switch_count"),
    )


@query(
    f"""WITH {PACKETS_SQL},
v AS (SELECT source, n_chars AS x FROM documents),
lim AS (SELECT source, min(x)::DOUBLE lo, max(x)::DOUBLE hi, count(*) n FROM v GROUP BY 1),
b AS (SELECT source, n, least(floor((x - lo) / (hi - lo) * least(32, greatest(4, floor(sqrt(n))))), least(32, greatest(4, floor(sqrt(n)))) - 1) b, count(*) c
  FROM v JOIN lim USING (source) WHERE hi > lo GROUP BY ALL)
SELECT source, {r6("-sum((c / n) * log2(c / n))")} AS entropy FROM b GROUP BY 1"""
)
def value_entropy(spark, sf_dir):
    """Histogram entropy of text sizes per source, on the path that splits hot sources."""
    from traceweave.catalog.tables import table

    docs = table(spark, sf_dir, "documents").select("source", "n_chars")
    return rounded(FE.entropy_of(docs, ["source"], {"entropy": F.col("n_chars")}, skewed=True))


@query(
    f"""SELECT l_returnflag, {", ".join(f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS {n}" for n, p in QS.items())}
FROM lineitem GROUP BY 1"""
)
def value_quantiles(spark, sf_dir):
    """Exact quantiles of few, huge groups on the path that never holds a group in one task."""
    from traceweave.catalog.tables import table
    from traceweave.operators.ordered import exact_quantiles

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", list(QS.values()), list(QS)))


BLOCKS = (5, 10, 25, 50, 100, 250, 500)


def blocks_sql(budgets) -> str:
    dist = lambda prefix, v: [*_four(prefix, v), *_quantiles(prefix, v)]
    cols = {
        "elapsed_span_sec": "max(t) - min(t)",
        "upload_packet_fraction": "count(*) FILTER (WHERE direction = 'up') / count(*)",
        "download_packet_fraction": "count(*) FILTER (WHERE direction = 'down') / count(*)",
        "unknown_packet_fraction": "count(*) FILTER (WHERE direction = 'unknown') / count(*)",
        "upload_download_packet_ratio": "CASE WHEN count(*) FILTER (WHERE direction = 'down') = 0 THEN 0 ELSE count(*) FILTER (WHERE direction = 'up') / count(*) FILTER (WHERE direction = 'down') END",
        "direction_switch_rate": "CASE WHEN count(*) FILTER (WHERE direction <> 'unknown') < 2 THEN 0 ELSE sum(switched) / (count(*) FILTER (WHERE direction <> 'unknown') - 1) END",
        "packets_per_second": "CASE WHEN max(t) = min(t) THEN 0 ELSE count(*) / (max(t) - min(t)) END",
        "bytes_per_second": "CASE WHEN max(t) = min(t) THEN 0 ELSE sum(frame_length) / (max(t) - min(t)) END",
        "tcp_fraction": "count(*) FILTER (WHERE transport_protocol = 'TCP') / count(*)",
        "udp_fraction": "count(*) FILTER (WHERE transport_protocol = 'UDP') / count(*)",
        **{f"tcp_{f}_fraction": f"sum(tcp_{f}) / count(*)" for f in ("syn", "ack", "fin", "rst")},
        "retransmission_fraction": "sum(retransmission) / count(*)",
        "tls_records_per_packet": "sum(len(tls)) / count(*)",
    }
    stats = "mean std min max q25 median q75 p90 p95".split()
    outs = [f"{r6(n)} AS {n}" for n in cols] + [
        f"{r6(f'coalesce({p}_{s}, 0)')} AS {p}_{s}" for p in ("packet_size", "iat_sec", "tls_record_size") for s in stats
    ]
    g = "experiment_id, client_id, packet_budget, block_index"
    return f"""{SEQ_SQL},
bl AS (SELECT seq.*, packet_budget, position // packet_budget AS block_index FROM seq CROSS JOIN (SELECT unnest({list(budgets)}) AS packet_budget)
  WHERE position // packet_budget < n // packet_budget),
il AS (SELECT * REPLACE (CASE WHEN position % packet_budget = 0 THEN NULL ELSE iat END AS iat),
  CASE WHEN direction <> 'unknown' AND last_value(CASE WHEN direction <> 'unknown' THEN direction END IGNORE NULLS) OVER (PARTITION BY {g} ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> direction THEN 1 ELSE 0 END AS switched FROM bl),
main AS (SELECT {g}, {", ".join(f"{e} AS {n}" for n, e in cols.items())}, {", ".join(dist("packet_size", "frame_length") + dist("iat_sec", "iat"))} FROM il GROUP BY {g}),
tt AS (SELECT {g}, {", ".join(dist("tls_record_size", "v"))} FROM (SELECT {g}, unnest(tls) v FROM il) GROUP BY {g})
SELECT {g}, block_index * packet_budget AS packet_start_index, block_index * packet_budget + packet_budget - 1 AS packet_end_index, {", ".join(outs)}
FROM main LEFT JOIN tt USING ({g})"""


@query(blocks_sql([10]))
def packet_blocks_k10(spark, sf_dir):
    return rounded(FE.packet_blocks(parsed_packets(spark, sf_dir), [10]))


@query(blocks_sql(BLOCKS))
def packet_blocks_all(spark, sf_dir):
    return rounded(FE.packet_blocks(parsed_packets(spark, sf_dir), BLOCKS))


@query(
    SEQ_SQL
    + f"""SELECT experiment_id, client_id, 1 AS packet_budget, position AS block_index, position AS packet_start_index, position AS packet_end_index,
  frame_length::DOUBLE AS frame_length, (direction = 'up')::INT::DOUBLE AS direction_up, (direction = 'down')::INT::DOUBLE AS direction_down,
  (direction = 'unknown')::INT::DOUBLE AS direction_unknown, {r6("coalesce(iat, 0)")} AS iat_sec,
  (transport_protocol = 'TCP')::INT::DOUBLE AS transport_tcp, (transport_protocol = 'UDP')::INT::DOUBLE AS transport_udp,
  tcp_syn::DOUBLE AS tcp_syn, tcp_ack::DOUBLE AS tcp_ack, tcp_fin::DOUBLE AS tcp_fin, tcp_rst::DOUBLE AS tcp_rst, retransmission::DOUBLE AS retransmission,
  len(tls)::DOUBLE AS tls_record_count, coalesce(list_sum(tls), 0)::DOUBLE AS tls_record_size_sum,
  {r6("coalesce(list_avg(tls), 0)")} AS tls_record_size_mean, coalesce(list_max(tls), 0)::DOUBLE AS tls_record_size_max FROM seq"""
)
def packet_k1(spark, sf_dir):
    return rounded(FE.single_packet_rows(FE.number_packets(parsed_packets(spark, sf_dir))))


CAP = 20
SAMPLE_SQL = (
    SEQ_SQL
    + f""", st AS (SELECT *, ((position + 1) * {CAP} - 1) // n AS stratum FROM seq),
ch AS (SELECT *, (stratum * n) // {CAP} AS lo, ((stratum + 1) * n) // {CAP} AS hi,
  ('0x' || substr(md5('7|' || experiment_id || '|' || client_id || '|' || stratum), 1, 15))::BIGINT AS h FROM st),
picked AS (SELECT * FROM ch WHERE n <= {CAP} OR position = lo + h % (hi - lo))"""
)


@query(SAMPLE_SQL + " SELECT experiment_id, client_id, position, packet_index FROM picked")
def sample_positions(spark, sf_dir):
    units = FE.number_packets(parsed_packets(spark, sf_dir)).rows()
    picked = S.stratified_units(units, ["experiment_id", "client_id"], "position", "trace_packets", CAP, 7)
    return picked.select("experiment_id", "client_id", "position", "packet_index")


@query(
    SAMPLE_SQL
    + """, a AS (SELECT experiment_id, client_id, count(*) AS available FROM seq GROUP BY 1, 2),
s AS (SELECT experiment_id, client_id, count(*) AS selected FROM picked GROUP BY 1, 2)
SELECT experiment_id, client_id, available, coalesce(selected, 0) AS selected FROM a LEFT JOIN s USING (experiment_id, client_id)"""
)
def sampling_audit(spark, sf_dir):
    """Units before and after sampling; the size of a trace rides along with its rows."""
    units = FE.number_packets(parsed_packets(spark, sf_dir)).rows()
    picked = S.stratified_units(units, ["experiment_id", "client_id"], "position", "trace_packets", CAP, 7)
    return picked.groupBy("experiment_id", "client_id").agg(
        F.max("trace_packets").alias("available"), F.count(F.lit(1)).alias("selected")
    )


@query(
    f"""WITH {PACKETS_SQL} SELECT experiment_id, client_id, count(*) AS packet_count, count(*) FILTER (WHERE frame_length > 2048) AS oversized_frame_count,
 {r6("count(*) FILTER (WHERE frame_length > 2048) / count(*)")} AS oversized_frame_fraction, max(frame_length) AS max_frame_length_bytes,
 CASE WHEN max(frame_length) > 2048 THEN 1 ELSE 0 END AS possible_offload_coalescing, 2048 AS oversized_frame_threshold_bytes FROM pp GROUP BY 1, 2"""
)
def capture_quality(spark, sf_dir):
    from traceweave.operators.audit import capture_quality as quality

    return rounded(quality(parsed_packets(spark, sf_dir), ["experiment_id", "client_id"]))


@query(
    f"""WITH {PACKETS_SQL}, twice AS (SELECT * FROM pp UNION ALL SELECT * REPLACE (packet_index + 1000000000 AS packet_index, timestamp_epoch + 2e-7 AS timestamp_epoch) FROM pp WHERE direction = 'up'),
b AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id, floor(timestamp_epoch * 1e6 + 0.5), frame_length, src_ip, dst_ip, src_port, dst_port, transport_protocol, tcp_flags_hex ORDER BY timestamp_epoch, packet_index) AS rn FROM twice)
SELECT experiment_id, client_id, count(*) AS kept, sum(packet_index)::BIGINT AS index_sum FROM b WHERE rn = 1 GROUP BY 1, 2"""
)
def dedupe_packets(spark, sf_dir):
    """Packets of two captures, the second of which saw the uplink again a fraction of a microsecond later."""
    from traceweave.operators.isolate import dedupe_packets as dedupe

    first = parsed_packets(spark, sf_dir)
    second = first.where("direction = 'up'").withColumns(
        {"packet_index": F.col("packet_index") + 1000000000, "timestamp_epoch": F.col("timestamp_epoch") + 2e-7}
    )
    return dedupe(first.unionByName(second)).groupBy("experiment_id", "client_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("packet_index").alias("index_sum")
    )


@query(
    f"""WITH {PACKETS_SQL}, ends AS (SELECT DISTINCT experiment_id, transport_protocol || '|' || least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '|' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS connection FROM pp)
SELECT experiment_id, count(*) AS connection_count FROM ends GROUP BY 1"""
)
def connection_counts(spark, sf_dir):
    rows = parsed_packets(spark, sf_dir).select("experiment_id", X.connection_key().alias("conn"))
    return FE.connection_block(rows, ["experiment_id"])


@query(
    f"""WITH {PACKETS_SQL}, t AS (SELECT experiment_id, client_id, min(timestamp_epoch) AS t0, max(timestamp_epoch) AS t1 FROM pp GROUP BY 1, 2),
r AS (SELECT experiment_id, min(timestamp_epoch) AS c0 FROM pp GROUP BY 1)
SELECT experiment_id, client_id, {r6("t0 - c0")} AS trace_start_offset_sec, {r6("t1 - c0")} AS trace_end_offset_sec,
 {r6(f"t0 - c0 + {DAY}")} AS second_day_start_global_sec FROM t JOIN r USING (experiment_id)"""
)
def global_offsets(spark, sf_dir):
    from traceweave.operators.isolate import trace_offsets

    offsets = trace_offsets(parsed_packets(spark, sf_dir))
    return rounded(
        offsets.select(
            "experiment_id",
            "client_id",
            "trace_start_offset_sec",
            "trace_end_offset_sec",
            (F.col("trace_start_offset_sec") + DAY).alias("second_day_start_global_sec"),
        )
    )


@query(
    SEQ_SQL
    + f"SELECT experiment_id, packet_index, {r6('t - t0')} AS relative_time_sec, frame_length, direction, transport_protocol, tcp_flags_hex, tcp_syn, tcp_ack, tcp_fin, tcp_rst, retransmission, len(tls) AS tls_record_count, array_to_string(tls, ';') AS tls_record_lengths FROM seq"
)
def safe_projection(spark, sf_dir):
    """Identity-free packet rows with time relative to the trace."""
    from traceweave.operators.isolate import safe_rows

    return rounded(safe_rows(parsed_packets(spark, sf_dir)))


@query(
    f"""WITH {PACKETS_SQL}, c AS (SELECT *, experiment_id || '_' || (k % 3) AS chunk, row_number() OVER (PARTITION BY experiment_id, client_id, k % 3 ORDER BY timestamp_epoch, packet_index) AS rn FROM pp)
SELECT experiment_id, client_id, packet_index, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY k % 3, user_id % 3, rn) AS global_index FROM c"""
)
def chunk_packet_index(spark, sf_dir):
    from traceweave.operators.isolate import chunk_global_index

    df = parsed_packets(spark, sf_dir).withColumns(
        {
            "chunk_number": (F.col("k") % 3).cast("long"),
            "connection_number": (F.regexp_extract("client_id", r"(\d+)$", 1).cast("long") % 3),
        }
    )
    return chunk_global_index(df, ["experiment_id", "client_id"]).select(
        "experiment_id", "client_id", "packet_index", "global_index"
    )


@query(
    f"""WITH {PACKETS_SQL} SELECT experiment_id, 'stitched_' || string_agg(DISTINCT client_id, '_' ORDER BY client_id) AS stitched_alias, count(*) AS packet_count,
 {r6("max(timestamp_epoch) - min(timestamp_epoch)")} AS span_sec FROM pp GROUP BY 1 HAVING count(*) >= 20"""
)
def stitched_traces(spark, sf_dir):
    from traceweave.operators.isolate import stitched_summary

    return rounded(stitched_summary(parsed_packets(spark, sf_dir), ["experiment_id"], "client_id", 20))
