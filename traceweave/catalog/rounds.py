"""Round queries: bins, bursts, thresholds, pairing, truth and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.tables import DAY, HOUR, PACKETS_SQL, packets, parsed_packets, table
from traceweave.functions.exprs import rounded
from traceweave.operators import features as FE
from traceweave.operators import matching as M
from traceweave.operators import rounds as R
from traceweave.operators.features import TRACE
from traceweave.operators.joins import interval_join, overlapping_pairs
from traceweave.session import cut_lineage

BIN = 12 * HOUR
CFG = R.RoundConfig(
    bin_sec=BIN,
    min_bin_bytes=1000,
    bridge_gap_sec=BIN,
    min_major_transfer_bytes=1500,
    max_round_sec=10 * DAY,
    min_round_packets=3,
)

BINS_SQL = f"""WITH {PACKETS_SQL},
tb AS (SELECT *, min(timestamp_epoch) OVER w AS t0, max(timestamp_epoch) OVER w AS t1 FROM pp WINDOW w AS (PARTITION BY experiment_id, client_id)),
ib AS (SELECT *, least(floor((timestamp_epoch - t0 - (timestamp_epoch - t0) % {BIN}) / {BIN} + 0.5), floor((t1 - t0) / {BIN}))::BIGINT AS bin FROM tb),
bb AS (SELECT experiment_id, client_id, bin, coalesce(sum(frame_length) FILTER (WHERE direction = 'up'), 0)::BIGINT AS up_bytes, coalesce(sum(frame_length) FILTER (WHERE direction = 'down'), 0)::BIGINT AS down_bytes,
 coalesce(sum(frame_length) FILTER (WHERE direction = 'unknown'), 0)::BIGINT AS unknown_bytes, count(*) FILTER (WHERE direction = 'up') AS up_packets, count(*) FILTER (WHERE direction = 'down') AS down_packets, count(*) FILTER (WHERE direction = 'unknown') AS unknown_packets FROM ib GROUP BY ALL),
gr AS (SELECT DISTINCT experiment_id, client_id, t0, unnest(range(0, floor((t1 - t0) / {BIN})::BIGINT + 1)) AS bin FROM tb),
fb AS (SELECT experiment_id, client_id, t0, bin, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("up_bytes", "down_bytes", "unknown_bytes", "up_packets", "down_packets", "unknown_packets"))} FROM gr LEFT JOIN bb USING (experiment_id, client_id, bin)),
lb AS (SELECT *, CASE WHEN up_bytes + down_bytes < 1000 THEN 'quiet' WHEN down_bytes / greatest(up_bytes + down_bytes, 1) >= 0.65 THEN 'down' WHEN up_bytes / greatest(up_bytes + down_bytes, 1) >= 0.65 THEN 'up'
 WHEN greatest(up_bytes, down_bytes) / greatest(up_bytes + down_bytes, 1) >= 0.55 THEN CASE WHEN down_bytes > up_bytes THEN 'down' ELSE 'up' END ELSE 'mixed' END AS label FROM fb),
cb AS (SELECT *, CASE WHEN label = 'mixed' AND lag(label) OVER w = lead(label) OVER w AND lag(label) OVER w IN ('up', 'down') THEN lag(label) OVER w ELSE label END AS clean_label FROM lb WINDOW w AS (PARTITION BY experiment_id, client_id ORDER BY bin))"""


@query(
    BINS_SQL
    + " SELECT experiment_id, client_id, bin, up_bytes, down_bytes, unknown_bytes, up_packets, down_packets, unknown_packets, label, clean_label FROM cb"
)
def time_bins(spark, sf_dir):
    return R.dense_bins(parsed_packets(spark, sf_dir), CFG)


@query(BINS_SQL + " SELECT clean_label AS label, count(*) AS bins, count(*) FILTER (WHERE label <> clean_label) AS filled FROM cb WHERE up_packets + down_packets + unknown_packets > 0 GROUP BY 1")
def bin_smoothing(spark, sf_dir):
    bins = R.packet_bins(parsed_packets(spark, sf_dir), CFG)
    raw = bins.select(*TRACE, "bin", F.col("label").alias("raw_label"))
    return (
        R.smoothed(bins)
        .join(raw, [*TRACE, "bin"])
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("bins"), F.count(F.when(F.col("label") != F.col("raw_label"), 1)).alias("filled"))
    )


BURSTS_SQL = (
    BINS_SQL
    + f""", ac AS (SELECT * FROM cb WHERE clean_label IN ('up', 'down')),
nw AS (SELECT *, CASE WHEN lag(clean_label) OVER w = clean_label AND bin - lag(bin) OVER w - 1 <= 1 THEN 0 ELSE 1 END AS nb FROM ac WINDOW w AS (PARTITION BY experiment_id, client_id ORDER BY bin)),
sp AS (SELECT *, sum(nb) OVER (PARTITION BY experiment_id, client_id ORDER BY bin) AS span FROM nw),
se AS (SELECT experiment_id, client_id, span, any_value(clean_label) AS direction, any_value(t0) + min(bin) * {BIN} AS a, any_value(t0) + (max(bin) + 1) * {BIN} AS z FROM sp GROUP BY 1, 2, 3),
bu AS (SELECT s.experiment_id, s.client_id, span::BIGINT AS span, s.direction, min(timestamp_epoch) AS st, max(timestamp_epoch) AS en, coalesce(sum(frame_length) FILTER (WHERE p.direction = 'up'), 0)::BIGINT AS bytes_up,
 coalesce(sum(frame_length) FILTER (WHERE p.direction = 'down'), 0)::BIGINT AS bytes_down, count(*) AS packet_count, any_value(p.t0) AS t0
 FROM se s JOIN tb p ON p.experiment_id = s.experiment_id AND p.client_id = s.client_id AND p.timestamp_epoch BETWEEN a AND z GROUP BY ALL),
du AS (SELECT *, CASE WHEN direction = 'down' THEN bytes_down ELSE bytes_up END AS dominant_bytes FROM bu)"""
)


def _bursts(spark, sf_dir):
    return R.directional_bursts(R.packet_bins(parsed_packets(spark, sf_dir), CFG), CFG)


@query(
    BURSTS_SQL
    + f" SELECT experiment_id, client_id, span, direction, {r6('en - st')} AS duration_sec, bytes_up, bytes_down, packet_count, dominant_bytes, {r6('CASE WHEN bytes_up + bytes_down = 0 THEN 0 ELSE dominant_bytes / (bytes_up + bytes_down) END')} AS purity FROM du"
)
def directional_bursts(spark, sf_dir):
    df = _bursts(spark, sf_dir).withColumn("duration_sec", F.col("end_epoch") - F.col("start_epoch"))
    return rounded(
        df.select(*TRACE, "span", "direction", "duration_sec", "bytes_up", "bytes_down", "packet_count", "dominant_bytes", "purity")
    )


THRESHOLD_SQL = (
    BURSTS_SQL
    + f""", v AS (SELECT experiment_id, client_id, direction, dominant_bytes::DOUBLE AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY experiment_id, client_id, direction) AS n,
 lag(dominant_bytes::DOUBLE) OVER w AS lo FROM du WHERE dominant_bytes > 0 WINDOW w AS (PARTITION BY experiment_id, client_id, direction ORDER BY dominant_bytes, span)),
g AS (SELECT *, log10(greatest(v, 1)) - log10(CASE WHEN lo IS NOT NULL THEN greatest(lo, 1) END) AS gap FROM v),
s AS (SELECT experiment_id, client_id, direction, any_value(n) AS n, median(v) AS med, median(v) FILTER (WHERE i > n // 2) AS upper, max(gap) AS gap FROM g GROUP BY 1, 2, 3),
f AS (SELECT g.experiment_id, g.client_id, g.direction, min(i) AS i FROM g JOIN s USING (experiment_id, client_id, direction) WHERE g.gap = s.gap GROUP BY 1, 2, 3),
t AS (SELECT s.*, g.lo, g.v, s.n - g.i + 1 AS above FROM s LEFT JOIN f USING (experiment_id, client_id, direction) LEFT JOIN g ON g.experiment_id = s.experiment_id AND g.client_id = s.client_id AND g.direction = s.direction AND g.i = f.i),
th AS (SELECT experiment_id, client_id, direction, n, greatest(1500, CASE WHEN n < 4 THEN 0.5 * med WHEN gap >= 0.55 AND above >= greatest(3, ceil(n * 0.10)) THEN sqrt(lo * v) ELSE 0.25 * upper END) AS threshold FROM t)"""
)


@query(THRESHOLD_SQL + f" SELECT experiment_id, client_id, direction, n AS burst_count, {r6('threshold')} AS threshold_bytes FROM th")
def major_threshold(spark, sf_dir):
    return rounded(R.major_thresholds(cut_lineage(_bursts(spark, sf_dir)), CFG))


#: The waiting download as a recursion over the major bursts of a trace.
ROUNDS_SQL = THRESHOLD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", tz AS (SELECT experiment_id, client_id, count(*) AS packets FROM pp GROUP BY 1, 2),
mj AS (SELECT du.experiment_id, du.client_id, du.direction, st, en, dominant_bytes::DOUBLE AS b, CASE WHEN bytes_up + bytes_down = 0 THEN 0.0 ELSE dominant_bytes / (bytes_up + bytes_down) END AS pu, row_number() OVER (PARTITION BY du.experiment_id, du.client_id ORDER BY st, en) AS n
 FROM du JOIN th USING (experiment_id, client_id, direction) JOIN tz USING (experiment_id, client_id) WHERE dominant_bytes >= threshold AND packets >= 3),
wt AS (SELECT DISTINCT experiment_id, client_id, 0::BIGINT AS n, NULL::DOUBLE AS ws, NULL::DOUBLE AS we, NULL::DOUBLE AS wb, NULL::DOUBLE AS wp, false AS hit, NULL::DOUBLE AS ds, NULL::DOUBLE AS de, NULL::DOUBLE AS db, NULL::DOUBLE AS dp FROM mj
 UNION ALL SELECT experiment_id, client_id, n, CASE act WHEN 'take' THEN st WHEN 'keep' THEN ws END, CASE act WHEN 'take' THEN en WHEN 'keep' THEN we END, CASE act WHEN 'take' THEN b WHEN 'keep' THEN wb END, CASE act WHEN 'take' THEN pu WHEN 'keep' THEN wp END, act = 'pair', ws, we, wb, wp
 FROM (SELECT m.*, w.ws, w.we, w.wb, w.wp, CASE WHEN m.direction = 'down' THEN CASE WHEN w.wb IS NULL OR m.b >= w.wb THEN 'take' ELSE 'keep' END
  WHEN w.wb IS NULL OR m.st <= w.we THEN 'keep' WHEN m.en <= w.ws OR m.en - w.ws > 10 * {DAY} THEN 'drop' WHEN greatest(m.b, w.wb) > 8 * greatest(least(m.b, w.wb), 1) THEN 'keep' ELSE 'pair' END AS act
  FROM wt w JOIN mj m ON m.experiment_id = w.experiment_id AND m.client_id = w.client_id AND m.n = w.n + 1)),
pa AS (SELECT experiment_id, client_id, wt.n, ds, de, db, dp, st AS us, en AS ue, b AS ub, pu AS up, median(db) OVER w AS md, median(ub) OVER w AS mu FROM wt JOIN mj USING (experiment_id, client_id, n) WHERE hit WINDOW w AS (PARTITION BY experiment_id, client_id)),
rc AS (SELECT pa.*, count(*) AS packet_count FROM pa JOIN pp p ON p.experiment_id = pa.experiment_id AND p.client_id = pa.client_id AND p.timestamp_epoch BETWEEN ds AND ue GROUP BY ALL HAVING count(*) >= 3),
rd AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY ds, ue) - 1 AS inferred_round_index, least(greatest(0.20 * dp + 0.20 * up + 0.25 * exp(-abs(ln(greatest(ub, 1) / greatest(db, 1)))) + 0.10 * (exp(-abs(ln(greatest(db, 1) / greatest(md, 1)))) + exp(-abs(ln(greatest(ub, 1) / greatest(mu, 1)))))
  + 0.15 * CASE WHEN greatest(us - de, 0) >= 0.05 THEN 1.0 ELSE greatest(us - de, 0) / 0.05 END, 0), 1) AS confidence FROM rc)"""


@query(
    ROUNDS_SQL
    + f""" SELECT experiment_id, client_id, inferred_round_index, {r6("ds")} AS start_epoch, {r6("ue")} AS end_epoch, {r6("ds")} AS download_start_epoch, {r6("de")} AS download_end_epoch, {r6("us")} AS upload_start_epoch, {r6("ue")} AS upload_end_epoch,
 db::BIGINT AS download_bytes, ub::BIGINT AS upload_bytes, packet_count, {r6("confidence")} AS confidence FROM rd"""
)
def round_boundaries(spark, sf_dir):
    found, _ = R.infer_rounds(parsed_packets(spark, sf_dir), CFG)
    return rounded(found)


@query(
    ROUNDS_SQL
    + f""", c1 AS (SELECT experiment_id, client_id, count(*) AS burst_count FROM du JOIN tz USING (experiment_id, client_id) WHERE packets >= 3 GROUP BY 1, 2), c2 AS (SELECT experiment_id, client_id, count(*) AS major_burst_count FROM mj GROUP BY 1, 2),
c3 AS (SELECT experiment_id, client_id, max(threshold) FILTER (direction = 'down') AS dt, max(threshold) FILTER (direction = 'up') AS ut FROM th GROUP BY 1, 2), c4 AS (SELECT experiment_id, client_id, count(*) AS pairs, any_value(md) AS md, any_value(mu) AS mu FROM pa GROUP BY 1, 2),
c5 AS (SELECT experiment_id, client_id, count(*) AS found, avg(confidence) AS mean FROM rd GROUP BY 1, 2)
SELECT experiment_id, client_id, packets AS packet_count, coalesce(burst_count, 0) AS burst_count, coalesce(major_burst_count, 0) AS major_burst_count, {r6("coalesce(dt, 1500)")} AS down_threshold_bytes, {r6("coalesce(ut, 1500)")} AS up_threshold_bytes,
 {r6("md")} AS median_download_bytes, {r6("mu")} AS median_upload_bytes, coalesce(found, 0) AS inferred_round_count, {r6("coalesce(mean, 0)")} AS mean_confidence,
 CASE WHEN packets < 3 THEN 'insufficient_packets' WHEN coalesce(pairs, 0) = 0 THEN 'no_round_pairs' WHEN coalesce(found, 0) = 0 THEN 'no_usable_rounds' ELSE 'ok' END AS status
FROM tz LEFT JOIN c1 USING (experiment_id, client_id) LEFT JOIN c2 USING (experiment_id, client_id) LEFT JOIN c3 USING (experiment_id, client_id) LEFT JOIN c4 USING (experiment_id, client_id) LEFT JOIN c5 USING (experiment_id, client_id)"""
)
def round_diagnostics(spark, sf_dir):
    _, report = R.infer_rounds(parsed_packets(spark, sf_dir), CFG)
    return rounded(report)


@query(
    ROUNDS_SQL
    + f""", ip AS (SELECT p.*, inferred_round_index, ds, ue, p.timestamp_epoch - lag(p.timestamp_epoch) OVER w AS iat FROM rd JOIN pp p ON p.experiment_id = rd.experiment_id AND p.client_id = rd.client_id AND p.timestamp_epoch BETWEEN ds AND ue
 WINDOW w AS (PARTITION BY p.experiment_id, p.client_id, inferred_round_index ORDER BY p.timestamp_epoch, p.packet_index))
SELECT experiment_id, client_id, inferred_round_index AS window_index, 'round' AS row_type, 'family_' || (any_value(user_id) % 12 % 3) AS family, count(*) AS packet_count_total, count(*) FILTER (direction = 'up') AS packet_count_up, count(*) FILTER (direction = 'down') AS packet_count_down,
 sum(frame_length)::DOUBLE AS bytes_total, coalesce(sum(frame_length) FILTER (direction = 'up'), 0)::DOUBLE AS bytes_up, coalesce(sum(frame_length) FILTER (direction = 'down'), 0)::DOUBLE AS bytes_down, {r6("avg(frame_length)")} AS packet_size_mean, {r6("quantile_cont(frame_length::DOUBLE, 0.5)")} AS packet_size_median,
 {r6("coalesce(avg(iat), 0)")} AS iat_sec_mean, {r6("coalesce(max(iat), 0)")} AS iat_sec_max, sum(tcp_syn)::DOUBLE AS tcp_syn_count, sum(retransmission)::DOUBLE AS tcp_retransmission_count FROM ip GROUP BY 1, 2, 3"""
)
def round_rows(spark, sf_dir):
    """The labelled feature rows of inferred rounds, main columns (round_dataset has them all)."""
    from traceweave.catalog.evaluation import hierarchy_labels
    from traceweave.plans.jobs import round_dataset as build

    p = parsed_packets(spark, sf_dir)
    labels = hierarchy_labels(p.select("experiment_id", "client_id").distinct())
    made = build(p, labels, ["family"], CFG, burst_gap_sec=6 * HOUR, idle_threshold_sec=DAY)
    whole = ["packet_count_total", "packet_count_up", "packet_count_down"]
    rest = "bytes_total bytes_up bytes_down packet_size_mean packet_size_median iat_sec_mean iat_sec_max tcp_syn_count tcp_retransmission_count".split()
    x = made["x"].select("row_id", *TRACE, "window_index", "row_type", *[F.col(c).cast("long").alias(c) for c in whole], *rest)
    return rounded(x.join(made["y"].select("row_id", "family"), "row_id").drop("row_id"))


SEG_SQL = f"""WITH {PACKETS_SQL}, w AS (SELECT experiment_id, client_id, min(timestamp_epoch) AS t0, max(timestamp_epoch) AS t1 FROM pp GROUP BY 1, 2),
ix AS (SELECT *, unnest(range(0, floor((t1 - t0) / (5 * {DAY}))::BIGINT + 1)) AS i FROM w),
sg AS (SELECT experiment_id, client_id, t0, i AS segment_index, t0 + i * 5 * {DAY} AS a, t0 + i * 5 * {DAY} + 5 * {DAY} AS z FROM ix)"""
#: The same starts as three-day intervals, for matching.
MATCH_SQL = SEG_SQL.replace(f"+ 5 * {DAY} AS z", f"+ 3 * {DAY} AS z")


def segments(spark, sf_dir, days=5):
    """Segments that start every five days from a trace's first packet to its last; of five days they leave no pause."""
    bounds = R.trace_bounds(packets(spark, sf_dir))
    start = F.col("trace_start") + F.col("segment_index") * F.lit(5 * DAY)
    return bounds.select(
        *TRACE,
        "trace_start",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("trace_end") - F.col("trace_start")) / F.lit(5 * DAY)))
        ).alias("segment_index"),
    ).select(*TRACE, "segment_index", start.alias("start_epoch"), (start + F.lit(days * DAY)).alias("end_epoch"))


@query(
    SEG_SQL
    + f""" SELECT p.experiment_id, p.client_id, segment_index, count(*) AS packet_count, sum(frame_length)::BIGINT AS bytes_total, {r6("max(timestamp_epoch) - min(timestamp_epoch)")} AS span_sec
FROM sg JOIN pp p ON p.experiment_id = sg.experiment_id AND p.client_id = sg.client_id AND p.timestamp_epoch BETWEEN a AND z GROUP BY 1, 2, 3"""
)
def range_join_segments(spark, sf_dir):
    p = packets(spark, sf_dir).select(*TRACE, "timestamp_epoch", "frame_length")
    inside = interval_join(p, segments(spark, sf_dir), TRACE, "timestamp_epoch", "start_epoch", "end_epoch")
    t = F.col("timestamp_epoch")
    return rounded(
        inside.groupBy(*TRACE, "segment_index").agg(
            F.count(F.lit(1)).alias("packet_count"),
            F.sum("frame_length").alias("bytes_total"),
            (F.max(t) - F.min(t)).alias("span_sec"),
        )
    )


@query(
    SEG_SQL
    + f""", ip AS (SELECT p.*, segment_index, a FROM sg JOIN pp p ON p.experiment_id = sg.experiment_id AND p.client_id = sg.client_id AND p.timestamp_epoch BETWEEN a AND z),
lg AS (SELECT *, timestamp_epoch - lag(timestamp_epoch) OVER w AS iat FROM ip WINDOW w AS (PARTITION BY experiment_id, client_id, segment_index ORDER BY timestamp_epoch, packet_index))
SELECT experiment_id, client_id, segment_index AS window_index, 'round' AS row_type, count(*) AS packet_count_total, sum(frame_length)::BIGINT AS bytes_total, {r6("coalesce(avg(iat), 0)")} AS iat_sec_mean, {r6("coalesce(quantile_cont(iat, 0.9), 0)")} AS iat_sec_p90,
 {r6("quantile_cont(frame_length::DOUBLE, 0.5)")} AS packet_size_median, {r6("max(timestamp_epoch) - min(timestamp_epoch)")} AS duration_sec FROM lg GROUP BY 1, 2, 3"""
)
def segment_features(spark, sf_dir):
    """Feature rows of the packets inside given intervals (rounds)."""
    table_ = FE.segment_features(parsed_packets(spark, sf_dir), segments(spark, sf_dir), "round", 6 * HOUR, DAY)
    return rounded(
        table_.select(
            *TRACE,
            "window_index",
            "row_type",
            "packet_count_total",
            "bytes_total",
            "iat_sec_mean",
            "iat_sec_p90",
            "packet_size_median",
            "duration_sec",
        )
    )


@query(
    MATCH_SQL
    + f""", b AS (SELECT experiment_id, client_id, segment_index, a + {DAY} AS a, z + {DAY} * (1 + segment_index % 2) AS z FROM sg WHERE segment_index <> 3),
pr AS (SELECT x.experiment_id, x.client_id, x.segment_index AS left_index, y.segment_index AS right_index, greatest(0, least(x.z, y.z) - greatest(x.a, y.a)) / (greatest(x.z, y.z) - least(x.a, y.a)) AS iou, abs(x.a - y.a) AS se, abs(x.z - y.z) AS ee
 FROM sg x JOIN b y USING (experiment_id, client_id))
SELECT experiment_id, client_id, left_index, right_index, {r6("iou")} AS iou, {r6("se")} AS start_error_sec, {r6("ee")} AS end_error_sec FROM pr WHERE iou > 0"""
)
def interval_iou(spark, sf_dir):
    """Overlapping pairs of inferred and (shifted, thinned) truth intervals."""
    left, right = _interval_sides(spark, sf_dir)
    return rounded(overlapping_pairs(left, right, list(TRACE)))


def _interval_sides(spark, sf_dir):
    left = segments(spark, sf_dir, days=3).withColumnRenamed("segment_index", "index")
    right = left.where("index <> 3").withColumns(
        {
            "start_epoch": F.col("start_epoch") + DAY,
            "end_epoch": F.col("end_epoch") + F.lit(DAY) * (1 + F.col("index") % 2),
        }
    )
    return left, right


#: Segments of three days against the packets' own four-day stretches; the matching is a recursion over ranked pairs.
GREEDY_SQL = MATCH_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", rt AS (SELECT experiment_id, client_id, floor(timestamp_epoch / (4 * {DAY}))::BIGINT AS j, min(timestamp_epoch) AS a, max(timestamp_epoch) AS z FROM pp GROUP BY ALL HAVING max(timestamp_epoch) > min(timestamp_epoch)),
pr AS (SELECT x.experiment_id, x.client_id, x.segment_index AS i, j, (least(x.z, y.z) - greatest(x.a, y.a)) / (greatest(x.z, y.z) - least(x.a, y.a)) AS iou, abs(x.a - y.a) AS se, abs(x.z - y.z) AS ee
 FROM sg x JOIN rt y USING (experiment_id, client_id) WHERE least(x.z, y.z) > greatest(x.a, y.a)),
rk AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY iou DESC, se, i, j) AS r FROM pr WHERE iou >= 0.25),
gm AS (SELECT DISTINCT experiment_id, client_id, 0::BIGINT AS r, []::BIGINT[] AS ui, []::BIGINT[] AS uj, false AS ok FROM rk
 UNION ALL SELECT experiment_id, client_id, kr, CASE WHEN free THEN list_append(ui, i) ELSE ui END, CASE WHEN free THEN list_append(uj, j) ELSE uj END, free
 FROM (SELECT g.*, k.i, k.j, k.r AS kr, NOT list_contains(ui, k.i) AND NOT list_contains(uj, k.j) AS free FROM gm g JOIN rk k ON k.experiment_id = g.experiment_id AND k.client_id = g.client_id AND k.r = g.r + 1) step),
mt AS (SELECT rk.* FROM rk JOIN gm USING (experiment_id, client_id, r) WHERE ok)"""


def _matching_sides(spark, sf_dir):
    left = segments(spark, sf_dir, days=3).withColumnRenamed("segment_index", "index")
    t = F.col("timestamp_epoch")
    right = packets(spark, sf_dir).groupBy(*TRACE, F.floor(t / (4 * DAY)).alias("index"))
    right = right.agg(F.min(t).alias("start_epoch"), F.max(t).alias("end_epoch")).where("end_epoch > start_epoch")
    return left, right


@query(
    GREEDY_SQL
    + f" SELECT experiment_id, client_id, i AS left_index, j AS right_index, {r6('iou')} AS iou, {r6('se')} AS start_error_sec, {r6('ee')} AS end_error_sec FROM mt"
)
def greedy_matches(spark, sf_dir):
    return rounded(M.greedy_matches(*_matching_sides(spark, sf_dir), TRACE))


def _scores_sql() -> str:
    levels = [(f"_iou_{round(100 * v)}", f"iou >= {v}") for v in M.IOU_LEVELS]
    matched = ", ".join(f"count(*) FILTER ({cond}) AS matched_rounds{name}" for name, cond in [*levels, ("", "iou >= 0.5")])
    means = [("interval_iou_mean", "avg(iou)"), ("start_error_mean_sec", "avg(se)"), ("start_error_median_sec", "median(se)"), ("end_error_mean_sec", "avg(ee)")]
    means_sql = ", ".join(f"{f} FILTER (iou >= 0.5) AS {name}" for name, f in means)
    names = [f"matched_rounds{name}" for name, _ in [*levels, ("", "")]]
    rates = ", ".join(
        f"{r6(f'coalesce({n}, 0) / {of}')} AS boundary_{rate}{n.removeprefix('matched_rounds')}"
        for n in names
        for rate, of in (("precision", "inferred_rounds"), ("recall", "truth_rounds"))
    )
    return f""", hs AS (SELECT experiment_id, client_id, {matched}, {means_sql} FROM mt GROUP BY 1, 2),
nt AS (SELECT experiment_id, client_id, count(*) AS truth_rounds FROM rt GROUP BY 1, 2), ni AS (SELECT experiment_id, client_id, count(*) AS inferred_rounds FROM sg GROUP BY 1, 2)
SELECT experiment_id, client_id, truth_rounds, inferred_rounds, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)}, {", ".join(f"{r6(n)} AS {n}" for n, _ in means)}, {rates}, 'evaluated' AS status
FROM nt JOIN ni USING (experiment_id, client_id) LEFT JOIN hs USING (experiment_id, client_id)"""


@query(GREEDY_SQL + _scores_sql())
def boundary_scores(spark, sf_dir):
    """Scores of the greedy matches at all three levels."""
    left, right = _matching_sides(spark, sf_dir)
    return rounded(M.boundary_scores(M.greedy_matches(left, right, TRACE), left, right, TRACE))


#: All differences of starts, in buckets of six hours; every offset is scored by nearest starts first.
OFFSET_SQL = GREEDY_SQL + f""", st AS (SELECT experiment_id, client_id, min(a) AS base FROM (SELECT experiment_id, client_id, a FROM sg UNION ALL SELECT experiment_id, client_id, a FROM rt) GROUP BY 1, 2),
sa AS (SELECT experiment_id, client_id, a - base AS a, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY a) AS i FROM sg JOIN st USING (experiment_id, client_id)),
sb AS (SELECT experiment_id, client_id, a - base AS a, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY a) AS j FROM rt JOIN st USING (experiment_id, client_id)),
df AS (SELECT x.experiment_id, x.client_id, i, j, x.a AS xa, y.a AS ya, x.a - y.a AS d, round_even((x.a - y.a) / {6 * HOUR}, 0) AS k FROM sa x JOIN sb y USING (experiment_id, client_id)),
bk AS (SELECT experiment_id, client_id, k, count(*) AS n, min(i * 1000000 + j) AS f, median(d) AS o FROM df GROUP BY 1, 2, 3),
bt AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY n DESC, f) AS ck FROM bk QUALIFY ck <= 64),
cf AS (SELECT experiment_id, client_id, ck, o FROM bt UNION ALL SELECT DISTINCT experiment_id, client_id, 65, 0.0::DOUBLE FROM bk UNION ALL SELECT experiment_id, client_id, 66, median(d) FROM df WHERE i = j AND i <= 20 GROUP BY 1, 2),
ce AS (SELECT df.experiment_id, df.client_id, ck, i, j, abs((xa - o) - ya) AS e FROM cf JOIN df USING (experiment_id, client_id) WHERE abs((xa - o) - ya) <= {6 * HOUR}),
cr AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, client_id, ck ORDER BY e, i, j) AS r FROM ce),
og AS (SELECT DISTINCT experiment_id, client_id, ck, 0::BIGINT AS r, []::BIGINT[] AS ui, []::BIGINT[] AS uj, [0.0::DOUBLE] AS es FROM cr
 UNION ALL SELECT g.experiment_id, g.client_id, g.ck, k.r, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN ui ELSE list_append(ui, i) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN uj ELSE list_append(uj, j) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN es ELSE list_append(es, e) END
 FROM og g JOIN cr k ON k.experiment_id = g.experiment_id AND k.client_id = g.client_id AND k.ck = g.ck AND k.r = g.r + 1),
ol AS (SELECT experiment_id, client_id, ck, es[2:] AS es FROM og QUALIFY row_number() OVER (PARTITION BY experiment_id, client_id, ck ORDER BY r DESC) = 1),
ob AS (SELECT experiment_id, client_id, o, coalesce(len(es), 0) AS n, list_median(es) AS me, list_avg(es) AS mn FROM cf LEFT JOIN ol USING (experiment_id, client_id, ck)
 QUALIFY row_number() OVER (PARTITION BY experiment_id, client_id ORDER BY coalesce(len(es), 0) DESC, round(list_median(es), 6) NULLS LAST, round(list_avg(es), 6) NULLS LAST, ck) = 1)
SELECT experiment_id, client_id, {r6("CASE WHEN n > 0 THEN o ELSE 0.0 END")} AS clock_offset_sec, n AS clock_alignment_support, {r6("me")} AS clock_alignment_start_error_median_sec, {r6("mn")} AS clock_alignment_start_error_mean_sec FROM ob"""


@query(OFFSET_SQL)
def clock_offset(spark, sf_dir):
    """The start difference that most segments and packet stretches of a trace agree on, in buckets of six hours."""
    left, right = _matching_sides(spark, sf_dir)
    return rounded(M.clock_offsets(left, right, TRACE, bin_sec=6 * HOUR, tolerance_sec=6 * HOUR))


PHASE_SQL = """WITH ev AS (SELECT conv_id % 12 AS run, conv_id AS client, turn // 4 AS round, turn AS seq, CASE role WHEN 'user' THEN 'download' WHEN 'system' THEN 'training' ELSE 'upload' END AS phase,
 (conv_id * 1000 + turn * 10)::DOUBLE AS e, (conv_id * 1000 + turn * 10) - length(text) / 1000.0 AS s FROM conversations),
ph AS (SELECT run, client, round, phase, arg_max(s, seq) AS s, arg_max(e, seq) AS e FROM ev GROUP BY ALL)"""


@query(
    PHASE_SQL
    + f""", pv AS (SELECT run, client, round, min(s) AS s, max(e) AS e, {", ".join(f"max(s) FILTER (WHERE phase = '{p}') AS {p}_s, max(e) FILTER (WHERE phase = '{p}') AS {p}_e" for p in ("download", "training", "upload"))} FROM ph GROUP BY ALL)
SELECT run, client, round, {r6("s")} AS start_epoch, {r6("e")} AS end_epoch, {", ".join(f"{r6(f'{p}_{x}')} AS {p}_{n}_epoch" for p in ("download", "training", "upload") for x, n in (("s", "start"), ("e", "end")))} FROM pv WHERE e > s"""
)
def phase_rounds(spark, sf_dir):
    """conversations as phase events: four turns make a round, the last of a phase counts."""
    role = F.col("role")
    events = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 12).alias("run"),
        F.col("conv_id").alias("client"),
        F.floor(F.col("turn") / 4).alias("round"),
        F.col("turn").alias("seq"),
        F.lit("federated_phase").alias("event"),
        F.when(role == "user", "Download").when(role == "system", "training").otherwise("upload").alias("phase"),
        (F.col("conv_id") * 1000 + F.col("turn") * 10).cast("double").alias("timestamp_epoch"),
        F.length("text").cast("double").alias("phase_time_ms"),
        F.lit(None).cast("double").alias("round_start_epoch"),
        F.lit(None).cast("double").alias("round_end_epoch"),
    )
    return rounded(R.phase_rounds(events, ["run", "client"], "seq"))
