"""Evaluation queries over labels joined with documents, probabilities and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceweave.catalog import query, r6
from traceweave.catalog.scalars import PROBS_SQL, probabilities
from traceweave.catalog.tables import packets, table
from traceweave.functions.exprs import rounded
from traceweave.operators import fisher as FI
from traceweave.operators import metrics as M

SCORES_SQL = """WITH sc AS (SELECT doc_id, quality AS y_true, toxic AS y_true2, n_chars AS score, (n_chars > 1000)::INT AS y_pred, source AS grp, lang
FROM labels JOIN documents USING (doc_id))"""


def scores(spark, sf_dir):
    """labels with the document they judge: truth, score and a thresholded prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y_true"),
        F.col("toxic").alias("y_true2"),
        F.col("n_chars").alias("score"),
        (F.col("n_chars") > 1000).cast("int").alias("y_pred"),
        F.col("source").alias("grp"),
        "lang",
    )


@query(
    SCORES_SQL
    + f""", cl AS (SELECT DISTINCT lang, c FROM (SELECT lang, y_true AS c FROM sc UNION ALL SELECT lang, y_pred FROM sc)),
g AS (SELECT a.lang, a.c AS true_class, b.c AS pred_class FROM cl a JOIN cl b USING (lang)),
n AS (SELECT lang, y_true AS true_class, y_pred AS pred_class, count(*) AS n FROM sc GROUP BY ALL),
s AS (SELECT lang, true_class, sum(n) AS support FROM n GROUP BY ALL)
SELECT lang, true_class, pred_class, coalesce(n, 0) AS n, {r6("coalesce(n / support, 0)")} AS share FROM g LEFT JOIN n USING (lang, true_class, pred_class) LEFT JOIN s USING (lang, true_class)"""
)
def confusion(spark, sf_dir):
    return rounded(M.confusion_matrix(scores(spark, sf_dir), ["lang"], "y_true", "y_pred"))


PER_CLASS_SQL = (
    SCORES_SQL
    + """, n AS (SELECT lang, y_true AS t, y_pred AS p, count(*) AS n FROM sc GROUP BY ALL),
k AS (SELECT DISTINCT lang, c FROM (SELECT lang, t AS c FROM n UNION ALL SELECT lang, p FROM n)),
pc AS (SELECT k.lang, c, coalesce(sum(n) FILTER (WHERE t = c), 0) AS support, coalesce(sum(n) FILTER (WHERE p = c), 0) AS predicted, coalesce(sum(n) FILTER (WHERE t = c AND p = c), 0) AS tp, sum(n) AS total
 FROM k JOIN n ON k.lang = n.lang GROUP BY k.lang, c),
m AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
 CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1,
 CASE WHEN total = support THEN 0 ELSE (total - support - (predicted - tp)) / (total - support) END AS specificity FROM pc)"""
)


@query(
    PER_CLASS_SQL
    + f" SELECT lang, c AS class, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp, total::BIGINT AS total, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('specificity')} AS specificity FROM m"
)
def per_class(spark, sf_dir):
    cells = M.confusion_cells(scores(spark, sf_dir), ["lang"], "y_true", "y_pred")
    return rounded(M.per_class(cells, ["lang"]))


SUMMARY = f"""{r6("sum(tp) / max(total)")} AS accuracy, {r6("avg(recall) FILTER (WHERE support > 0)")} AS balanced_accuracy, {r6("avg(precision)")} AS macro_precision, {r6("avg(recall)")} AS macro_recall,
 {r6("avg(f1)")} AS macro_f1, {r6("sum(tp) / max(total)")} AS micro_f1,
 {r6("CASE WHEN (max(total)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)) * (max(total)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2)) > 0 THEN (sum(tp) * max(total)::DOUBLE - sum(support::DOUBLE * predicted)) / sqrt((max(total)::DOUBLE ** 2 - sum(support::DOUBLE ** 2)) * (max(total)::DOUBLE ** 2 - sum(predicted::DOUBLE ** 2))) ELSE 0 END")} AS mcc,
 {r6("CASE WHEN sum(support::DOUBLE * predicted) / max(total)::DOUBLE ** 2 < 1 THEN (sum(tp) / max(total) - sum(support::DOUBLE * predicted) / max(total)::DOUBLE ** 2) / (1 - sum(support::DOUBLE * predicted) / max(total)::DOUBLE ** 2) ELSE 0 END")} AS kappa, max(total)::BIGINT AS evaluated_samples"""


@query(PER_CLASS_SQL + f" SELECT lang, {SUMMARY} FROM m GROUP BY lang")
def class_metrics(spark, sf_dir):
    return rounded(M.classification(scores(spark, sf_dir), ["lang"], "y_true", "y_pred"))


@query(PER_CLASS_SQL.replace("lang", "one").replace("source AS grp, one", "source AS grp, 1 AS one") + f" SELECT {SUMMARY} FROM m GROUP BY one")
def macro_metrics(spark, sf_dir):
    """One record for the whole table, over the labels seen in it."""
    return rounded(M.classification(scores(spark, sf_dir), [], "y_true", "y_pred"))


@query(
    PROBS_SQL
    + f""", l AS (SELECT experiment_id, CASE k % 3 WHEN 0 THEN p[1] WHEN 1 THEN p[2] ELSE p[3] END AS pt FROM prob)
SELECT experiment_id, {r6("avg(-ln(least(greatest(pt, 1e-15), 1)))")} AS log_loss FROM l GROUP BY 1"""
)
def log_loss(spark, sf_dir):
    df = probabilities(spark, sf_dir)
    p_true = F.get("p", (F.col("k") % 3).cast("int"))
    return rounded(M.log_loss(df, ["experiment_id"], p_true))


@query(
    SCORES_SQL
    + f""", e AS (SELECT lang, grp, avg((y_true = y_pred)::INT) AS a FROM sc GROUP BY 1, 2)
SELECT lang, {r6("avg(a)")} AS experiment_accuracy, count(*) AS experiments FROM e GROUP BY 1"""
)
def experiment_accuracy(spark, sf_dir):
    return rounded(M.experiment_accuracy(scores(spark, sf_dir), ["lang"], "grp", "y_true", "y_pred"))


@query(
    SCORES_SQL
    + f", r AS (SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS ar FROM sc) SELECT doc_id, {r6('ar')} AS average_rank FROM r"
)
def average_ranks(spark, sf_dir):
    df = scores(spark, sf_dir).select("doc_id", "lang", "score")
    return rounded(M.average_ranks(df, ["lang"], "score").select("doc_id", "average_rank"))


@query(
    SCORES_SQL
    + f""", r AS (SELECT lang, y_true, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS ar FROM sc),
s AS (SELECT lang, sum(ar) FILTER (WHERE y_true = 1) AS rs, count(*) FILTER (WHERE y_true = 1)::DOUBLE AS p, count(*) FILTER (WHERE y_true = 0)::DOUBLE AS q FROM r GROUP BY 1),
d AS (SELECT lang, score, sum(y_true) AS pos, count(*) AS n FROM sc GROUP BY 1, 2),
c AS (SELECT lang, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
a AS (SELECT lang, sum(pos * cp / cn) / sum(pos) AS ap FROM c GROUP BY 1)
SELECT lang, {r6("CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END")} AS auroc, {r6("ap")} AS average_precision FROM s JOIN a USING (lang)"""
)
def auroc_ap(spark, sf_dir):
    df = scores(spark, sf_dir)
    a = M.auroc(df, ["lang"], "y_true", "score")
    return rounded(a.join(M.average_precision(df, ["lang"], "y_true", "score"), "lang"))


CURVE_SQL = (
    SCORES_SQL
    + """, d AS (SELECT lang, score, sum(y_true) AS pos, count(*) AS n FROM sc GROUP BY 1, 2),
c AS (SELECT lang, score, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY lang) AS tp, sum(n) OVER (PARTITION BY lang) AS tn FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""
)


@query(
    CURVE_SQL
    + f" SELECT lang, score::DOUBLE AS score, {r6('CASE WHEN tp = 0 THEN 0 ELSE cp / tp END')} AS tpr, {r6('CASE WHEN tn = tp THEN 0 ELSE (cn - cp) / (tn - tp) END')} AS fpr, {r6('cp / cn')} AS precision FROM c"
)
def roc_pr_points(spark, sf_dir):
    return rounded(M.curve_points(scores(spark, sf_dir), ["lang"], "y_true", "score"))


@query(
    SCORES_SQL
    + f", k AS (SELECT doc_id, row_number() OVER w AS k, sum(y_true) OVER w AS tp FROM sc WINDOW w AS (PARTITION BY lang ORDER BY -score, doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, k, tp::BIGINT AS cumulative_tp, {r6('tp / k')} AS precision_at_k FROM k"
)
def precision_at_k(spark, sf_dir):
    df = M.precision_at_k(scores(spark, sf_dir), ["lang"], "y_true", "score", "doc_id")
    return rounded(df.select("doc_id", "k", "cumulative_tp", "precision_at_k"))


@query(
    SCORES_SQL
    + f", k AS (SELECT lang, y_true, row_number() OVER w AS k, sum(y_true) OVER w AS tp FROM sc WINDOW w AS (PARTITION BY lang ORDER BY -score, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, {r6('avg(tp / k) FILTER (WHERE y_true = 1)')} AS auprc FROM k GROUP BY 1"
)
def anomaly_auprc(spark, sf_dir):
    return rounded(M.stable_average_precision(scores(spark, sf_dir), ["lang"], "y_true", "score", "doc_id"))


@query(
    SCORES_SQL
    + f""", t AS (SELECT grp, quantile_cont(score::DOUBLE, 0.95) AS threshold FROM sc WHERE y_true2 = 0 GROUP BY 1),
c AS (SELECT grp, max(threshold) AS threshold, count(*) FILTER (WHERE y_true2 = 1 AND score > threshold) AS tp, count(*) FILTER (WHERE y_true2 = 0 AND score > threshold) AS fp,
 count(*) FILTER (WHERE y_true2 = 1 AND score <= threshold) AS fn, count(*) FILTER (WHERE y_true2 = 0 AND score <= threshold) AS tn,
 avg(score) FILTER (WHERE y_true2 = 0) AS ne, avg(score) FILTER (WHERE y_true2 = 1) AS ae FROM sc JOIN t USING (grp) GROUP BY 1)
SELECT grp, {r6("threshold")} AS threshold, tp, fp, fn, tn, {r6("ne")} AS normal_error_mean, {r6("ae")} AS anomaly_error_mean, {r6("(tp + tn) / (tp + tn + fp + fn)")} AS accuracy,
 {r6("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END")} AS precision, {r6("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END")} AS recall, {r6("CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END")} AS f1 FROM c"""
)
def anomaly_eval(spark, sf_dir):
    df = scores(spark, sf_dir)
    return rounded(M.anomaly_evaluation(df, df, ["grp"], "y_true2", "score"))


MULTI_SQL = (
    PROBS_SQL
    + f""", lg AS (SELECT c AS class, (k % 3 = i - 1)::INT AS y, p[i] AS s FROM prob CROSS JOIN (SELECT unnest(['a', 'b', 'c']) AS c, unnest([1, 2, 3]) AS i)),
bo AS (SELECT * FROM lg UNION ALL SELECT 'micro', y, s FROM lg),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS ar FROM bo),
au AS (SELECT class, (sum(ar) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auroc FROM r GROUP BY 1),
d AS (SELECT class, s, sum(y) AS pos, count(*) AS n FROM bo GROUP BY 1, 2),
c2 AS (SELECT class, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM d WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
ap AS (SELECT class, sum(pos * cp / cn) / sum(pos) AS average_precision FROM c2 GROUP BY 1),
e AS (SELECT * FROM au JOIN ap USING (class)), al AS (SELECT * FROM e UNION ALL SELECT 'macro', avg(auroc), avg(average_precision) FROM e WHERE class <> 'micro')
SELECT class, {r6("auroc")} AS auroc, {r6("average_precision")} AS average_precision FROM al"""
)


@query(MULTI_SQL)
def multiclass_auroc_ap(spark, sf_dir):
    """Whole-table ranking metrics; scores are rounded so that equal ones tie in any engine."""
    df = probabilities(spark, sf_dir).select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("k") % 3 + 1).cast("int")).alias("y"),
        *[F.col("p")[i].alias(f"p{i}") for i in range(3)],
    )
    return rounded(M.multiclass_scores(df, [], "y", ["p0", "p1", "p2"], ["a", "b", "c"]))


def _fused(spark, sf_dir, keys):
    df = probabilities(spark, sf_dir).select(
        "experiment_id",
        "client_id",
        F.concat(F.lit("f"), (F.regexp_extract("experiment_id", r"(\d+)", 1).cast("int") % 3).cast("string")).alias("y"),
        *[F.col("p")[i].alias(f"p{i}") for i in range(3)],
    )
    return rounded(M.late_fusion(df, keys, ["p0", "p1", "p2"], ["f0", "f1", "f2"], "y"))


def _fusion_sql(keys: str) -> str:
    return (
        PROBS_SQL
        + f""", f AS (SELECT {keys}, avg(p[1]) AS a, avg(p[2]) AS b, avg(p[3]) AS c, 'f' || (CAST(regexp_extract(any_value(experiment_id), '[0-9]+') AS INT) % 3) AS y_true, count(*) AS observations FROM prob GROUP BY ALL)
SELECT {keys}, {r6("a")} AS p0, {r6("b")} AS p1, {r6("c")} AS p2, y_true, observations, CASE WHEN a >= b AND a >= c THEN 'f0' WHEN b >= c THEN 'f1' ELSE 'f2' END AS y_pred FROM f"""
    )


@query(_fusion_sql("experiment_id, client_id"))
def late_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, ["experiment_id", "client_id"])


@query(_fusion_sql("experiment_id"))
def experiment_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, ["experiment_id"])


FISHER_SQL = """WITH lg AS (SELECT generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS x, label, W AS w FROM embeddings),
cs AS (SELECT feature, label, sum(w)::DOUBLE AS n, sum(w * x) / sum(w) AS m FROM lg GROUP BY 1, 2),
vs AS (SELECT feature, label, sum(w * (x - m) ** 2) / sum(w) AS v FROM lg JOIN cs USING (feature, label) GROUP BY 1, 2),
ov AS (SELECT feature, sum(n * m) / sum(n) AS o FROM cs GROUP BY 1),
fs AS (SELECT feature, sum(n * (m - o) ** 2) / greatest(sum(n * v), 1e-12) AS score FROM cs JOIN vs USING (feature, label) JOIN ov USING (feature) GROUP BY 1)"""


def vector_elements(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("feature", "x"), (F.lit(1) + F.col("vec_id") % 7).alias("w")
    )


@query(FISHER_SQL.replace("W AS w", "1 AS w") + f" SELECT feature, {r6('score')} AS score FROM fs")
def fisher_scores(spark, sf_dir):
    return rounded(FI.fisher_long(vector_elements(spark, sf_dir), "feature", "x", "label"))


@query(FISHER_SQL.replace("W AS w", "1 + vec_id % 7 AS w") + f" SELECT feature, {r6('score')} AS score FROM fs")
def weighted_fisher(spark, sf_dir):
    return rounded(FI.fisher_long(vector_elements(spark, sf_dir), "feature", "x", "label", F.col("w")))


LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line_fisher(weight: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, l_returnflag AS label, {weight} AS w FROM lineitem" for f in LINE_FEATURES)
    return f"WITH lg AS ({parts})," + FISHER_SQL.split("FROM embeddings),", 1)[1]


@query(_line_fisher("1") + f" SELECT feature, {r6('score * 1000000')} AS score_ppm FROM fs")
def fisher_columns(spark, sf_dir):
    df = FI.fisher_wide(table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_returnflag")
    return rounded(df.select("feature", (F.col("score") * 1e6).alias("score_ppm")))


@query(_line_fisher("l_linenumber") + f" SELECT feature, {r6('score * 1000000')} AS score_ppm FROM fs")
def weighted_fisher_columns(spark, sf_dir):
    df = FI.fisher_wide(table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_returnflag", "l_linenumber")
    return rounded(df.select("feature", (F.col("score") * 1e6).alias("score_ppm")))


@query(
    FISHER_SQL.replace("W AS w", "1 AS w")
    + f", rk AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM fs) SELECT feature, {r6('score')} AS score, rank FROM rk WHERE rank <= 10"
)
def top_features(spark, sf_dir):
    scored = FI.fisher_long(vector_elements(spark, sf_dir), "feature", "x", "label")
    return rounded(FI.top_features(scored.withColumn("stage", F.lit("all")), ["stage"], 10).drop("stage"))


WEIGHTS_SQL = """WITH v AS (SELECT event_id, 'run_' || (user_id % 12) AS e, 'client_' || user_id AS t, event_type AS s FROM events),
x AS (SELECT *, count(*) OVER (PARTITION BY e) AS ne, count(*) OVER (PARTITION BY e, t) AS nt, count(*) OVER (PARTITION BY e, s) AS ns FROM v),
d AS (SELECT e, count(DISTINCT t) AS dt, count(DISTINCT s) AS ds FROM v GROUP BY 1)"""


@query(
    WEIGHTS_SQL
    + f""" SELECT event_id, {r6("1000.0 / ne")} AS experiment_weight, {r6("1000.0 / ds / ns")} AS source_weight,
 {r6("(1.0 / dt / nt) / avg(1.0 / dt / nt) OVER ()")} AS trace_weight FROM x JOIN d USING (e)"""
)
def sample_weights(spark, sf_dir):
    """The three row-weight schemes side by side (the first two per thousand)."""
    df = packets(spark, sf_dir).select("packet_index", "experiment_id", "client_id")
    kinds = table(spark, sf_dir, "events").select(F.col("event_id").alias("packet_index"), "event_type")
    df = df.join(kinds, "packet_index")
    row = F.col("packet_index")
    df = FI.experiment_weights(df, "experiment_id", row).withColumnRenamed("weight", "experiment_weight")
    df = FI.source_weights(df, "experiment_id", "event_type", row).withColumnRenamed("weight", "source_weight")
    df = FI.trace_weights(df, "experiment_id", "client_id", row).withColumnRenamed("weight", "trace_weight")
    return rounded(
        df.select(
            F.col("packet_index").alias("event_id"),
            (F.col("experiment_weight") * 1000).alias("experiment_weight"),
            (F.col("source_weight") * 1000).alias("source_weight"),
            "trace_weight",
        )
    )


@query(
    """WITH RECURSIVE g AS (SELECT o_custkey % 97 AS customer_group, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ('0x' || substr(md5('42|' || customer_group), 1, 15))::BIGINT) AS k FROM g),
p AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS customer_group, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS held
 UNION ALL SELECT r.k, r.customer_group, (list_position(held, list_min(held)) - 1)::INTEGER, list_transform(held, lambda x, i: CASE WHEN i = list_position(held, list_min(held)) THEN x + r.n ELSE x END) FROM p JOIN r ON r.k = p.k + 1)
SELECT customer_group, fold FROM p WHERE k > 0"""
)
def group_folds(spark, sf_dir):
    """Groups of customers in five folds of nearly equal numbers of orders."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("customer_group"))
    return FI.group_folds(orders, "customer_group", 5)


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey % 97 AS g, o_orderstatus AS c FROM orders), cs AS (SELECT list(c ORDER BY c) AS cs FROM (SELECT DISTINCT c FROM o)),
t AS (SELECT list(n ORDER BY c) AS total FROM (SELECT c, count(*)::DOUBLE AS n FROM o GROUP BY 1)),
m AS (SELECT g, list_transform(cs, lambda x: len(list_filter(l, lambda y: y = x))::DOUBLE) AS n FROM (SELECT g, list(c) AS l FROM o GROUP BY 1), cs),
r AS (SELECT *, row_number() OVER (ORDER BY round(list_stddev_pop(n), 9) DESC, ('0x' || substr(md5('42|' || g), 1, 15))::BIGINT) AS k FROM m),
p AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS customer_group, NULL::INTEGER AS fold, list_transform(range(0, 5), lambda f: list_transform(cs, lambda x: 0.0::DOUBLE)) AS held FROM cs
 UNION ALL SELECT k, g, pick::INTEGER, list_transform(held, lambda h, i: CASE WHEN i = pick + 1 THEN list_transform(h, lambda x, j: x + n[j]) ELSE h END)
 FROM (SELECT r.k, r.g, r.n, held, list_sort(list_transform(range(0, 5), lambda f: struct_pack(
   s := round(list_avg(list_transform(range(1, len(n) + 1), lambda j: list_stddev_pop(list_transform(held, lambda h, i: (h[j] + CASE WHEN i = f + 1 THEN n[j] ELSE 0 END) / total[j])))), 9),
   w := list_sum(held[f + 1]), f := f)))[1].f AS pick FROM p JOIN r ON r.k = p.k + 1, t) step)
SELECT customer_group, fold FROM p WHERE k > 0"""
)
def stratified_group_folds(spark, sf_dir):
    """The same groups in five folds with like shares of every order status."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("customer_group"), "o_orderstatus")
    return FI.stratified_group_folds(orders, "o_orderstatus", "customer_group", 5)


@query(
    """WITH v AS (SELECT DISTINCT label, (vec_id % 20) * 100 + label AS e FROM embeddings),
h AS (SELECT *, ('0x' || substr(md5('42|' || e), 1, 15))::BIGINT AS h, ('0x' || substr(md5('42|' || label), 1, 15))::BIGINT AS o FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM h)
SELECT e AS experiment_id, label, ((rn - 1 + o) % 5)::INT AS fold FROM n"""
)
def folds(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        "label", ((F.col("vec_id") % 20) * 100 + F.col("label")).alias("experiment_id")
    )
    return FI.experiment_folds(df, "label", "experiment_id", 5)


@query(
    """WITH v AS (SELECT DISTINCT label, (vec_id % 20) * 100 + label AS e FROM embeddings), c AS (SELECT label, count(*) AS n FROM v GROUP BY 1)
SELECT 'all' AS scope, least(5, min(n))::INT AS folds FROM c"""
)
def fold_counts(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("scope"), "label", ((F.col("vec_id") % 20) * 100 + F.col("label")).alias("experiment_id")
    )
    return FI.fold_count(df, ["scope"], "label", "experiment_id")


LABELS_SQL = """lb AS (SELECT event_id, user_id % 12 AS e, 'family_' || (user_id % 12 % 3) AS family, 'architecture_' || (user_id % 12 % 6) AS architecture,
 'variant_' || (user_id % 12 % 6) AS variant, 'application_' || (user_id % 12 % 2) AS application FROM events)"""


def hierarchy_labels(df):
    """Labels that are constant per experiment, from its number."""
    e = F.regexp_extract("experiment_id", r"(\d+)$", 1).cast("int")
    levels = {"family": e % 3, "architecture": e % 6, "variant": e % 6, "application": e % 2}
    return df.withColumns({n: F.concat(F.lit(f"{n}_"), v.cast("string")) for n, v in levels.items()})


@query(
    f"""WITH {LABELS_SQL}, st AS (
SELECT 'family' AS level, 'all' AS parent, family AS target FROM lb UNION ALL SELECT 'architecture', family, architecture FROM lb
UNION ALL SELECT 'variant', family || '::' || architecture, variant FROM lb UNION ALL SELECT 'application', family || '::' || architecture || '::' || variant, application FROM lb)
SELECT level, parent, target, count(*) AS rows FROM st GROUP BY ALL"""
)
def stage_expand(spark, sf_dir):
    staged = FI.stage_rows(hierarchy_labels(packets(spark, sf_dir).select("experiment_id")))
    return staged.groupBy("level", "parent", "target").agg(F.count(F.lit(1)).alias("rows"))


@query(
    PROBS_SQL
    + """, t AS (SELECT packet_index, list_transform(p, lambda x, i: 0.3 * (CASE WHEN i = k % 3 + 1 THEN 1.0 ELSE 0.0 END) + 0.7 * x) AS q FROM prob),
s AS (SELECT packet_index, list_transform(q, lambda x: x / list_sum(q) * 20) AS z FROM t),
u AS (SELECT packet_index, generate_subscripts(z, 1) - 1 AS i, unnest(z) AS v FROM s),
r AS (SELECT packet_index, i, floor(v)::INT AS c, row_number() OVER (PARTITION BY packet_index ORDER BY floor(v) - v, i) AS rn, 20 - sum(floor(v)) OVER (PARTITION BY packet_index) AS left_over FROM u)
SELECT packet_index, 'f' || i AS pseudo_label, (c + (rn <= left_over)::INT)::INT AS copies FROM r WHERE c + (rn <= left_over)::INT > 0"""
)
def distill_expand(spark, sf_dir):
    df = probabilities(spark, sf_dir).select("packet_index", "p", (F.col("k") % 3).cast("int").alias("hard"))
    return FI.distill_rows(df, "p", "hard", ["f0", "f1", "f2"], 0.3).select("packet_index", "pseudo_label", "copies")


@query(
    """WITH g AS (SELECT l_returnflag AS stage, l_linenumber AS alpha, avg(l_discount) AS bal, avg(l_tax) AS f1 FROM lineitem GROUP BY 1, 2)
SELECT stage, arg_max(alpha, (bal, f1, alpha)) AS alpha FROM g GROUP BY 1"""
)
def best_params(spark, sf_dir):
    """Best setting per stage by balanced accuracy, then macro F1, then the setting."""
    from traceweave.operators.audit import best_setting

    grid = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("stage"), F.col("l_linenumber").alias("alpha")
    ).agg(F.avg("l_discount").alias("balanced_accuracy"), F.avg("l_tax").alias("macro_f1"))
    return best_setting(grid, ["stage"], ["balanced_accuracy", "macro_f1", "alpha"], ["alpha"])
