"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweave.llm import (
    byte_bpe,
    conversation_trie,
    decontamination,
    exact_dedup,
    html_text,
    knn,
    language_id,
    near_dedup,
    packing,
    periodic_runs,
    sharding,
    substring_dedup,
    token_counts,
)
from traceweave.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_factors(docs, substring_dedup.duplicate_factors(docs), show=())
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_per_shingle=2, percent=80)


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ranks)


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks)


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@query(
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op8_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards_of(table(spark, sf_dir, "documents"), 8)
    return rows.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


@query(
    """
    WITH v AS (
        SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """
)
def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    f"""
    WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
    patterns AS (
        SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS p, least(len(w), 10) AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
    windows AS (
        SELECT r, i, k, w[i : i + k - 1] AS p
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM patterns) WHERE len(w) >= k)
    ),
    found AS (SELECT r, item_id, i, k FROM windows JOIN patterns USING (p, k)),
    hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
    items AS (SELECT r, list(DISTINCT item_id::VARCHAR) AS items FROM found GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
        sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """
)
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def branched(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Placed turns of conversations that share their beginnings, group by group.

    Conversation c takes the first h = crc32(c) % most turns of c - c % group, then its own turns behind its first h.
    A conversation that is left without a turn has one row with pos -1.
    """
    turns = stored(turns, "trie-own")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    own = own.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % group})
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = stored(
        own.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-branches"
    )
    kept = turns.join(own.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "n_bytes")
    # At most most - 1 turns for at most group conversations meet on a base.
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base")
    heads = heads.join(own.select("conv_id", "base", "taken"), "base").where(F.col("pos") < F.col("taken"))
    none = own.where((F.col("taken") == 0) & (F.col("n") <= F.col("h")))
    none = none.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("n_bytes"))
    return kept.unionByName(heads.select("conv_id", "pos", "key", "n_bytes")).unionByName(none)


@query(
    """
    WITH t AS (
        SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    own AS (SELECT conv_id, list(turn ORDER BY i) AS turns FROM t GROUP BY conv_id),
    h AS (
        SELECT conv_id, turns, xor(4294967295, list_reduce(
            [4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
        FROM (SELECT *, conv_id::VARCHAR AS s FROM own)
    ),
    c AS (
        SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1 : h], h.turns[h + 1 :]) AS turns
        FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5
    ),
    members AS (SELECT conv_id, turns, d, turns[1 : d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
    nodes AS (
        SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = d), '') AS ends,
            CASE WHEN d = 0 THEN 0 ELSE strlen(node[d].t) END AS bytes
        FROM members GROUP BY node, d
    ),
    children AS (SELECT node[1 : depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
    below AS (
        SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(list_transform(range(0, depth + 1), lambda i: node[1 : i])) AS top FROM full_nodes) GROUP BY top
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens,
        sha256(n.ends) AS ends_sha256
    FROM full_nodes n JOIN below USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1 : n.depth - 1]
    """
)
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.placed(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(branched(turns))


def looping(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id) is divisible by 10, a text's end repeats a stretch of its own words.

    With g = h div 10 and n words, the words from a = g % n on become copies of the p = 1 + (n - a) div (3 + g % 8)
    words that begin there. Other texts are as given; so are null texts, and texts without an id.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), crc.alias("h"))
    cut = cut.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("h div 10 % n")).cast("int"))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)").cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    looped = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looping(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumns({"m": longest, "lines": F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("m.s")).alias("start"),
        F.col("m.l").alias("length"),
        (-F.col("m.p")).alias("period"),
        F.expr("1000 * m.l div -m.p").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
