import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from messy_rows import SF, docs, messy, none, odd  # noqa: F401  fixtures
from pyspark.sql import functions as F

from traceweave.llm import common, exact_dedup, knn, language_id, near_dedup, sharding
from traceweave.llm import queries as q


def rows(df):
    return [r.asDict() for r in df.collect()]


# Language id ----------------------------------------------------------------------------------------------------


def test_language_query_on_held_out_rows(spark):
    found = {r["doc_id"]: r for r in rows(q.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01"))}
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(truth)
    held = [r for r in truth if found[r["doc_id"]]["held_out"]]
    assert 0.25 < len(held) / len(truth) < 0.42
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert sum(r["accepted"] for r in found.values()) / len(found) > 0.99


def test_language_does_not_read_labels_to_predict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    blind = docs.select("doc_id", "text")
    seen = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.predict(docs, model))}
    assert seen == {r["doc_id"]: r["lang_pred"] for r in rows(language_id.predict(blind, model))}


def test_language_on_messy_rows(docs, odd, none):
    model = language_id.train(docs)
    for r in rows(language_id.predict(docs, model)):
        text = messy()[r["doc_id"] - 1][1]
        letters = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"], r["accepted"]) == (0, False)
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns
    assert all(any(c.isalpha() for c in r["text"]) for r in kept.collect())
    assert language_id.predict(odd, model).count() == 7
    assert {r["lang_pred"] for r in rows(language_id.predict(docs, language_id.train(none)))} == {"und"}
    assert language_id.predict(none, model).count() == 0


# Exact dedup ----------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, odd, none):
    groups = {}
    for r in messy():
        groups.setdefault(r[1] or "", []).append(r[0])
    found = rows(exact_dedup.exact_dedup(docs))
    assert len(found) == len(messy())
    for r in found:
        text = messy()[r["doc_id"] - 1][1] or ""
        own = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.exact_dedup(odd).count() == 7
    assert sorted(r["doc_id"] for r in rows(exact_dedup.deduplicated(odd))) == [7, 8, 9]


def test_digest_index_is_kept_between_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    first, second = docs.where("doc_id <= 20"), docs.where("doc_id > 10")
    kept = [r["doc_id"] for r in rows(exact_dedup.deduplicated(first, index))]
    held = {messy()[i - 1][1] or "" for i in range(1, 21)}
    again = exact_dedup.DigestIndex(spark, index.name)
    later = [messy()[r["doc_id"] - 1][1] or "" for r in rows(exact_dedup.deduplicated(second, again))]
    assert len(kept) == len(held)
    assert held.isdisjoint(later)
    assert again.rows().count() == len({r[1] or "" for r in messy()})
    plan = again.fresh(second)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    spark.sql(f"DROP TABLE {index.name}")


# Near duplicates ------------------------------------------------------------------------------------------------


def check_near(found, texts, k):
    want = brute.near_components(texts, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_query_equals_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_near(rows(q.QUERIES["op7_minhash_near_dedup"](spark, SF)), texts, 2)


@pytest.mark.parametrize("block", [1500, 4])
def test_near_on_messy_rows(docs, block):
    check_near(rows(near_dedup.near_duplicates(docs, 2, block=block)), [(r[0], r[1]) for r in messy()], 2)


def test_near_in_blocks_finds_chains(spark):
    # Neighbours of a chain are alike, its ends are not; a hub alone would not link them.
    r = random.Random(1)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(40):
        words = words[:]
        for _ in range(3):
            words[r.randrange(100)] = f"new{i}-{r.random()}"
        texts.append((100 - i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    check_near(rows(near_dedup.near_duplicates(docs, 2, block=5)), texts, 2)


def templated():
    """Small true groups that one template chains into a single cluster."""
    r = random.Random(3)
    template, texts = [f"t{i}" for i in range(120)], []
    for group in range(30):
        own = [f"g{group}w{i}" for i in range(50)]
        for copy in range(3):
            words = own[:]
            words[r.randrange(50)] = f"g{group}c{copy}"
            texts.append((len(texts) + 1, " ".join(template + words)))
    r.shuffle(texts)
    return texts


def test_near_groups_of_rows_are_bounded(spark, monkeypatch):
    texts, linked = templated(), near_dedup._linked

    def bounded(percent, k):
        run = linked(percent, k)

        def checked(key, group):
            assert group.num_rows <= 40, f"{group.num_rows} rows in one group"
            return run(key, group)

        return checked

    monkeypatch.setattr(near_dedup, "_linked", bounded)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = rows(near_dedup.near_duplicates(docs, 2, block=8))
    check_near(found, texts, 2)
    assert len({r["component_id"] for r in found}) == 30


def test_near_probes_go_where_a_rare_item_is_shared(spark):
    sets = [(i, near_dedup.shingle_sets(pa.array([t]), 2)[0].tobytes()) for i, t in templated()]
    marked = spark.createDataFrame(sets, "doc_id long, items binary").selectExpr(
        "1L as cluster", "doc_id", "items", "doc_id as label", "cast(doc_id % 11 as int) as block"
    )
    routed = {(r["doc_id"], r["block"]) for r in near_dedup._routed(marked, marked.select("cluster", "doc_id"), 80).collect()}
    group = lambda i: range((i - 1) // 3 * 3 + 1, (i - 1) // 3 * 3 + 4)
    assert routed == {(i, j % 11) for i, _ in sets for j in group(i)}


def test_linked_sets_share_a_prefix_item():
    r = np.random.default_rng(2)
    for counts in (np.zeros(near_dedup.RARITIES, np.int64), r.integers(0, 9, near_dedup.RARITIES)):
        for n in range(1, 60):
            base = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            for m in range(-(-80 * n // 100), n + 1):  # a subset at or above the threshold
                part = np.sort(r.permutation(base)[:m])
                assert len(np.intersect1d(near_dedup.prefix(base, counts, 80), near_dedup.prefix(part, counts, 80)))
    assert len(near_dedup.prefix(np.arange(10, dtype=np.uint64), counts, 80)) == 3


def test_near_odd_ids(odd, none):
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows(near_dedup.near_duplicates(odd)))
    assert found == [(0, 0, True)] * 2 + [(7, 7, True)] * 3 + [(8, 8, True), (9, 7, False)]
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [500_000, 4])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(common, "EDGE_BLOCK", block)
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (50, 41), (60, 60), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    found = {r["node"]: r["root"] for r in common.components(df, "a", "b").collect()}
    assert found == {i: 1 for i in range(1, 31)} | {40: 40, 41: 40, 50: 40, 60: 60}


def test_ranks_have_no_gaps(spark):
    df = spark.createDataFrame([(i % 2 if i % 5 else None, i // 4) for i in range(200)], "k long, v long")
    found = common.ranked(df, ["k"], [F.col("v")], "n", ways=4).collect()
    for k in (None, 0, 1):
        own = sorted(r["n"] for r in found if r["k"] == k)
        assert own == list(range(len(own)))


# Shards ---------------------------------------------------------------------------------------------------------


def test_shards(spark, docs, odd, none):
    for df in (docs, odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        found = rows(sharding.shards_of(df, 8))
        assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == sorted((i or 0, len(t.encode()) + 1) for i, t in texts)
        place = {}
        for r in found:
            assert place.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
        for shard in {r["shard"] for r in found}:
            own = sorted(r["slot"] for r in found if r["shard"] == shard)
            assert own == list(range(len(own)))
    assert sharding.shards_of(none).count() == 0


def test_shard_bytes_are_near_equal(spark):
    found = rows(q.QUERIES["op8_best_fit_shards"](spark, SF))
    loads = np.bincount([r["shard"] for r in found], [r["size"] for r in found], 8)
    assert loads.max() - loads.min() < 0.02 * loads.mean() + 50
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_shards_beside_a_group_of_a_third(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    text = "hot " * 100
    hot = spark.range(total // 2 // (len(text) + 1)).select((F.col("id") + 10**6).alias("doc_id"), F.lit(text).alias("text"))
    found = rows(sharding.shards_of(docs.union(hot), 8))
    (own,) = {r["shard"] for r in found if r["doc_id"] >= 10**6}
    assert {r["shard"] for r in found if r["doc_id"] < 10**6} == set(range(8)) - {own}
    loads = np.delete(np.bincount([r["shard"] for r in found], [r["size"] for r in found], 8), own)
    assert loads.max() - loads.min() < 0.02 * loads.mean() + 50


def test_plan_of_groups_above_the_mean():
    loads = lambda counts, shards=8: np.bincount(*zip(*((x, s * (b - a)) for s, a, b, x in sharding.plan(counts, shards)), strict=True), shards)
    assert loads({700: 1, 10: 140}).tolist() == [700, *[200] * 7]
    # The mean of what is left falls below the second and third size, too.
    assert loads({1000: 1, 300: 2, 150: 1, 1: 400}).tolist() == [1000, 300, 300, 150, *[100] * 4]
    assert loads({9: 3, 2: 1}).tolist() == [9, 9, 9, 2, 0, 0, 0, 0]
    assert loads({5: 2, 1: 3}, 1).tolist() == [13]
    ranks = sorted((s, r) for s, a, b, _ in sharding.plan({1000: 1, 300: 2, 1: 400}, 8) for r in range(a, b))
    assert ranks == [*((1, r) for r in range(400)), (300, 0), (300, 1), (1000, 0)]
    assert sharding.plan({}, 8) == []


def test_best_fit_decreasing():
    assert sharding.best_fit({6: 2, 4: 2, 3: 1}, None, 10) is not None
    r = random.Random(5)
    counts = {s: r.randint(1, 9) for s in r.sample(range(1, 500), 60)}
    runs = sharding.best_fit(counts, None, 1000)
    loads = {}
    for size, a, b, shard in runs:
        loads[shard] = loads.get(shard, 0) + size * (b - a)
    assert max(loads.values()) <= 1000
    assert len(loads) <= 1.05 * sum(s * n for s, n in counts.items()) / 1000 + 1
    assert sharding.best_fit({1001: 1}, None, 1000) is None
    # The tightest bin with room, as a plain search finds it.
    tree, plain = sharding.RoomTree(), []
    for i in range(500):
        if plain and r.random() < 0.5:
            size = r.randint(1, 300)
            fits = [x for x in plain if x[0] >= size]
            assert tree.take(size) == (min(fits) if fits else None)
            if fits:
                plain.remove(min(fits))
        else:
            plain.append((r.randint(1, 300), i))
            tree.add(*plain[-1])


# Top-k ----------------------------------------------------------------------------------------------------------


def plain_top_k(vectors, asked, k):
    out = set()
    for i, v in vectors:
        if asked(i):
            best = sorted((-int(np.dot(v, w)), j) for j, w in vectors if j != i)[:k]
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [20_000, 40])
def test_top_k_equals_brute_force(spark, block):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], np.float64)).astype(np.int64)) for r in vectors.collect()]
    found = knn.top_k(vectors, F.col("vec_id") % 20 == 0, 10, n_pivots=16, block=block)
    assert {tuple(r) for r in found.collect()} == plain_top_k(data, lambda i: i % 20 == 0, 10)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 0.0], 1)]
    rows_ += [(6, [inf, 0.0], 1), (7, [None, 0.1], 1), (8, [], 1), (None, [0.5, 0.5], 1), (100, [-0.5, 0.25], 1), (200, None, 1), (9, [0.1], 1)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, v int")
    found = knn.top_k(df, F.col("vec_id") % 100 == 0, 3)
    data = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v, _ in rows_ if i in (0, 1, 2, 3, 100)]
    assert {tuple(r) for r in found.collect()} == plain_top_k(data, lambda i: i % 100 == 0, 3)
    assert knn.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert knn.top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("n_pivots, query_block", [(700, 5000), (16, 3)])
def test_top_k_of_a_query_id_in_many_rows(spark, n_pivots, query_block):
    r = np.random.default_rng(3)
    data = [(int(i), r.normal(0, 0.3, 8).tolist()) for i in range(1, 601) if i != 100]
    data += [(100, [0.25] * 8)] * 14
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = knn.top_k(df, F.col("vec_id") % 100 == 0, 10, n_pivots=n_pivots, query_block=query_block)
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in data]
    want = set()
    for query in (100, 200, 300, 400, 500, 600):
        own = next(v for i, v in whole if i == query)
        best = sorted((-int(own @ v), i) for i, v in whole if i != query)[:10]
        want |= {(query, rank, i, -score) for rank, (score, i) in enumerate(best, 1)}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found.collect()} == want


def test_language_rejects_noise_and_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    r = random.Random(1)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 9))) for _ in range(60))
    odd_texts = [
        noise,
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει μακριά στο δάσος",
        "これは日本語の文章です。漢字とひらがなが混ざっています。今日はとても良い天気なので散歩に行きました。",
        "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee kauas metsään ennen kuin ilta tulee ja yö laskeutuu",
    ]
    found = language_id.predict(spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string"), model)
    assert [x["accepted"] for x in found.orderBy("doc_id").collect()] == [False] * 4
    # Clean texts stay, also their first words alone.
    clean = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    for text in ("text", "substring_index(text, ' ', 1)", "substring_index(text, ' ', 12)"):
        judged = language_id.predict(clean.selectExpr("doc_id", f"{text} AS text"), model).where("lang_pred <> 'und'")
        assert judged.where("NOT accepted").count() <= 0.002 * judged.count()
