import hashlib
import random

import brute
import pytest
from messy_rows import SF, docs, messy, none, odd  # noqa: F401  fixtures

from traceweave.llm import conversation_trie, decontamination, periodic_runs
from traceweave.llm import queries as q

TURNS = "conv_id long, turn long, role string, text string, pos long, key string, n int"


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Decontamination ------------------------------------------------------------------------------------------------


def items(texts):
    r = random.Random(9)
    out = [(None, "one"), (1, None), (2, ""), (3, "..."), (4, "Word, one!"), (10, "漢字かな交じり文"), (10, "tab feed")]
    for i, text in enumerate(t for t in texts if t and len(t) > 200):
        words = brute.item_words(text)
        at = r.randrange(max(1, len(words) - 30))
        out.append((20 + i, "?".join(words[at : at + r.choice([3, 9, 10, 11, 30])]).upper()))
    out += [out[-1], (99, out[-1][1])]
    return [(i, t, "clash", i) for i, t in out]


def held(found, texts, benchmark):
    want = list(brute.contamination(texts, benchmark))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 50
    texts = dict(texts)
    for r in found:
        cut = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]]
        ranges = [brute.item_words(texts[r["doc_id"]])[s["first"] : s["behind"]] for s in r["hit_words"]]
        assert [brute.item_words(x) for x in cut] == ranges and sum(map(len, ranges)) == r["n_hit"]


@pytest.mark.parametrize("block, group", [(4 << 20, 64 << 20), (2_000, 64 << 20), (2_000, 300)])
def test_contamination_is_that_of_brute_force(spark, docs, monkeypatch, block, group):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "GROUP_BYTES", group)
    texts = [r[:2] for r in messy()]
    benchmark = items([t for _, t in texts])
    table = spark.createDataFrame(benchmark, "item_id long, text string, words string, doc_id int")
    held(rows(decontamination.contamination(docs, table)), texts, [b[:2] for b in benchmark])


def test_items_longer_than_a_part(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "PART", 7)
    texts = [r[:2] for r in messy()]
    benchmark = [(1, texts[11][1]), (2, texts[9][1]), (3, "a b")]
    parts = [p for batch in decontamination._parts(10)(spark.createDataFrame(benchmark, "item string, text string").toArrow().to_batches()) for p in batch.column("words").to_pylist()]
    assert len(parts) > 10
    words = texts[11][1].split()
    assert sum(max(len(p.split()) - 9, 1) for p in parts) == len(words) - 9 + 60 - 9 + 1


def test_contamination_of_odd_tables(spark, docs, odd, none):
    benchmark = spark.createDataFrame([(1, "w3 w4 w5"), (2, "other")], "item_id long, text string")
    found = rows(decontamination.contamination(odd, benchmark))
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["items"]) for r in found) == sorted(
        [(0, 3, ["1"]), (0, 0, []), (7, 3, ["1"]), (7, 3, ["1"]), (7, 1, ["2"]), (9, 3, ["1"]), (8, 0, [])]
    )
    assert decontamination.contamination(none, benchmark).count() == 0
    assert {r["n_hit"] for r in rows(decontamination.contamination(docs, benchmark.limit(0)))} == {0}


# Prefix trie ----------------------------------------------------------------------------------------------------


def conversations(n, seed):
    """Shared beginnings, copies, a long conversation and its copy, and turns that differ in role only."""
    r = random.Random(seed)
    out = {}
    for conv in r.sample(range(1000), n):
        length = r.choice([1, 1, 2, 3, 5, 9])
        out[conv] = [(r.choice(["user", "user", "assistant", ""]), r.choice(["", "a", "é", "bb"])) for _ in range(length)]
    first, second, third = list(out)[:3]
    out[first] = out[second] = [("user", f"t{i}") for i in range(300)]
    out[third] = out[first][:250] + [("user", "unique")] * 5
    return out


def turn_rows(spark, talks, seed=1):
    made = [(c, i * 2 - 1 if i else None, role or None, text or None, 1, "x", 2) for c, t in talks.items() for i, (role, text) in enumerate(t)]
    random.Random(seed).shuffle(made)
    return spark.createDataFrame(made, TURNS)


def nodes(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in rows(df)), key=str)


@pytest.mark.parametrize("shard_rows", [20_000, 40])
def test_trie_is_that_of_brute_force(spark, shard_rows):
    talks = conversations(90, 3)
    found = conversation_trie.prefix_trie(conversation_trie.placed(turn_rows(spark, talks)), shard_rows)
    assert nodes(found) == brute.trie(talks)


@pytest.mark.parametrize("seed", [4, 5])
def test_branched_trie_is_that_of_brute_force(spark, seed):
    talks = conversations(120, seed)
    branched = q.branched(conversation_trie.placed(turn_rows(spark, talks)))
    assert nodes(conversation_trie.prefix_trie(branched, 60)) == brute.trie(brute.branch(talks))


def test_conversations_without_turns_are_members_of_the_root(spark):
    # 7 and 8 lose their turns or take some, and 5 is absent.
    talks = {c: [("user", "x")] for c in (7, 8, 9, 11, 12, 13, 14)}
    want = brute.branch(talks)
    assert [] in want.values()
    assert nodes(conversation_trie.prefix_trie(q.branched(conversation_trie.placed(turn_rows(spark, talks))))) == brute.trie(want)


def test_trie_of_odd_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "a"), (2, 5, "user", "a"), (2, None, None, None)],
        "conv_id long, turn long, role string, text string",
    )
    want = brute.trie({1: [("user", "a")] * 2, 2: [("", ""), ("user", "a")]})
    assert nodes(conversation_trie.conversation_trie(turns)) == want
    assert conversation_trie.conversation_trie(turns.limit(0)).count() == 0
    assert conversation_trie.conversation_trie(turns.where("conv_id IS NULL")).count() == 0


# Periodic runs --------------------------------------------------------------------------------------------------


def test_runs_of_random_texts(spark):
    r, texts = random.Random(6), []
    for i in range(1500):
        k = r.choice([1, 2, 3, 5, 8])
        words = [r.choice("abcdefgh"[:k]) for _ in range(r.randint(0, 60))]
        pattern = [r.choice("abcdefgh"[:k]) for _ in range(r.randint(1, 14))]
        if i % 2:
            words[len(words) // 3 : len(words) // 3] = (pattern * 7)[: r.randint(0, 90)]
        texts.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    found = rows(periodic_runs.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")))
    total = 0
    for r in found:
        words = brute.WORD.findall(texts[r["doc_id"]][1])
        want = brute.runs(words)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert r["collapsed"] == " ".join(brute.collapsed(words, want)) and r["n_words"] == len(words)
        total += len(want)
    assert total > 500


def test_runs_of_odd_texts(spark, docs, odd, none):
    texts = [(1, "x " * 5000, 1), (2, "a b " * 3000 + "c", 1), (3, None, 1), (None, "z z z z z z", 1), (3, "z z z z z", 1)]
    found = rows(periodic_runs.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string, runs int")))
    assert sorted(((r["doc_id"] or 0), [tuple(x.values()) for x in map(lambda y: y.asDict(), r["runs"])], r["collapsed"]) for r in found) == [
        (0, [(0, 6, 1)], "z"), (1, [(0, 5000, 1)], "x"), (2, [(0, 6000, 2)], "a b c"), (3, [], ""), (3, [], "z z z z z"),
    ]
    assert periodic_runs.periodic_runs(docs).count() == len(messy())
    assert periodic_runs.periodic_runs(odd).count() == 7
    assert periodic_runs.periodic_runs(none).count() == 0


def test_runs_query(spark):
    found = rows(q.QUERIES["op13_periodic_runs"](spark, SF))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        words = brute.looped(r["doc_id"], brute.WORD.findall(texts[r["doc_id"]] or ""))
        if len(words) > 2_000:  # brute force takes the square of it
            continue
        runs = brute.runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == sha(" ".join(brute.collapsed(words, runs)))


def test_looping_follows_its_rule(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(400)] + [(None, "a b"), (1000, None)]
    found = rows(q.looping(spark.createDataFrame(texts, "doc_id long, text string")))
    given = dict(texts)
    for r in found:
        if r["text"] is None or r["doc_id"] is None:
            assert r["text"] == given[r["doc_id"]]
        else:
            assert r["text"].split() == brute.looped(r["doc_id"], given[r["doc_id"]].split())
    assert sum(r["text"] != given[r["doc_id"]] for r in found) > 10
