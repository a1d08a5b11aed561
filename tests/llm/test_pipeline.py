import brute
import pytest
from messy_rows import SF, docs, messy, none, odd  # noqa: F401  fixtures

import __spark_entry__ as entry
import corpus_pipeline
from traceweave.llm.common import stored


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


def through(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), f"test-{name}"))
    return out


@pytest.mark.parametrize("kind", ["messy", "sf"])
def test_stages(spark, docs, kind):
    before = docs if kind == "messy" else spark.read.parquet(f"{SF}/documents.parquet")
    given, language, exact, near, cut, packed = through(spark, before)
    for df in (language, exact, near, cut):
        assert df.columns == given.columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    known, kept, spread, short = texts(language), texts(exact), texts(near), texts(cut)
    if kind == "sf":
        assert len(known) == given.count()
    last = {}
    for doc in sorted(known):
        last[known[doc]] = doc
    assert kept == {doc: text for text, doc in last.items()}
    linked = brute.near_components(list(kept.items()), 5)
    assert set(spread) == {d for d, (_, root) in linked.items() if d == root}
    words = brute.kept_words(list(spread.items()))
    assert short == {d: spread[d] if a == b else " ".join(b) for d, (a, b) in words.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert {r["doc_id"] for r in packed.collect()} == set(short)


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = through(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].collect()
    assert sorted(r["ids_crc32"] for r in rows) == sorted(r["ids_crc32"] for r in want)


def test_empty_table(spark, none):
    assert all(df.count() == 0 for df in through(spark, none))


def test_rows_without_ids(spark, odd):
    assert through(spark, odd)[-1].count() >= 1
