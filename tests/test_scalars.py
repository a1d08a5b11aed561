import hashlib
import time

from pyspark.sql import functions as F

from traceweave.functions import exprs as X


def hashed(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_token_ids_hash_a_long_text_once(spark):
    """Work in proportion to the words, however many pieces a text has."""
    words = [f"w{i}" for i in range(100_000)]
    df = spark.createDataFrame([(" ".join(words),), (None,), ("A b",)], "text string").coalesce(1)
    began = time.monotonic()
    long, none, short = (r[0] for r in df.select(X.token_ids("text", 128, 30000)).collect())
    assert time.monotonic() - began < 60
    assert len(long) == 782 and {len(p) for p in long} == {128}
    ids = [i for p in long for i in p]
    assert ids[:100_000] == [2 + hashed(w) % 29998 for w in words] and not any(ids[100_000:])
    assert none == [[0] * 128]
    assert short == [[2 + hashed("a") % 29998, 2 + hashed("b") % 29998] + [0] * 126]


def test_masked_tokens_draw_once_a_token(spark):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i + F.col("id")) % 5)
    rows = spark.range(0, 4000, 1, 1).select("id", tokens.cast("array<long>").alias("t"))
    inputs, targets = X.masked_tokens(F.col("t"), F.col("id"), 42)
    began = time.monotonic()
    found = rows.select("id", "t", inputs.alias("i"), targets.alias("o")).collect()
    assert time.monotonic() - began < 60
    for r in found[:20]:
        draws = [hashed(f"{r.id}|{i}|42") % 1_000_000 / 1e6 if v > 1 else None for i, v in enumerate(r.t)]
        least = min(d for d in draws if d is not None)
        chosen = [d is not None and (d < 0.15 or d == least) for d in draws]
        assert r.i == [1 if c else v for c, v in zip(chosen, r.t, strict=True)]
        assert r.o == [v if c else -100 for c, v in zip(chosen, r.t, strict=True)]


def test_compact_count_units_and_ties(spark):
    values = [999, 1250, 1350, 100_050, 6_000_000, 2_500_000_000]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    names = ["B", "K"]
    found = [tuple(r) for r in df.select(*[X.compact_count("v", n) for n in names]).collect()]
    assert found == [
        ("999", "999"),
        (f"{1.25:.1f}K", "1.2K"),
        (f"{1.35:.1f}K", f"{1.35:.1f}K"),
        (f"{100.05:.1f}K", f"{100.05:.1f}K"),
        ("6.0M", "6000.0K"),
        ("2.5B", "2500000.0K"),
    ]
