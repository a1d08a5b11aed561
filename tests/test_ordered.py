"""Sliced operators agree with plain ones when one key holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceweave.operators import metrics as M
from traceweave.operators.features import entropy_of
from traceweave.operators.ordered import exact_quantiles, sequence


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 600
    return pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n)),
            # A third of all rows share one time; the index breaks the tie.
            "t": np.where(rng.random(n) < 0.5, 5.0, rng.random(n).round(3) * 1e6),
            "i": np.arange(n),
            "v": rng.integers(0, 50, n).astype(float),
            "known": np.where(rng.random(n) < 0.3, rng.integers(0, 9, n), -1),
        }
    )


@pytest.mark.parametrize("limit", [10**6, 40, 7])
def test_order_operators(spark, skewed, limit):
    df = spark.createDataFrame(skewed)
    rows = sequence(df, ["key"], ["t", "i"], limit)
    assert rows.sliced == (limit < 1000)
    rows = rows.previous({"pv": F.col("v"), "pk": F.when(F.col("known") >= 0, F.col("known"))})
    rows = rows.running_sum({"s": F.col("v")}).numbered("n").key_stats({"top": F.max("v")})
    got = rows.rows().toPandas().sort_values("i").reset_index(drop=True)
    want = skewed.sort_values(["key", "t", "i"]).copy()
    g = want.groupby("key")
    want["pv"] = g["v"].shift()
    want["pk"] = want["known"].where(want["known"] >= 0).groupby(want["key"]).ffill().groupby(want["key"]).shift()
    want["s"], want["n"], want["top"] = g["v"].cumsum(), g.cumcount() + 1, g["v"].transform("max")
    want = want.sort_values("i").reset_index(drop=True)
    for c in ("pv", "pk", "s", "n", "top"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("limit", [40, 6])
def test_odd_order_keys_do_not_change_place(spark, limit):
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 5.0]
    rows = [
        (
            None if rng.random() < 0.4 else str(rng.choice(["hot", "a"])),
            odd[rng.integers(0, 5)] if rng.random() < 0.6 else float(rng.integers(0, 30)),
            None if rng.random() < 0.2 else int(rng.integers(0, 40)),
            i,
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "key string, t double, j int, i int")

    def made(limit):
        found = sequence(df, ["key"], ["t", "j", "i"], limit)
        found = found.previous({"p": F.col("i")}).running_sum({"s": F.col("i")}).numbered("n")
        return found.sliced, {r["i"]: (r["p"], r["s"], r["n"]) for r in found.rows().collect()}

    whole, cut = made(10**6), made(limit)
    assert (whole[0], cut[0]) == (False, True)
    assert cut[1] == whole[1]


@pytest.mark.parametrize("limit", [10**6, 9])
def test_exact_quantiles(spark, skewed, limit):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(5)]
    got = exact_quantiles(spark.createDataFrame(skewed), ["key"], "t", probs, names, limit).toPandas().set_index("key")
    for key, part in skewed.groupby("key"):
        np.testing.assert_allclose(got.loc[key, names].astype(float), np.quantile(part["t"], probs))


@pytest.mark.parametrize("skew", [False, True])
def test_entropy(spark, skewed, skew):
    got = entropy_of(spark.createDataFrame(skewed), ["key"], {"h": F.col("v")}, skew).toPandas().set_index("key")["h"]
    for key, part in skewed.groupby("key"):
        n = len(part)
        counts, _ = np.histogram(part["v"], bins=min(32, max(4, int(np.sqrt(n)))))
        p = counts[counts > 0] / n
        assert got[key] == pytest.approx(float(-(p * np.log2(p)).sum()))


@pytest.mark.parametrize("limit", [10**6, 11])
def test_ranking_metrics(spark, skewed, limit):
    data = skewed.assign(y=(skewed["v"] + 10 * (skewed["known"] > 3) > 30).astype(int))
    df = spark.createDataFrame(data)
    roc = M.auroc(df, ["key"], "y", "v", limit).toPandas().set_index("key")["auroc"]
    ap = M.average_precision(df, ["key"], "y", "v", limit).toPandas().set_index("key")["average_precision"]
    for key, part in data.groupby("key"):
        pos, neg = part.loc[part["y"] == 1, "v"].to_numpy(), part.loc[part["y"] == 0, "v"].to_numpy()
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert roc[key] == pytest.approx(wins / (len(pos) * len(neg)))
        total, seen, hits = 0.0, 0, 0
        for _, tied in sorted(part.groupby("v"), reverse=True):
            seen, hits = seen + len(tied), hits + tied["y"].sum()
            total += tied["y"].sum() * hits / seen
        assert ap[key] == pytest.approx(total / part["y"].sum())
