"""Deterministic sampling of trace units and disjoint dataset partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceweave.operators.ordered import DEFAULT_LIMIT, salted_attach, sequence

HASH_SPACE = 2**60


def draw(*parts: Column) -> Column:
    """Uniform integer in [0, 2^60) from an md5 digest, the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stratified_units(
    units: DataFrame,
    keys: Sequence[str],
    position: str,
    size: str,
    cap: int,
    seed: int,
) -> DataFrame:
    """At most ``cap`` units per key: one drawn from each equal stratum.

    ``position`` is the 0-based unit number and ``size`` the units of the key.
    The draw is a position computed per stratum, so this is a filter without a
    shuffle.  Keys with no more than ``cap`` units are kept whole.
    """
    if cap <= 0:
        return units
    n, p = F.col(size).cast("long"), F.col(position).cast("long")
    stratum = F.floor(((p + 1) * cap - 1) / n)
    low = F.floor(stratum * n / cap)
    high = F.floor((stratum + 1) * n / cap)
    chosen = low + F.pmod(draw(F.lit(seed), *[F.col(k) for k in keys], stratum), high - low)
    return units.where((n <= cap) | (p == chosen))


def iid_partitions(rows: DataFrame, key: str, clients: int, seed: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Disjoint, near-equal random split: hash order cut into ``clients`` runs.

    The whole table is one ordered key, so positions come from sliced counts.
    """
    n = F.broadcast(rows.groupBy().agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1)))
    placed = rows.withColumns({"_one": F.lit(1), "_draw": draw(F.lit(seed), F.col(key))})
    placed = sequence(placed, ["_one"], ["_draw", key], limit).numbered("_pos").rows()
    placed = placed.join(n, "_one")
    pos, size = F.col("_pos") - 1, F.col("_n")
    longer = size % clients
    base = F.floor(size / clients)
    edge = longer * (base + 1)
    slot = F.when(pos < edge, F.floor(pos / (base + 1))).otherwise(
        longer + F.floor((pos - edge) / F.greatest(base, F.lit(1)))
    )
    return placed.withColumn("client_index", slot.cast("int")).drop("_one", "_draw", "_pos", "_n")


def uniform(*parts: Column) -> Column:
    """Uniform double in (0, 1) from `draw`."""
    return (draw(*parts).cast("double") + 0.5) / float(HASH_SPACE)


#: Attempts that one gamma draw may take; each is refused with a chance below 0.05.
GAMMA_ATTEMPTS = 16


def log_gamma_draw(alpha: float, *parts: Column) -> Column:
    """Logarithm of a Gamma(alpha) variate that the parts determine, from built-in functions only.

    Squeeze-free rejection of a cubed normal variate (Marsaglia and Tsang, 2000) at shape alpha + 1, brought down to
    alpha by a power of one more uniform; in logarithms, so that small shapes do not underflow. The first attempt that
    is accepted counts, the last one in any case.
    """
    d = alpha + 1.0 - 1.0 / 3.0
    c = 1.0 / (9.0 * d) ** 0.5

    def attempt(k: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, k, F.lit("r"))))
        x = radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, k, F.lit("t")))
        v = F.pow(F.lit(1.0) + F.lit(c) * x, F.lit(3.0))
        log_v = F.log(F.greatest(v, F.lit(1e-300)))
        good = (v > 0) & (F.log(uniform(*parts, k, F.lit("a"))) < 0.5 * x * x + d - d * v + d * log_v)
        return F.struct((good | (k == GAMMA_ATTEMPTS - 1)).alias("good"), (F.lit(math.log(d)) + log_v).alias("value"))

    tries = F.transform(F.sequence(F.lit(0), F.lit(GAMMA_ATTEMPTS - 1)), attempt)
    first = F.element_at(F.filter(tries, lambda t: t["good"]), 1)["value"]
    return first + F.log(uniform(*parts, F.lit("p"))) / alpha


def dirichlet_edges(labels: DataFrame, label: str, clients: int, alpha: float, seed: int) -> DataFrame:
    """label and `edges`: for each client the share of the class that it and those before it get, from one Dirichlet draw."""
    drawn = labels.select(label, F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("_i"))
    drawn = drawn.withColumn("_g", log_gamma_draw(alpha, F.lit(seed), F.col(label), F.col("_i")))
    # One short array per class.
    listed = drawn.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_i", "_g"))).alias("_l"), F.max("_g").alias("_m"))
    shares = F.transform("_l", lambda e: F.exp(e["_g"] - F.col("_m")))
    upto = F.transform(F.sequence(F.lit(1), F.lit(clients)), lambda n: F.aggregate(F.slice("_s", F.lit(1), n), F.lit(0.0), lambda a, x: a + x))
    return listed.withColumn("_s", shares).withColumn("_u", upto).select(
        label, F.transform("_u", lambda x: x / F.element_at("_u", -1)).alias("edges")
    )


def dirichlet_partitions(
    rows: DataFrame,
    key: str,
    label: str,
    clients: int,
    alpha: float,
    seed: int,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Label-skewed disjoint split: per class, the hash order is cut at a Dirichlet draw's shares.

    The draws are column expressions over md5, so any SQL engine can repeat them and no class list reaches the driver.
    Empty clients then take one row from the largest. Rows without a label go to no client.
    """
    if alpha <= 0 or clients <= 0:
        raise ValueError("alpha and the number of clients must be positive")
    known = rows.where(F.col(label).isNotNull())
    edges = dirichlet_edges(known.select(label).distinct(), label, clients, float(alpha), seed)
    placed = known.withColumn("_draw", draw(F.lit(seed), F.col(key)))
    placed = sequence(placed, [label], ["_draw", key], limit).numbered("_pos")
    placed = placed.key_stats({"_n": F.count(F.lit(1))}).rows()
    # A class is spread over its rows, one row per class meets them.
    placed = salted_attach(placed, edges, [label], F.col("_draw"), how="inner")
    cuts = F.transform("edges", lambda e: F.floor(e * F.col("_n") + 0.5))
    before = F.size(F.filter(cuts, lambda c: c < F.col("_pos")))
    parts = placed.withColumn("client_index", F.least(before, F.lit(clients - 1)).cast("int")).drop("_pos", "_n", "edges")
    return _fill_empty(parts, key, clients).drop("_draw")


def _fill_empty(parts: DataFrame, key: str, clients: int) -> DataFrame:
    """Give every empty client one row of the currently largest one."""
    sizes = {r["client_index"]: r["count"] for r in parts.groupBy("client_index").count().collect()}
    sizes = {i: sizes.get(i, 0) for i in range(clients)}
    moves: dict[int, list[int]] = {}
    for empty in [i for i, n in sizes.items() if n == 0]:
        donor = max(range(clients), key=lambda i: sizes[i])
        if sizes[donor] <= 1:
            break
        moves.setdefault(donor, []).append(empty)
        sizes[donor] -= 1
        sizes[empty] += 1
    for donor, takers in moves.items():
        ranked = (
            parts.where(F.col("client_index") == donor).orderBy("_draw", key).limit(len(takers)).select(key)
        )
        moved = ranked.withColumn(
            "_taker",
            F.element_at(
                F.array(*[F.lit(t) for t in takers]),
                F.row_number().over(Window.orderBy(key)),
            ),
        )
        parts = (
            parts.join(F.broadcast(moved), key, "left")
            .withColumn("client_index", F.coalesce("_taker", "client_index"))
            .drop("_taker")
        )
    return parts


def calibration_holdout(
    rows: DataFrame, key: str, label: str, fraction: float = 0.10, seed: int = 42, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Hold out a share of the normal rows (label 0) and drop anomalies from training.

    Adds ``split`` = calibration, train or excluded.  At least one and at most
    all but one normal row is held out.
    """
    normal = F.col(label) == 0
    placed = rows.withColumns(
        {"_normal": normal.cast("int"), "_draw": draw(F.lit(seed + 73001), F.col(key))}
    )
    placed = sequence(placed, ["_normal"], ["_draw", key], limit).numbered("_pos")
    placed = placed.key_stats({"_n": F.count(F.lit(1))}).rows()
    share = F.least(F.greatest(F.round(F.col("_n") * fraction), F.lit(1)), F.col("_n") - 1)
    return placed.withColumn(
        "split",
        F.when(F.col("_normal") == 0, "excluded").when(F.col("_pos") <= share, "calibration").otherwise("train"),
    ).drop("_normal", "_draw", "_pos", "_n")


def assignment_identity(parts: DataFrame, key: str, label: str) -> DataFrame:
    """Size, class histogram and an order-free content id per partition.

    The id adds up 60-bit digests (two independent sums), so it needs no sorted
    list of all members and merges map side.
    """
    one, two = draw(F.lit("a"), F.col(key)), draw(F.lit("b"), F.col(key))
    per_class = parts.groupBy("client_index", label).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((one % 1_000_000_007).cast("decimal(38,0)")).alias("_a"),
        F.sum((two % 1_000_000_009).cast("decimal(38,0)")).alias("_b"),
    )
    return per_class.groupBy("client_index").agg(
        F.sum("n").alias("row_count"),
        F.concat_ws(
            ",",
            F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col(label).cast("string"), 6, "0"), F.col("n")))),
        ).alias("class_histogram"),
        F.sha2(
            F.concat_ws("|", F.col("client_index"), F.sum("n"), F.sum("_a"), F.sum("_b")), 256
        ).alias("assignment_id"),
    )


def slot_assignment(parts: DataFrame, client_index: int, clients: int, key: str, label: str) -> DataFrame:
    """Size, class histogram and identity of one client's share; the index must be one of the clients'."""
    if clients <= 0:
        raise ValueError("the number of clients must be positive")
    if not 0 <= client_index < clients:
        raise ValueError(f"client_index must be in [0, {clients - 1}]: {client_index}")
    return assignment_identity(parts.where(F.col("client_index") == client_index), key, label)


def partition_slot(name: Column | str) -> Column:
    """0-based slot asked for by ``client_N``."""
    value = F.col(name) if isinstance(name, str) else name
    digits = F.regexp_extract(value, r"^client_(\d+)$", 1)
    return F.when(digits != "", F.greatest(digits.cast("int") - 1, F.lit(0)))


def normalize_partition_type(name: str, alpha: float | None = None, clients: int = 1) -> tuple[str, float | None]:
    kind = str(name or "iid").strip().lower().replace("-", "_")
    aliases = {"iid": "iid", "non_iid": "non_iid", "noniid": "non_iid", "dirichlet": "non_iid"}
    if kind not in aliases:
        raise ValueError(f"unknown partition type: {name}")
    if clients <= 0:
        raise ValueError("the number of clients must be positive")
    if aliases[kind] == "non_iid":
        if alpha is None or alpha <= 0:
            raise ValueError("a label-skewed split needs a positive alpha")
        return "non_iid", float(alpha)
    return "iid", None


def partition_token(kind: str, alpha: float | None = None) -> str:
    """File name part: ``iid`` or ``non_iid_alpha_0p5``."""
    kind, alpha = normalize_partition_type(kind, alpha)
    return kind if alpha is None else f"non_iid_alpha_{alpha:g}".replace(".", "p")
