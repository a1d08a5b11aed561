"""Who a connection belongs to: registrations, manifests, labels and aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import DEFAULT_LIMIT, sequence

# ---- fixed values -------------------------------------------------------
REGISTERED = "network_registration"
CONFIRMED = "network_registration_confirmed"
TINY_PACKETS = 100
TINY_SHARE = 0.0001
CONTEXT_FIELDS = ("dataset", "dataset_split", "operating_system", "batch_size", "input_size")
# -------------------------------------------------------------------------


def unique_aliases(
    df: DataFrame, scope: Sequence[str], alias: str, order: Sequence[str], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Second and later holders of an alias get ``_2``, ``_3`` ..."""
    numbered = sequence(df, [*scope, alias], order, limit).numbered("_n").rows()
    suffixed = F.concat(F.col(alias), F.lit("_"), F.col("_n").cast("string"))
    return numbered.withColumn(alias, F.when(F.col("_n") > 1, suffixed).otherwise(F.col(alias))).drop("_n")


def next_number(df: DataFrame, scope: Sequence[str], name: str, pattern: str) -> DataFrame:
    """Largest number in use plus one (gaps are never reused)."""
    used = F.regexp_extract(name, pattern, 1).try_cast("long")
    return df.groupBy(*scope).agg((F.coalesce(F.max(used), F.lit(0)) + 1).alias("next_number"))


def registrations(events: DataFrame, fail_on_conflict: bool = True) -> DataFrame:
    """(run, ip, port) -> client from registration events; one owner or an error."""
    rows = events.where(
        F.col("event").isin(REGISTERED, CONFIRMED)
        & (X.text("local_ip") != "")
        & (X.lenient_int("local_port") > 0)
        & (X.text("client_id") != "")
    )
    owned = rows.groupBy(
        "run_id", X.text("local_ip").alias("client_ip"), X.lenient_int("local_port").alias("client_port")
    ).agg(F.min("client_id").alias("client_id"), F.max("client_id").alias("_other"))
    if fail_on_conflict:
        message = F.concat(F.lit("two clients registered "), F.col("client_ip"), F.lit(":"), F.col("client_port"))
        owned = owned.withColumn(
            "client_id",
            F.when(F.col("client_id") == F.col("_other"), F.col("client_id")).otherwise(F.raise_error(message)),
        )
    else:
        owned = owned.where("client_id = _other")
    return owned.drop("_other")


def match_manifest(manifest: DataFrame, registered: DataFrame) -> DataFrame:
    """Manifest alias -> client: exact (run, ip, port) first, else the ip's only owner.

    Adds ``resolved_client_id`` (null if unknown) and ``match`` = exact, ip_only
    or none.
    """
    exact = registered.select("run_id", "client_ip", "client_port", F.col("client_id").alias("_exact"))
    sole = (
        registered.groupBy("run_id", "client_ip")
        .agg(F.min("client_id").alias("_sole"), F.max("client_id").alias("_max"))
        .where("_sole = _max")
        .drop("_max")
    )
    return (
        manifest.join(exact, ["run_id", "client_ip", "client_port"], "left")
        .join(sole, ["run_id", "client_ip"], "left")
        .withColumns(
            {
                "resolved_client_id": F.coalesce("_exact", "_sole"),
                "match": F.when(F.col("_exact").isNotNull(), "exact")
                .when(F.col("_sole").isNotNull(), "ip_only")
                .otherwise("none"),
            }
        )
        .drop("_exact", "_sole")
    )


def registration_as_of(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Confirmations without an address take the client's latest earlier registration."""
    here = F.when(
        (X.text("local_ip") != "") & (X.lenient_int("local_port") > 0),
        F.struct(X.text("local_ip").alias("ip"), X.lenient_int("local_port").alias("port")),
    )
    log = sequence(events.withColumn("_here", here), keys, order, limit).previous(
        {"_last": F.when(F.col("event") == REGISTERED, F.col("_here"))}
    )
    connection = F.coalesce(F.col("_here"), F.col("_last"))
    confirmed = log.rows().where(F.col("event") == CONFIRMED).withColumn("_c", connection)
    return (
        confirmed.where(F.col("_c").isNotNull())
        .withColumns({"client_ip": F.col("_c.ip"), "client_port": F.col("_c.port")})
        .drop("_here", "_last", "_c")
    )


def tiny(count: Column, largest: Column) -> Column:
    """Setup or retry fragments: under 100 packets and under 0.01 % of the largest."""
    return (count < TINY_PACKETS) & (largest > 0) & (count < largest * TINY_SHARE)


def prune_retries(aliases: DataFrame, client: Sequence[str], count: str) -> DataFrame:
    """Drop retry fragments next to a far larger connection of the same client."""
    largest = aliases.groupBy(*client).agg(F.max(count).alias("_largest"))
    return aliases.join(largest, list(client)).where(~tiny(F.col(count), F.col("_largest"))).drop("_largest")


def choose_connections(
    registered: DataFrame, confirmed: DataFrame, observed: DataFrame
) -> DataFrame:
    """Observed connections of every registered client, with the reason.

    ``registered``/``confirmed``: run_id, client_id, client_ip, client_port;
    ``observed``: run_id, client_ip, client_port, packet_count.

    Confirmed connections are the seed, else the registered one with most
    packets.  If the seed's address has one owner, all its substantive
    connections join; retry fragments go, but never the last connection.
    """
    address = ["run_id", "client_ip"]
    connection = [*address, "client_port"]
    counts = observed.groupBy(*connection).agg(F.sum("packet_count").alias("packet_count"))
    seeds_confirmed = confirmed.select("run_id", "client_id", "client_ip", "client_port").distinct()
    without = registered.join(confirmed.select("run_id", "client_id").distinct(), ["run_id", "client_id"], "left_anti")
    longest = (
        without.join(counts, connection, "left")
        .groupBy("run_id", "client_id")
        .agg(
            F.max_by(
                F.struct("client_ip", "client_port"),
                F.struct(F.coalesce("packet_count", F.lit(0)), F.col("client_ip"), F.col("client_port")),
            ).alias("_c")
        )
        .select("run_id", "client_id", F.col("_c.client_ip"), F.col("_c.client_port"))
    )
    seeds = seeds_confirmed.withColumn("_base", F.lit(CONFIRMED)).unionByName(
        longest.withColumn("_base", F.lit("legacy_longest_registered_connection"))
    )
    owners = (
        seeds.groupBy(*address)
        .agg(F.min("client_id").alias("_a"), F.max("client_id").alias("_b"))
        .where("_a = _b")
        .select(*address, F.lit(True).alias("_sole"))
    )
    per_address = counts.where("packet_count > 0").groupBy(*address).agg(
        F.max("packet_count").alias("_largest"),
        F.count(F.lit(1)).alias("_seen"),
        F.max_by("client_port", F.struct("packet_count", "client_port")).alias("_largest_port"),
        F.count(F.when(F.col("packet_count") >= TINY_PACKETS, 1)).alias("_big"),
    )
    seeded = seeds.join(owners, address, "left").join(per_address, address, "left")
    open_seed = F.coalesce("_sole", F.lit(False)) & (F.coalesce("_seen", F.lit(0)) > 0)
    fixed = seeded.where(~open_seed).select(
        "run_id", "client_id", "client_ip", "client_port", "_base", F.lit(0).alias("_more"), F.lit(0).alias("_cut")
    )
    expanded = (
        seeded.where(open_seed)
        .select("run_id", "client_id", "client_ip", "_base", "_largest", "_seen", "_largest_port")
        .distinct()
        .join(counts.where("packet_count > 0"), address)
        .withColumn("_tiny", tiny(F.col("packet_count"), F.col("_largest")))
    )
    # The largest connection is never below its own share, so one always stays.
    flags = expanded.groupBy("run_id", "client_id").agg(
        F.max((F.col("_seen") > 1).cast("int")).alias("_more"), F.max(F.col("_tiny").cast("int")).alias("_cut")
    )
    kept = expanded.where(~F.col("_tiny")).join(flags, ["run_id", "client_id"]).select(*fixed.columns)
    union = fixed.unionByName(kept)
    reasons = union.groupBy("run_id", "client_id").agg(
        F.concat(
            F.min("_base"),
            F.when(F.max("_more") == 1, "_same_ip_reconnects").otherwise(""),
            F.when(F.max("_cut") == 1, "_retry_fragments_removed").otherwise(""),
        ).alias("reason")
    )
    return (
        union.select("run_id", "client_id", "client_ip", "client_port")
        .distinct()
        .join(counts, connection, "left")
        .withColumn("packet_count", F.coalesce("packet_count", F.lit(0)))
        .join(reasons, ["run_id", "client_id"])
    )


def backed_by_manifest(features: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk feature files that a manifest of the same folder and run lists."""
    return features.join(manifest.select(*keys).distinct(), list(keys), "left_semi")


def mapped_only(features: DataFrame, mapping: DataFrame, run: str, alias: str) -> DataFrame:
    """Where a run has any resolved alias, unresolved aliases are left out."""
    known = mapping.select(run, alias, F.lit(True).alias("_known")).distinct()
    runs = mapping.select(run, F.lit(True).alias("_mapped")).distinct()
    return (
        features.join(known, [run, alias], "left")
        .join(runs, run, "left")
        .where(F.col("_known").isNotNull() | F.col("_mapped").isNull())
        .drop("_known", "_mapped")
    )


def label_consensus(records: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One value per key and field: ``missing``, ``ok`` or ``conflict``.

    Context fields of records still ``pending_server`` are not counted.
    """
    long = records.unpivot([*keys, "status"], list(fields), "field", "value")
    usable = (X.text("value") != "") & ~(
        (F.col("status") == "pending_server") & F.col("field").isin(*CONTEXT_FIELDS)
    )
    value = F.when(usable, F.trim("value"))
    low, high = F.min(value), F.max(value)
    return long.groupBy(*keys, "field").agg(
        low.alias("value"),
        F.when(low.isNull(), "missing").when(low == high, "ok").otherwise("conflict").alias("consensus"),
    )


def require_consensus(labels: DataFrame) -> DataFrame:
    """Fail the query on missing or conflicting labels."""
    return labels.withColumn(
        "value",
        F.when(F.col("consensus") == "ok", F.col("value")).otherwise(
            F.raise_error(F.concat(F.col("field"), F.lit(": "), F.col("consensus")))
        ),
    )


def with_labels(
    rows: DataFrame,
    per_client: DataFrame,
    run: str,
    client: str,
    fields: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Labels by (run, client); runs with a single client also match by run alone."""
    exact = per_client.select(run, client, *[F.col(f).alias(f"_e_{f}") for f in fields])
    single = (
        per_client.groupBy(run)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.min(f).alias(f"_s_{f}") for f in fields],
        )
        .where("_n = 1")
        .drop("_n")
    )
    joined = rows.join(exact, [run, client], "left").join(single, run, "left")
    out = {f: F.coalesce(f"_e_{f}", f"_s_{f}") for f in fields}
    if strict:
        where = F.concat_ws("/", F.col(run), F.col(client))
        out = {
            f: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.concat(F.lit(f"no {f} label for "), where)))
            for f, c in out.items()
        }
    return joined.withColumns(out).drop(*[f"_{p}_{f}" for f in fields for p in "es"])


def run_metadata(manifests: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """First non-empty value per field, server manifests before proxy ones, then by path."""
    rank = F.when(F.col("role") == "server", 0).when(F.col("role") == "proxy", 1).otherwise(2)
    position = F.struct(rank.alias("rank"), F.col("path"))
    return manifests.groupBy(run).agg(
        F.min_by(F.struct(*fields), position).alias("_first")
    ).select(run, *[F.nullif(F.trim(F.col(f"_first.{f}")), F.lit("")).alias(f) for f in fields])
