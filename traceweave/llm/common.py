"""Helpers that several of these operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweave.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own switch: shuffle files go when the execution that made them ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read to the shared folder, and read it again: no lineage is left behind it.

    The shuffle files of the write are not needed once it has ended, so they are dropped with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches bounded by bytes, so that long texts do not pile up beside a task's heap.

    Spark reads the bound when the query runs, so it stays set for the session unless the session has its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, "4m")
    return df.mapInArrow(function, schema)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, ways: int = 64) -> DataFrame:
    """Add `name`: a gapless number from 0 within `keys`, in `order` within each of `ways` slices of a key.

    Slices come from a hash of the whole row, so a key that holds most rows is numbered by `ways` tasks. Only the
    keys x ways slice counts are summed up beforehand. Nulls in keys are a key of their own. Equal rows get
    different numbers.
    """
    from pyspark.sql import Window

    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(*df.columns), F.lit(ways)).cast("int"))
    held = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"__key{i}") for i, k in enumerate(keys)]
    named = [f"__key{i}" for i in range(len(keys))]
    sliced = sliced.select("*", *held)
    counts = sliced.groupBy(*named, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*named).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*named, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*named, "__slice").orderBy(*order)
    return (
        sliced.withColumn("__row", F.row_number().over(inside))
        .join(starts, [*named, "__slice"])
        .withColumn(name, (F.col("__start") + F.col("__row") - 1).cast("long"))
        .select(*df.columns, name)
    )


#: Edges that one task contracts at a time, about.
EDGE_BLOCK = 500_000


def _contracted(batches):
    """The edges of one block as stars around their smallest nodes: (node, root) for every node but the roots."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    left, right = (np.concatenate(side) for side in zip(*parts, strict=True))
    nodes, codes = np.unique(np.concatenate((left, right)), return_inverse=True)
    left, right = codes[: len(left)], codes[len(left) :]
    root = np.arange(len(nodes))
    while True:
        # Roots of linked nodes are joined at the smaller one, then every node looks up its root's root.
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node that can be reached.

    Each round contracts blocks of about EDGE_BLOCK edges to stars, all blocks side by side. If the stars of different
    blocks touch, a large-star and a small-star step over all edges (grouped minima and joins on the node, which
    adaptive execution splits where one node has a third of all edges) bring them together, and the next round
    contracts what is left. Nulls are no nodes.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    given = stored(now.where(a.isNotNull() & b.isNotNull()), "cc-edges")
    now = given.where(a != b)
    while True:
        blocks = max(1, -(-now.count() // EDGE_BLOCK))
        now = stored(in_arrow(now.coalesce(blocks), _contracted, "a long, b long"), "cc-stars")
        if _are_stars(now):
            break
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where(a != F.col("m")).select("a", F.col("m").alias("b")))
        large = large.where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(a != b)
        now = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
    nodes = given.select("a").union(given.select("b")).distinct()
    return nodes.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root at most, and no root has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    found = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return found.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("root") > 0)).isEmpty()
