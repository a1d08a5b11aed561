"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances: with M the largest squared length, a vector v gets the extra coordinate
sqrt(M - |v|^2) and a query the extra coordinate 0, so |q - v|^2 = |q|^2 + M - 2 q.v and the k highest products are the
k nearest vectors.

1. `PIVOTS` vectors are drawn (bounded, by hash) and every vector joins the cell of its nearest pivot.
2. A summary of each cell (count, largest and smallest distance to the pivot, the distances of its nearest k + 1 ids)
   gives every query group an upper bound of the distance to the k-th neighbour, because a member lies no further than
   by way of its pivot.
3. A vector is replicated to those query groups only whose bound it may meet by the triangle inequality.
4. Each group, dealt into blocks of data and slices of queries, is solved locally with integer products; the blocks' best k meet in a grouped
   merge. The group's own nearest members are part of what is replicated, so the result is exact.

Distances are used to discard only, with a slack above rounding errors; scores are 64-bit integers. Ties go to the
smaller vec_id.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part; vectors whose length
is not the most common one of the table take no part either; null ids take no part; repeated ids are vectors of their
own as candidates (their rows differ in score or are listed twice), a query's own id is never its neighbour; other
columns are not read. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceweave.llm.common import stored

PIVOTS = 64
SCALE = 1024
#: Data vectors of a query group that one task gets at most, about.
BLOCK = 20_000
#: Queries of a group that one task gets at most, about.
QUERY_BLOCK = 5_000


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the vectors that take part."""
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    found = vectors.where(good & F.coalesce(finite, F.lit(False)))
    return found.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _celled(pivots: np.ndarray, most: float):
    """Nearest pivot and the distances to it, of data (with the extra coordinate) and of queries (without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            v = _matrix(batch.column("v"))
            extra = np.sqrt(np.maximum(most - (v * v).sum(1), 0))
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            v = np.column_stack((v, np.where(asked, 0.0, extra)))
            squares = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)
            cell = squares.argmin(1)
            away = np.sqrt(((v - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("asked"), pa.array(cell, pa.int32()), pa.array(away)],
                names=["vec_id", "v", "asked", "cell", "away"],
            )

    return run


def _solved(k: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asked = group.column("asked").to_numpy()
        ids = group.column("vec_id").to_numpy()
        v = _matrix(group.column("v").chunk(0)).astype(np.int64)
        order = np.argsort(ids[~asked], kind="stable")
        data, data_ids = v[~asked][order], ids[~asked][order]
        queries, query_ids, vec_ids, scores = v[asked], [], [], []
        for query, own in zip(queries, ids[asked], strict=True):
            score = data @ query
            other = np.flatnonzero(data_ids != own)
            values = score[other]
            if len(values) > k:
                edge = np.partition(values, len(values) - k)[len(values) - k]
                near = np.flatnonzero(values >= edge)
                other, values = other[near], values[near]
            best = np.lexsort((data_ids[other], -values))[:k]
            query_ids += [int(own)] * len(best)
            vec_ids += data_ids[other[best]].tolist()
            scores += values[best].tolist()
        return pa.table(
            {
                "query_id": pa.array(query_ids, pa.int64()),
                "vec_id": pa.array(vec_ids, pa.int64()),
                "score": pa.array(scores, pa.int64()),
            }
        )

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 10, n_pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer products of every query row."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    usable = stored(quantised(vectors), "knn-vectors")
    width = usable.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("v") == width["width"])
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    most = float(usable.agg(F.max(square)).first()[0])
    # A bounded sample of pivots, the same at every run.
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = np.array([r["v"] for r in drawn], np.float64)
    pivots = np.column_stack((pivots, np.sqrt(np.maximum(most - (pivots * pivots).sum(1), 0))))

    # A repeated query id asks once, with its least vector.
    asking = usable.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    both = usable.withColumn("asked", F.lit(False)).union(asking.withColumn("asked", F.lit(True)))
    celled = stored(
        both.mapInArrow(_celled(pivots, most), "vec_id long, v array<long>, asked boolean, cell int, away double"),
        "knn-cells",
    )
    data, queries = celled.where(~F.col("asked")), celled.where("asked")
    summary = data.groupBy("cell").agg(F.max("away").alias("far"), F.min("away").alias("close"), F.count("*").alias("n"))
    # The nearest member of each id, k + 1 ids a cell; by slices first, so that a hot cell is not sorted in one task.
    sliced = Window.partitionBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("away", "vec_id")
    nearest = data.groupBy("cell", "vec_id").agg(F.min("away").alias("away"))
    nearest = nearest.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= k + 1)
    nearest = nearest.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("away", "vec_id"))).where(F.col("r") <= k + 1)
    cells = {r["cell"]: r for r in summary.collect()}  # one row per pivot
    members = [(r["cell"], r["away"], r["vec_id"]) for r in nearest.select("cell", "away", "vec_id").collect()]  # k + 1 per pivot
    groups = {r["cell"]: r for r in queries.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect()}
    if not groups:
        return spark.createDataFrame([], schema)

    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(2), 0))
    slack = 1e-6 * (1 + np.sqrt(most))
    routes = []
    for group, asked in groups.items():
        # Of k + 1 different ids one at most is the query's own, in however many rows.
        ways: dict[int, float] = {}
        for way, vec_id in sorted((asked["far"] + apart[group, cell] + away, vec_id) for cell, away, vec_id in members):
            ways.setdefault(vec_id, way)
        bound = list(ways.values())[k] if len(ways) > k else float("inf")
        slices = max(1, -(-asked["n"] // query_block))
        for cell, held in cells.items():
            least = apart[group, cell] - asked["far"] - bound - slack
            most_away = bound + asked["far"] + apart[group, cell] + slack
            if held["far"] >= least and held["close"] <= most_away:
                blocks = max(1, -(-held["n"] // block))
                routes.append((cell, group, float(least), float(most_away), int(blocks), int(slices)))
    routed = spark.createDataFrame(routes, "cell int, target int, least double, most double, blocks int, slices int")
    # pivots x pivots routes at most.
    sent = data.join(F.broadcast(routed), "cell").where(F.col("away").between(F.col("least"), F.col("most")))
    row = ["vec_id", "v", "asked"]
    slice_ = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    sent = sent.select("target", "cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), slice_, *row)
    own_slice = F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int").alias("slice")
    asks = queries.withColumnRenamed("cell", "target").join(F.broadcast(routed), "target").select(
        "target", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own_slice, *row
    )
    found = sent.union(asks).groupBy("target", "cell", "block", "slice").applyInArrow(
        _solved(k), "query_id long, vec_id long, score long"
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
