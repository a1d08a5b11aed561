"""Parameter vectors: weighted averaging, norms and update statistics.

Vectors are rows of (round, client, tensor, values).  Element-wise work explodes
positions, so a round with very many clients or very long tensors spreads over
(tensor, position) keys and merges map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X


def weighted_elements(
    updates: DataFrame, keys: Sequence[str], vector: str, examples: str, integer: Column | None = None
) -> DataFrame:
    """Example-weighted mean of every vector position; weights are at least 1.

    Vectors of one key must have equal length, otherwise the query fails.
    Integer tensors are rounded half-even.
    """
    weight = F.greatest(F.col(examples).cast("double"), F.lit(1.0))
    values = updates.select(
        *keys, weight.alias("_w"), F.size(vector).alias("_len"), F.posexplode(vector).alias("position", "_x"),
        *( [integer.alias("_int")] if integer is not None else [] ),
    )
    total = F.sum("_w")
    mean = F.sum(F.col("_w") * F.col("_x").cast("double")) / total
    checked = F.when(
        F.min("_len") == F.max("_len"), F.when(F.max("_int"), F.rint(mean)).otherwise(mean) if integer is not None else mean
    ).otherwise(F.raise_error(F.lit("updates of one tensor differ in length")).cast("double"))
    return values.groupBy(*keys, "position").agg(checked.alias("value"), total.alias("total_weight"), F.count(F.lit(1)).alias("clients"))


def assemble_vectors(elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back to one array per key; its length is the tensor's, not the client count."""
    packed = F.array_sort(F.collect_list(F.struct("position", "value")))
    return elements.groupBy(*keys).agg(F.transform(packed, lambda e: e["value"]).alias("values"))


def vector_norms(df: DataFrame, keys: Sequence[str], left: str, right: str | None = None) -> DataFrame:
    """L2 norm over all tensors of a key, of the values or of left minus right."""
    a = F.col(left)
    squares = (
        F.transform(a, lambda x: x.cast("double") * x.cast("double"))
        if right is None
        else F.zip_with(a, F.col(right), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )
    part = X.array_sum(squares)
    if right is not None:
        part = F.when(F.size(left) == F.size(right), part).otherwise(
            F.raise_error(F.lit("tensors differ in shape")).cast("double")
        )
    return df.groupBy(*keys).agg(F.sqrt(F.greatest(F.sum(part), F.lit(0.0))).alias("l2_norm"))


def update_statistics(updates: DataFrame, keys: Sequence[str], norm: str, examples: str, size: str) -> DataFrame:
    """Per round: clients, mean and spread of finite norms, example and byte totals."""
    value = X.finite(F.col(norm))
    return updates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clients_received"),
        F.avg(value).alias("update_norm_mean"),
        F.stddev_pop(value).alias("update_norm_std"),
        F.sum(F.greatest(F.col(examples), F.lit(1))).alias("examples_total"),
        F.sum(size).alias("bytes_total"),
    )
