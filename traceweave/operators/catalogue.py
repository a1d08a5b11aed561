"""Model and dataset catalogue operators over map/array dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applications_and_datasets(catalogue: DataFrame) -> DataFrame:
    """One row per (variant, application, dataset) of ``datasets_by_application``."""
    return catalogue.select(
        "variant", F.explode("datasets_by_application").alias("application", "datasets")
    ).select("variant", "application", F.explode("datasets").alias("dataset"))


def execution_flags(catalogue: DataFrame, framework: str) -> DataFrame:
    """Whether a variant runs natively in a framework or only from an artifact."""
    native = F.array_contains("frameworks", framework)
    return catalogue.select(
        "family",
        "architecture",
        "variant",
        F.lit(framework).alias("framework"),
        native.cast("int").alias("native"),
        (~native).cast("int").alias("artifact_only"),
    )


def datasets_within(datasets: DataFrame, application: str, tiers: Sequence[str], largest: str) -> DataFrame:
    """Datasets of an application no larger than a size tier (tiers small to large)."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("size_tier"))
    return datasets.where(
        F.array_contains("applications", application) & (rank > 0) & (rank <= list(tiers).index(largest) + 1)
    )


def upgraded_labels(df: DataFrame, architecture: str, parents: DataFrame) -> DataFrame:
    """Old variant names used as architecture: look up (architecture, variant).

    ``parents``: old_name, architecture, variant — a small dimension Spark
    broadcasts by itself when its measured size allows.
    """
    dim = parents.select(
        F.col("old_name").alias(architecture),
        F.col("architecture").alias("upgraded_architecture"),
        F.col("variant").alias("upgraded_variant"),
    )
    return df.join(dim, architecture, "left")
