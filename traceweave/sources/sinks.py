"""Writers: packet tables, X/Y datasets, partition folders, atomic publishing."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays as ``;`` joined text, so that a CSV can hold them."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns(
        {a: F.concat_ws(";", F.transform(F.col(a), lambda v: v.cast("string"))) for a in arrays}
    )


def write_csv(df: DataFrame, folder: str) -> None:
    flat(df).write.mode("overwrite").option("header", "true").csv(folder)


def write_packets(df: DataFrame, folder: str, by: str = "experiment_id") -> None:
    """Packets as parquet, one folder per run, so that run filters prune files."""
    df.write.mode("overwrite").partitionBy(by).parquet(folder)


def write_dataset(x: DataFrame, y: DataFrame, predictors: Sequence[str], folder: str) -> None:
    """X, Y and a small JSON that declares predictor, metadata and label columns."""
    x.write.mode("overwrite").parquet(f"{folder}/x")
    y.write.mode("overwrite").parquet(f"{folder}/y")
    declared = {
        "predictors": list(predictors),
        "metadata": [c for c in x.columns if c not in predictors],
        "labels": [c for c in y.columns if c not in x.columns],
    }
    write_text(x.sparkSession, f"{folder}/schema.json", json.dumps(declared, indent=2))


def write_by_partition(df: DataFrame, token: str, folder: str) -> None:
    """Rows below ``partition_token=...``; other tokens in the folder stay."""
    (
        df.withColumn("partition_token", F.lit(token))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("partition_token")
        .parquet(folder)
    )


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path, fs = _path(spark, name)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def publish(
    df: DataFrame,
    folder: str,
    check: Callable[[DataFrame], Sequence[str]],
    keep_backup: bool = True,
) -> str | None:
    """Write to a staging folder, check what was written, then move it into place.

    Problems found by ``check`` leave the old data as it is and raise.  Returns
    the backup folder of replaced data.
    """
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}.staging"
    df.write.mode("overwrite").parquet(staging)
    problems = list(check(spark.read.parquet(staging)))
    if problems:
        raise ValueError(f"not published: {problems}")
    target, fs = _path(spark, folder)
    source, _ = _path(spark, staging)
    backup = None
    if fs.exists(target):
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        backup = f"{folder.rstrip('/')}.backup_{stamp}"
        if not fs.rename(target, _path(spark, backup)[0]):
            raise OSError(f"cannot set {folder} aside")
    if not fs.rename(source, target):
        if backup:
            fs.rename(_path(spark, backup)[0], target)
        raise OSError(f"cannot publish {folder}")
    if backup and not keep_backup:
        fs.delete(_path(spark, backup)[0], True)
        backup = None
    return backup
