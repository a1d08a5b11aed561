"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest: one row per distinct text with the row that stays and the number
of copies seen. `DigestIndex.add` reduces new rows to one per digest, keeps those that the index lacks by a sort-merge
anti-join on the buckets (the index side needs no shuffle), and appends them. Only DataFrame operations are used.

Defined cases: a null text counts as empty; texts are equal when identical without any change; of equal texts the row
with the largest doc_id stays (a null doc_id stays only if there is no other); rows repeating that doc_id with the
same text stay together; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceweave.llm.common import stored

BUCKETS = 64


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


class DigestIndex:
    """A digest table in the session's warehouse; give the same name again to go on with an earlier index."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def rows(self) -> DataFrame:
        """digest (32 bytes), keep_id, group_size."""
        return self.spark.table(self.name)

    def fresh(self, docs: DataFrame) -> DataFrame:
        """One row per text that the index lacks: digest, keep_id, group_size within `docs`."""
        found = (
            digests(docs)
            .groupBy(F.unhex("text_sha256").alias("digest"))
            .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        )
        return found.join(self.rows().hint("merge"), "digest", "left_anti")

    def add(self, docs: DataFrame) -> None:
        """Append the texts that are new, a file per bucket."""
        # Dealt by bucket number, whatever the number of partitions is: no bucket is written by several tasks.
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        (
            self.fresh(docs)
            .repartition(self.buckets, bucket)
            .write.mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .saveAsTable(self.name)
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The texts are in the index afterwards."""
    index = index or DigestIndex(docs.sparkSession)
    index.add(docs)
    # Every row meets its text's entry. This join is on a computed key: both sides are shuffled, so that adaptive
    # execution can split a text that a third of all rows hold; on the buckets it would be one task's work.
    held = index.rows().withColumn("text_sha256", F.lower(F.hex("digest")))
    return digests(docs).join(held, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one row per text that the index did not hold before.

    Rows that repeat the doc_id and the text of the row that stays are copies like others; one of them is kept.
    """
    index = index or DigestIndex(docs.sparkSession)
    # With an index that holds earlier data, only texts that are new to it may stay.
    fresh = stored(index.fresh(docs).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep")), "exact-fresh")
    index.add(docs)
    # Digest and id together are the key, so the copies of one text are spread by their ids.
    least = F.lit(-(2**63)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(c).cast("string") for c in docs.columns if c != "text"])
    own = docs.withColumn("__digest", F.unhex(F.sha2(text, 256))).withColumn(
        "__keep", F.coalesce(F.col("doc_id").cast("long"), least)
    )
    first = F.row_number().over(Window.partitionBy("__digest", "__keep").orderBy(row))
    stays = own.join(fresh.withColumn("__keep", F.coalesce("__keep", least)), ["__digest", "__keep"])
    return stays.withColumn("__first", first).where(F.col("__first") == 1).select(*docs.columns)
