"""The corpus pipeline: language id, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`.

Defined cases, stage by stage: a null or empty text, or one without a letter, goes at the first stage, as do noise and
languages that no labelled row has; without any labelled row everything goes. Rows with a null doc_id are judged like
others: of equal texts they stay only if no row has an id, they are near to nothing, lose no passage and are packed.
Rows that repeat a doc_id are rows of their own; where one of them is a near copy to be dropped, all rows of that id go,
and none loses a passage to another of the same id. Of ties, the larger doc_id stays among equal texts and the smaller
one among near ones. Very long texts are worked on whole. Columns beyond those of `documents` are carried to the last
stage under their own names, whatever these are. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceweave.llm import exact_dedup, language_id, near_dedup, packing, substring_dedup
from traceweave.llm.common import stored, table

#: Stages hold models and hashed neighbours, which SQL does not express; they are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: no letter, or too many subwords that no learned language has."""
    return language_id.accepted(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of texts that are equal, the row with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of at least 0.8 on five-word shingles."""
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(dropped.distinct(), F.col("doc_id") == F.col("__id"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in a document with a smaller doc_id; n_chars follows the new text."""
    cut = substring_dedup.without_factors(docs, substring_dedup.duplicate_factors(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 1,024."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
