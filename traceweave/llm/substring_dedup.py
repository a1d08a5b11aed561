"""Substring dedup by relative Lempel-Ziv factors against an index of reference blocks.

A window is `window` consecutive words of one text. `duplicate_factors` finds, for every document, the stretches of
words that also occur in a document with a smaller doc_id:

1. Every window has a seed: the `SEED_WORDS`-word shingle with the least hash in it. Equal windows have equal seeds,
   so a window that occurs in two texts has a seed that occurs in both. Seeds are about a fifth of all places; a
   grouped minimum and maximum of the text's key (combined before the shuffle) keeps the shared ones.
2. Only windows at shared seeds enter the reference index: window hash -> first occurrence (smallest doc_id, then
   place). The index is dealt into blocks by window hash; each document is looked up in every block that holds one
   of its windows (a join on the hash).
3. Each document is parsed greedily from left to right: a factor starts at a word whose window is in the index under
   a smaller doc_id and goes on as long as the following windows stand in the same reference text right behind each
   other. Where it ends, the windows across its boundary have been looked up too and may start the next factor, which
   then overlaps this one. Other words are literals. A factor of m windows is m + window - 1 words long, so each
   factor is long enough to be a duplicate span.

Windows are judged on the input, so removing a passage in one document never brings it back in another. Hashes are
64-bit hashes of the words' bytes.

Defined cases: null and empty texts have no words; texts below `window` words lose nothing; rows with a null doc_id
are no reference and lose nothing; rows repeating a doc_id lose nothing to each other, and one of them may be a copy without the others. Texts that are equal byte for
byte need no window: later copies lose all their words if they have a window at all. Other columns are kept by
`remove_factors` and not read by `duplicate_factors`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from traceweave.llm.common import in_arrow, stored
from traceweave.llm.words import Words, mix, shingle_hashes, slices, windows_inside, words_of

WINDOW = 13
SEED_WORDS = 5


def _seeded(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, each one's seed hash, and each one's text number."""
    grams = shingle_hashes(words.hashes, SEED_WORDS)
    n = len(words.starts) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(windows_inside(words.first, n, window))
    # The least hash of each run of shingles, by doubling: minima of 1, 2, 4 ... neighbours, then two that overlap.
    span, low = 1, mix(grams ^ np.uint64(11))
    while 2 * span <= window - SEED_WORDS + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = window - SEED_WORDS + 1 - span
    least = np.minimum(low[:n], low[rest : rest + n])
    text = np.searchsorted(words.first, at, "right") - 1
    return at, least[at], text


def _seeds(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys = batch.column("key").to_numpy()
            _, seeds, text = _seeded(words_of(batch.column("text")), window)
            if len(seeds) == 0:
                continue
            order = np.lexsort((seeds, text))
            seeds, text = seeds[order], text[order]
            new = np.concatenate(([True], (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds[new].view(np.int64)), pa.array(keys[text[new]])], names=["seed", "key"]
            )

    return run


def _windows(window: int):
    """Windows at the shared seeds of each document: (hash, doc_id, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pc.is_valid(batch.column("__seeds")))
            if len(batch) == 0:
                continue
            ids = batch.column("doc_id").to_numpy()
            words = words_of(batch.column("text"))
            at, seeds, text = _seeded(words, window)
            hashes = shingle_hashes(words.hashes, window)
            shared, edges = _lists(batch.column("__seeds"))
            # Text number and seed together, so that one search serves the whole batch.
            owner = np.repeat(np.arange(len(batch), dtype=np.uint64), np.diff(edges))
            wanted = np.unique(mix(shared.view(np.uint64)) + mix(owner + np.uint64(1)))
            held = mix(seeds) + mix(text.astype(np.uint64) + np.uint64(1))
            hit = _member(held, wanted)
            at, text = at[hit], text[hit]
            # A window that a text repeats is looked up once; its first place stands for all.
            key = mix(hashes[at]) + mix(text.astype(np.uint64) + np.uint64(1))
            first = np.sort(np.unique(key, return_index=True)[1])
            at, text = at[first], text[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[at].view(np.int64)),
                    pa.array(ids[text]),
                    pa.array((at - words.first[text]).astype(np.int32)),
                ],
                names=["hash", "doc_id", "place"],
            )

    return run


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if len(wanted) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the n + 1 offsets of a list column."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("string"), 256))


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of texts that are byte-for-byte copies of a text with a smaller doc_id."""
    digests = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")
    )
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return digests.join(first.where("first_id < last_id"), "digest").where("first_id < doc_id").select("doc_id", "digest")


def duplicate_factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __factors, __copy): each document's windows that stand in earlier ones, as (hash, source_id, source_place).

    `__copy` has the digests of those of a document's texts that are copies of an earlier one.
    """
    copies = stored(_copies(docs), "sub-copies").groupBy("doc_id").agg(F.collect_set("digest").alias("__copy"))
    copies = copies.withColumnRenamed("doc_id", "__id")
    ids, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    # A text by 64 bits of its digest: copies bring no seed that their first holder lacks, and no text moves for that.
    key = F.xxhash64(_digest()).alias("key")
    own = docs.select(ids, text, key).where(F.col("doc_id").isNotNull())
    seeds = stored(in_arrow(own.select("key", "text"), _seeds(window), "seed long, key long"), "sub-seeds")
    spread = seeds.groupBy("seed").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = spread.where("low < high").select("seed")
    holders = own.groupBy("key").agg(F.min("doc_id").alias("__id"))
    wanted = seeds.join(shared, "seed").distinct().join(holders, "key").groupBy("__id").agg(F.collect_set("seed").alias("__seeds"))
    # Without the texts this is small, so it is kept, and the shuffles of both steps go as soon as they have ended.
    windows = stored(
        in_arrow(
            docs.join(wanted, F.col("doc_id") == F.col("__id")).select(ids, text, "__seeds"),
            _windows(window),
            "hash long, doc_id long, place int",
        ),
        "sub-windows",
    )
    index = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("source"), F.max("doc_id").alias("last"))
    index = index.where(F.col("source.doc_id") < F.col("last")).select("hash", "source")
    looked = windows.join(index, "hash").where(F.col("source.doc_id") < F.col("doc_id"))
    factors = looked.groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_list(
            F.struct("hash", F.col("source.doc_id").alias("source_id"), F.col("source.place").alias("source_place"))
        ).alias("__factors")
    )
    return stored(factors.join(copies, "__id", "full"), "sub-factors")


def _parse(hashes: np.ndarray, found: dict, window: int) -> list[tuple[int, int]]:
    """Greedy factors (start word, words) of one text from its window hashes and what the index holds of them."""
    factors: list[tuple[int, int]] = []
    start, want = -1, None
    for place, value in enumerate(hashes.tolist()):
        source = found.get(value)
        if source is None or source != want:
            if start >= 0:
                factors.append((start, place - start + window - 1))
            start = -1 if source is None else place
        want = None if source is None else (source[0], source[1] + 1)
    if start >= 0:
        factors.append((start, len(hashes) - start + window - 1))
    return factors


def _text_digest(text: pa.Scalar) -> bytes:
    return hashlib.sha256(text.as_buffer()).digest()


def _removed(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"))
            hashes = shingle_hashes(words.hashes, window).view(np.int64)
            copies = batch.column("__copy")
            held = batch.column("__factors")
            total, gone, texts, parsed = [], [], [], []
            for i in range(len(batch)):
                a, b = int(words.first[i]), int(words.first[i + 1])
                n = b - a
                factors: list[tuple[int, int]] = []
                if n >= window and copies[i].is_valid and _text_digest(batch.column("text")[i]) in copies[i].as_py():
                    factors = [(0, n)]
                elif held[i].is_valid and n >= window:
                    items = held[i].values
                    found = dict(
                        zip(
                            items.field("hash").to_pylist(),
                            zip(
                                items.field("source_id").to_pylist(),
                                items.field("source_place").to_pylist(),
                                strict=True,
                            ),
                            strict=True,
                        )
                    )
                    factors = _parse(hashes[a : b - window + 1], found, window)
                drop = np.zeros(n + 1, np.int32)
                for start, length in factors:
                    drop[start] += 1
                    drop[start + length] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                starts, ends = words.starts[a:b][keep].tolist(), words.ends[a:b][keep].tolist()
                raw = words.data
                texts.append(b" ".join([raw[x:y].tobytes() for x, y in zip(starts, ends, strict=True)]))
                total.append(n)
                gone.append(n - len(starts))
                parsed.append([{"start": x, "words": y} for x, y in factors])
            digests = [hashlib.sha256(x).hexdigest() for x in texts]
            out = {
                "n_words": pa.array(total, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "__removed": pa.array(gone, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "factors": pa.array(parsed, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))),
            }
            for name in {"kept_text", "__kept"}.intersection(names):
                out[name] = pa.array([x.decode() for x in texts], pa.string())
            # Columns of the input keep their values, whatever their names.
            given = {n for n in names if n in batch.schema.names}
            yield pa.RecordBatch.from_arrays([batch.column(n) if n in given else out[n] for n in names], names=names)

    return run


def _joined(docs: DataFrame, factors: DataFrame) -> DataFrame:
    return docs.join(factors, F.col("doc_id") == F.col("__id"), "left").withColumn("text", F.col("text").cast("string"))


def remove_factors(docs: DataFrame, factors: DataFrame, window: int = WINDOW, show: tuple[str, ...] = ("kept_text",)) -> DataFrame:
    """doc_id and, per row of docs: n_words, n_removed, kept_sha256, and any of kept_text and factors named in `show`."""
    kinds = {"kept_text": "string", "factors": "array<struct<start:int,words:int>>"}
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *show]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema += "".join(f", {n} {kinds[n]}" for n in show)
    rows = _joined(docs, factors).withColumn("doc_id", F.col("doc_id").cast("long"))
    return in_arrow(rows.select("doc_id", "text", "__factors", "__copy"), _removed(window, names), schema)


def without_factors(docs: DataFrame, factors: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of docs; texts that lose words are their kept words joined by one blank, others are as before."""
    names = [*docs.columns, "__removed", "__kept"]
    schema = StructType([*docs.schema.fields, StructField("__removed", LongType()), StructField("__kept", StringType())])
    schema["text"].dataType = StringType()
    rows = in_arrow(_joined(docs, factors).drop("__id"), _removed(window, names), schema)
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
