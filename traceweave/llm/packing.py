"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Every text becomes token ids plus an end id; texts above `capacity` are cut into pieces of `capacity` tokens, the
   first piece taking what is left over.
2. The lengths are counted: at most `capacity` rows, however large the table is. `plan` packs the counts: from long
   to short, the pieces of one length go into the open sequences with the tightest room, many at a time. Sequences
   filled alike are one group, so the plan's size depends on the capacity only.
3. Each piece gets a gapless rank within its length (two-step numbering, so a very common length is numbered by many
   tasks) and takes the planned slot that holds its rank.

Defined cases: a null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows are
packed each (their pieces differ in sequence or offset only); other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow, ranked, stored
from traceweave.llm.token_counts import SPECIAL, split_special
from traceweave.llm.transducer import Pieces, pieces_of
from traceweave.llm.words import slices

CAPACITY = 1024
END_ID = 2
#: Bytes that a worker spends on remembered pieces (hash, place and ids of each), about.
KNOWN_BYTES = 96 << 20
_KNOWN: dict[str, "Known"] = {}


def _byte_signs() -> dict[str, int]:
    """The byte of each sign of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str):
    """(pieces -> lists of ids, ids of the added tokens) of a tokenizer file.

    A byte-level vocabulary whose merges come in order of the ids they make is plain rank merging, which tiktoken's core
    does five times as fast as tokenizers with the same result; any other file is left to tokenizers.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, added = content["model"], {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    signs = _byte_signs()
    vocabulary = {t: i for t, i in model.get("vocab", {}).items() if t not in added} if model.get("type") == "BPE" else {}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    made = [vocabulary.get(m, -1) for m in merges]
    plain = vocabulary and made == sorted(set(made)) and len(made) + 256 == len(vocabulary)
    if plain and not any(model.get(o) for o in options) and all(c in signs for t in vocabulary for c in t):
        import tiktoken

        ranks = {bytes(signs[c] for c in t): i for t, i in vocabulary.items()}
        one = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return (lambda pieces: [one(p) for p in pieces]), added
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def by_library(pieces: list[bytes]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    return by_library, added


class Known:
    """The encoder of a tokenizer file, and the ids of the pieces met so far as flat arrays in order of the pieces' hashes."""

    def __init__(self, path: str):
        self.encode, self.special = encoder(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _bytes(self) -> int:
        return 20 * len(self.hashes) + 4 * len(self.ids)

    def learn(self, pieces: Pieces, new: np.ndarray) -> None:
        """Encode the distinct pieces in these rows, which are not held yet."""
        for at in range(0, len(new), 20_000):
            rows = new[at : at + 20_000]
            encoded = self.encode(pieces.bytes_of(rows))
            sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
            ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
            place = np.searchsorted(self.hashes, pieces.hashes[rows])
            self.begins = np.insert(self.begins, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, place, sizes)
            self.hashes = np.insert(self.hashes, place, pieces.hashes[rows])
            self.ids = np.concatenate((self.ids, ids))

    def find(self, pieces: Pieces) -> np.ndarray:
        """The place here of each distinct piece; unknown ones are encoded first."""
        new = self._missing(pieces)
        if len(new) and self._bytes() > KNOWN_BYTES:
            self._forget()
            new = np.arange(len(pieces.hashes))
        self.learn(pieces, new)
        return np.searchsorted(self.hashes, pieces.hashes)

    def _missing(self, pieces: Pieces) -> np.ndarray:
        if not len(self.hashes):
            return np.arange(len(pieces.hashes))
        place = np.minimum(np.searchsorted(self.hashes, pieces.hashes), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[place] != pieces.hashes)


def _library(path: str) -> Known:
    """Once per Python worker."""
    if path not in _KNOWN:
        _KNOWN[path] = Known(path)
    return _KNOWN[path]


def text_ids(path: str, column: pa.Array, special: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a text column one after the other, and the n + 1 offsets of the texts."""
    known = _library(path)
    cut, parts = split_special(column, special)
    pieces = pieces_of(cut)
    place = known.find(pieces)[pieces.code]
    each = known.sizes[place].astype(np.int64)
    ends = np.cumsum(each)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(known.begins[place] - ends + each, each)
    ids, edges = known.ids[at], np.concatenate(([0], ends))[pieces.first]
    last = np.cumsum(parts)
    if len(cut) != len(column):
        # A special string stood before every part but a text's first.
        marks = np.setdiff1d(np.arange(len(cut)), last - parts)
        single = known.special[special[0]]
        ids = np.insert(ids, edges[marks], np.uint32(single))
        edges = edges + np.concatenate(([0], np.cumsum(np.isin(np.arange(len(cut)), marks))))
    return ids, np.concatenate(([0], edges[last]))


def _pieces(path: str, special: tuple[str, ...], capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            ids, edges = text_ids(path, batch.column("text"), special)
            # Every text's ids with its end id behind them, as bytes.
            sizes = np.diff(edges) + 1
            raw = memoryview(np.insert(ids, edges[1:], np.uint32(end_id)).astype("<u4").view(np.uint8))
            # The first piece takes what is left over.
            many = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), many)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            head = (sizes - 1) % capacity + 1
            start = np.where(number > 0, head[owner] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, head[owner])
            begin = 4 * ((np.cumsum(sizes) - sizes)[owner] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, first sequence, offset) by best fit over counted lengths.

    A group is a run of sequences filled alike: (room left, first sequence, number). Groups are kept by room.
    """
    slots, groups, opened = [], [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(groups, (length, -1, -1))
            if at == len(groups):
                # No room anywhere: open sequences, each to be filled with as many of this length as fit.
                per = capacity // length
                groups_new, extra = divmod(left, per)
                for each, number in ((per, groups_new), (extra, 1 if extra else 0)):
                    if number == 0:
                        continue
                    for slot in range(each):
                        slots.append((length, rank, rank + number, opened, slot * length))
                        rank += number
                    insort(groups, (capacity - each * length, opened, number))
                    opened += number
                left = 0
                continue
            room, first, number = groups.pop(at)
            used = min(number, left)
            slots.append((length, rank, rank + used, first, capacity - room))
            rank, left = rank + used, left - used
            insort(groups, (room - length, first, used))
            if used < number:
                insort(groups, (room, first + used, number - used))
    return slots


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    special: tuple[str, ...] = SPECIAL,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stored(in_arrow(texts, _pieces(tokenizer_path, special, capacity, end_id), schema), "pack-pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    slots = pieces.sparkSession.createDataFrame(
        plan(counts, capacity), "length long, rank_from long, rank_to long, sequence_from long, offset long"
    )
    placed = ranked(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start")], "rank")
    # Slots are bounded by the capacity, not by the data.
    return (
        placed.join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
            "offset",
        )
    )
