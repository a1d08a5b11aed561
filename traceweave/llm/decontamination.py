"""Benchmark decontamination by an Aho-Corasick automaton over normalised benchmark texts.

1. Texts are normalised alike on both sides: A-Z become a-z, and every other ASCII sign that is neither a letter nor a
   digit becomes a blank; words are what stands between blanks. Signs beyond ASCII belong to words.
2. Each run of `window` words of a benchmark item (all its words, if it has fewer) is a pattern " w1 w2 ... ", blanks at
   both ends, so that it matches whole words only. All patterns go into one automaton.
3. A slice of documents is normalised into one string, two blanks apart, and the automaton reads that string once. Ends
   of matches become word numbers and, by the places that normalising kept, offsets in the original text.

The benchmark is cut into parts of at most `PART` windows, the parts into blocks whose patterns have at most
`BLOCK_BYTES` bytes: that bounds an automaton (about 40 bytes a pattern byte). A benchmark of more than one block has
one automaton for each, built one at a time for every `LONG_SLICE` bytes of documents. Blocks are broadcast in groups
of at most `GROUP_BYTES`; each group is one pass over the documents, and the passes of a larger benchmark are chained,
so nothing that is sent or held grows with the benchmark, and no document is shuffled.

Defined cases: null and empty texts have no words and no hits, as documents and as items; items without an id take no
part; rows that repeat an item id are one item with all their windows; equal rows count once; a null or repeated doc_id is
a row like any other; columns that are not named here are not read. An empty benchmark hits nothing; an empty table gives an
empty result. Ties do not arise: a word is hit or not, and items are a set, sorted as strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow
from traceweave.llm.words import slices, text_bytes

WINDOW = 10
#: Windows of an item that go into one part.
PART = 5_000
#: Pattern bytes of one automaton.
BLOCK_BYTES = 4 << 20
#: Bytes of normalised benchmark text that one pass broadcasts.
GROUP_BYTES = 64 << 20
#: Bytes of documents that share one automaton at a time, and that are read at once.
LONG_SLICE, SLICE = 32 << 20, 2 << 20

BLANK = 0x20


def _normal_bytes() -> bytes:
    table = bytearray([BLANK]) * 256
    for low, high, to in ((0x30, 0x39, 0x30), (0x61, 0x7A, 0x61), (0x41, 0x5A, 0x61), (0x80, 0xFF, 0x80)):
        for byte in range(low, high + 1):
            table[byte] = to + byte - low
    return bytes(table)


NORMAL = _normal_bytes()
_NORMAL = np.frombuffer(NORMAL, np.uint8)


def _parts(window: int):
    """Benchmark rows as (item, words of one part joined by a blank, windows in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().translate(NORMAL).split() if text.is_valid else []
                starts = max(len(words) - window + 1, min(len(words), 1))
                own = [words[at : min(at + PART, starts) + window - 1] for at in range(0, starts, PART)]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(own)), pa.array([b" ".join(x).decode() for x in own])], names=["item", "words"]
                    )

    return run


def _blocks(parts: Iterator, window: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """Parts, each with the items that hold it, in blocks of about BLOCK_BYTES bytes of patterns."""
    block, held = [], 0
    for row in parts:
        words = row["words"].encode()
        size = window * (len(words) + 2) + sum(map(len, row["items"]))
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((words, row["items"]))
        held += size
    if block:
        yield block


class Automaton:
    """The patterns of one block; values are numbers of pattern (words in it, items that hold it)."""

    def __init__(self, block: list[tuple[bytes, list[str]]], window: int):
        import ahocorasick

        self.items: list[set[str]] = []
        self.machine = ahocorasick.Automaton()
        sizes = []
        for text, items in block:
            words = text.split(b" ")
            for at in range(max(len(words) - window + 1, 1)):
                # One character per byte: an exact match of bytes, and no wide characters.
                pattern = (b" " + b" ".join(words[at : at + window]) + b" ").decode("latin-1")
                number = self.machine.get(pattern, None)
                if number is None:
                    self.machine.add_word(pattern, len(self.items))
                    self.items.append(set(items))
                    sizes.append(min(window, len(words)))
                else:
                    self.items[number].update(items)
        self.sizes = np.array(sizes, np.int64)
        self.machine.make_automaton()

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Place behind each match (before its last blank), and the pattern's number."""
        found = np.fromiter((x for pair in self.machine.iter(text) for x in pair), np.int64)
        return found[0::2], found[1::2]


@dataclass
class Normalised:
    """A slice of texts as one string; words by number, with their bounds in the original bytes of the slice."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    words_before: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def normalised(column: pa.Array) -> Normalised:
    data, offsets = text_bytes(column)
    # Two blanks around every text: runs of blanks are then cut to one within texts only.
    wide = np.insert(_NORMAL[data], np.repeat(offsets, 2), BLANK)
    word = wide != BLANK
    edge = np.zeros(len(wide), bool)
    edge[(offsets[:, None] + 2 * np.arange(len(offsets))[:, None] + np.arange(2)).ravel()] = True
    original = np.empty(len(wide), np.int64)
    original[~edge] = np.arange(len(data))
    original[edge] = np.repeat(offsets, 2)
    keep = word | edge
    keep[1:] |= word[:-1] & ~word[1:]
    kept = wide[keep]
    begins = word & ~np.concatenate(([False], word[:-1]))
    stops = np.concatenate((word[1:], [False])) < word
    starts, ends = original[begins], original[stops] + 1
    return Normalised(
        kept.tobytes().decode("latin-1"),
        starts,
        ends,
        np.cumsum(begins[keep]),
        np.searchsorted(starts, offsets),
        data,
        offsets,
    )


def _hits(part: Normalised, automaton: Automaton, hit: np.ndarray, items: dict[int, set[str]]) -> None:
    """Mark the words inside matches (+1 at the first, -1 behind the last) and collect the items of each text."""
    ends, numbers = automaton.matches(part.text)
    if len(ends) == 0:
        return
    last = part.words_before[ends - 1]
    np.add.at(hit, last - automaton.sizes[numbers], 1)
    np.add.at(hit, last, -1)
    text = np.searchsorted(part.first, last - 1, "right") - 1
    many = len(automaton.items)
    for pair in np.unique(text * many + numbers).tolist():
        items.setdefault(pair // many, set()).update(automaton.items[pair % many])


def _char_spans(part: Normalised, i: int, words: np.ndarray) -> list[dict[str, int]]:
    """Stretches of hit words of text i as offsets in its code points."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], words.astype(np.int8), [0]))))
    first = part.first[i]
    base = part.offsets[i]
    chars = np.concatenate(([0], np.cumsum((part.data[base : part.offsets[i + 1]] & 0xC0) != 0x80)))
    return [
        {"start": int(chars[part.starts[first + a] - base]), "end": int(chars[part.ends[first + b - 1] - base])}
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)
    ]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))
_SCHEMA = (
    "doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, "
    "hit_words array<struct<first:int,behind:int>>"
)
_BUILT: dict[str, Automaton] = {}


def _automaton(block, window: int) -> Automaton:
    """A block's automaton; the worker keeps the last one only."""
    if block.id not in _BUILT:
        _BUILT.clear()
        _BUILT[block.id] = Automaton(block.value, window)
    return _BUILT[block.id]


@dataclass(frozen=True)
class _Block:
    id: str
    held: object

    @property
    def value(self):
        return self.held.value


def _scan(blocks: list[_Block], window: int, more: bool):
    """One pass: what earlier passes found is kept. `more`: another pass will need the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in slices(batches, "text", LONG_SLICE if len(blocks) > 1 else SLICE):
            some = list(slices([many], "text", SLICE))
            parts = [normalised(x.column("text")) for x in some]
            hits = [_earlier(batch, part) for batch, part in zip(some, parts, strict=True)]
            items: list[dict[int, set[str]]] = [{} for _ in some]
            for block in blocks:
                automaton = _automaton(block, window)
                for part, hit, own in zip(parts, hits, items, strict=True):
                    _hits(part, automaton, hit, own)
            for batch, part, hit, own in zip(some, parts, hits, items, strict=True):
                yield _result(batch, part, np.cumsum(hit[:-1]) > 0, own, more)

    return run


def _earlier(batch: pa.RecordBatch, part: Normalised) -> np.ndarray:
    hit = np.zeros(len(part.starts) + 1, np.int32)
    for i, ranges in enumerate(batch.column("hit_words").to_pylist()):
        for r in ranges or ():
            hit[part.first[i] + r["first"]] += 1
            hit[part.first[i] + r["behind"]] -= 1
    return hit


def _result(batch: pa.RecordBatch, part: Normalised, hit: np.ndarray, items: dict, more: bool) -> pa.RecordBatch:
    spans, ranges, found = [], [], []
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[part.first[1:]] - sums[part.first[:-1]]
    before = batch.column("items").to_pylist()
    for i, n in enumerate(n_hit.tolist()):
        own = hit[part.first[i] : part.first[i + 1]] if n else hit[:0]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
        ranges.append([{"first": a, "behind": b} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
        spans.append(_char_spans(part, i, own) if n else [])
        found.append(sorted(items.get(i, set()).union(before[i] or ())))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("text") if more else pa.nulls(len(batch), pa.string()),
            pa.array(np.diff(part.first)),
            pa.array(n_hit, pa.int64()),
            pa.array(found, pa.list_(pa.string())),
            pa.array(spans, _SPAN),
            pa.array(ranges, _RANGE),
        ],
        names=["doc_id", "text", "n_words", "n_hit", "items", "spans", "hit_words"],
    )


def _groups(benchmark: DataFrame, window: int) -> Iterator[list[_Block]]:
    """Broadcast blocks, at least one group; the driver reads one group's parts at a time."""
    context = benchmark.sparkSession.sparkContext
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    parts = in_arrow(texts.where("item IS NOT NULL"), _parts(window), "item string, words string").distinct()
    # A passage that many items share is one part with slices of their ids.
    dealt = parts.groupBy("words", F.pmod(F.xxhash64("item"), F.lit(64)).alias("slice"))
    parts = dealt.agg(F.sort_array(F.collect_list("item")).alias("items")).orderBy("words", "slice")
    group, held, number, call = [], 0, 0, uuid.uuid4().hex
    for block in _blocks(parts.toLocalIterator(prefetchPartitions=False), window):
        size = sum(len(words) + sum(map(len, items)) for words, items in block)
        if group and held + size > GROUP_BYTES:
            yield group
            group, held = [], 0
        group.append(_Block(f"{call}-{number}", context.broadcast(block)))
        held, number = held + size, number + 1
    yield group


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, hit_words.

    `items` are the ids, as sorted strings, of the benchmark items that have a window in the text. `spans` are the hit
    stretches as code point offsets in the original text, `hit_words` as word numbers.
    """
    groups = list(_groups(benchmark, window))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<struct<first:int,behind:int>>").alias("hit_words"),
    )
    for at, group in enumerate(groups):
        found = in_arrow(found, _scan(group, window, at + 1 < len(groups)), _SCHEMA)
    return found.drop("text")

