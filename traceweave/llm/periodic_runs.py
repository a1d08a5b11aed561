"""Periodic runs of words by seed and extend along diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(`SHORTEST`, `REPEATS` * q) words that no
neighbouring word extends. Words i and i + q are then equal on a diagonal of at least max(5, 3q) places. Lags are
handled by octaves [2^t, 2^(t+1)):

1. Seeds are k-grams, k the least diagonal an octave guarantees: 5 for lag 1, else 3 * 2^t. Since k >= q, a k-gram
   inside a run with smallest period q comes back after exactly q words, so pairs of *consecutive* occurrences in one
   text are enough: one seed per place and octave at most, never all pairs. A k-gram that occurs once in its text has
   no longer repeated one, so an octave looks at the repeated places of the octave below only.
2. A seed whose lag lies in the octave is extended along its diagonal, word by word, to both sides. A table holds, per
   lag, how far it is covered; seeds inside that stretch are not extended again.
3. A diagonal from a to b with lag q is the stretch [a, b + q). Seeds start at the smallest period, and a stretch has
   that of any window in it of two periods, so it is a run if it is long enough.

Texts of a batch are worked on together: their words lie in one array, and k-grams over two texts are left out. Words are
compared by 64-bit hashes of their bytes.

Defined cases: null and empty texts have no words and no run; texts below `SHORTEST` words have no run; a null or
repeated doc_id is a row like any other; other columns are not read. A text of a single word repeated is one run of
period 1. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow
from traceweave.llm.words import MULTIPLIER, SHINGLE_MULTIPLIER, mix, powers, slices, words_of

SHORTEST = 6
REPEATS = 4


def _guaranteed(octave: int) -> int:
    """Places that the diagonal of a run with a lag in [2^octave, 2^(octave + 1)) has at least."""
    lag = 1 << octave
    return max(SHORTEST, REPEATS * lag) - lag


def _gram_hashes(sums: np.ndarray, scale: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place, from running sums of word hash times falling power."""
    return mix((sums[at + k] - sums[at]) * scale[at])


def _seeds(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of consecutive equal k-grams with their lag in the octave, octave by octave."""
    n = len(words)
    base = SHINGLE_MULTIPLIER | np.uint64(1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    # The sum over a k-gram of hash * base^-place, times base^start, does not depend on the start.
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(inverse, n)[:n])))
    scale = powers(base, n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    at, octave = np.arange(n), 0
    while len(at):
        k, lag = _guaranteed(octave), 1 << octave
        at = at[at + k <= end[at]]
        key = _gram_hashes(sums, scale, at, k) + mix(text[at].astype(np.uint64) * MULTIPLIER + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        step = at[1:] - at[:-1]
        hit = same & (step >= lag) & (step < 2 * lag)
        yield at[:-1][hit], step[hit]
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        at = np.sort(at[again])
        octave += 1


def _equal_ahead(words: np.ndarray, i: int, j: int, most: int, way: int) -> int:
    """How many of the next `most` words from i and j on, i and j included, are equal; way 1 or -1."""
    done, size = 0, 64
    while done < most:
        size = min(2 * size, most - done)
        left = words[i + done : i + done + size] if way > 0 else words[i - done - size + 1 : i - done + 1][::-1]
        right = words[j + done : j + done + size] if way > 0 else words[j - done - size + 1 : j - done + 1][::-1]
        odd = left != right
        if odd.any():
            return done + int(odd.argmax())
        done += size
    return done


def runs_of(words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run; `first[d]:first[d + 1]` are the words of text d."""
    found = []
    covered: dict[int, int] = {}
    for places, lags in _seeds(words, first):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        # Seeds side by side on one diagonal are one.
        head = np.ones(len(places), bool)
        head[1:] = (np.diff(places) != 1) | (np.diff(lags) != 0)
        for place, lag in zip(places[head].tolist(), lags[head].tolist(), strict=True):
            if place < covered.get(lag, -1):
                continue
            d = int(np.searchsorted(first, place, "right")) - 1
            low, high = int(first[d]), int(first[d + 1])
            ahead = _equal_ahead(words, place, place + lag, high - place - lag, 1)
            back = _equal_ahead(words, place - 1, place - 1 + lag, place - low, -1)
            covered[lag] = place + ahead
            start, length = place - back, back + ahead + lag
            if length >= max(SHORTEST, REPEATS * lag):
                found.append((d, start - low, length, lag))
        # Lags of later octaves are larger.
        covered.clear()
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"))
        runs: list[list[dict[str, int]]] = [[] for _ in range(len(batch))]
        drop = np.zeros(len(words.starts) + 1, np.int32)
        for d, start, length, period in runs_of(words.hashes, words.first):
            runs[d].append({"start": start, "length": length, "period": period})
            drop[words.first[d] + start + period] += 1
            drop[words.first[d] + start + length] -= 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(words.first)),
                pa.array(runs, _RUNS),
                _joined(words, np.cumsum(drop[:-1]) == 0),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def _joined(words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one blank: each word takes a blank with it, a text's last one does not."""
    starts, ends = words.starts[keep], words.ends[keep]
    behind = np.concatenate(([0], np.cumsum(keep)))[words.first]
    lengths = ends - starts + 1
    last = behind[1:][np.diff(behind) > 0] - 1
    lengths[last] -= 1
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    place = np.arange(total) - np.repeat(stops - lengths, lengths)
    out = np.full(total, 0x20, np.uint8)
    inside = place < np.repeat(ends - starts, lengths)
    out[inside] = words.data[(place + np.repeat(starts, lengths))[inside]]
    offsets = np.concatenate(([0], stops))[behind].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the text without what its runs repeat.

    A word is left out of `collapsed` if a run holds it behind that run's first period; words are joined by one blank.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(texts, _found, SCHEMA)
