"""White-space words of whole Arrow text columns as numpy arrays: bounds, 64-bit hashes, shingle hashes.

Null texts have no words. Nothing is cut: a word of a megabyte is one word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEED = 20240607
MULTIPLIER = np.uint64(0x9E3779B97F4A7C13)
SHINGLE_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_VALUES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that what is derived per byte stays small."""
    for batch in batches:
        at, sizes = 0, np.diff(text_bytes(batch.column(column))[1])
        ends = np.cumsum(sizes)
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span [start, end); spans are disjoint, ascending and not empty, data under 2 GB."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    place = np.arange(total, dtype=np.int32) - np.repeat(firsts.astype(np.int32), lengths)
    if total == len(data):
        picked = data  # the spans lie side by side
    else:
        picked = data[place + np.repeat(starts.astype(np.int32), lengths)]
    values = _BYTE_VALUES.take(picked)
    values *= powers(MULTIPLIER, int(lengths.max())).take(place)
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


@dataclass
class Words:
    """Words of a batch of texts: byte bounds in `data`, their hashes, and `first[d]:first[d + 1]` for text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower and len(data):
        data = _LOWER[data]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k - 1 places have none. Windows over two texts are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, power in enumerate(powers(SHINGLE_MULTIPLIER, k)):
        total += hashes[j : j + n] * power
    return mix(total)


def windows_inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n window starts lie in one text whole."""
    good = np.ones(n, bool)
    for back in range(1, k):
        at = first[1:-1] - back
        good[at[(at >= 0) & (at < n)]] = False
    return good
