"""Deterministic transducers over text: one finds the pieces that byte-level BPE splits a text into, one counts tokens.

**Pieces.** `STATES` x `CLASSES` is a Mealy machine for the pattern of the byte-level vocabularies (contractions, an
optional blank before a run of letters, digits or other signs, white-space runs that leave their last sign to what
follows). Where the pattern looks ahead, the machine emits late: its output says whether a piece starts at this sign,
at the sign before, or at both. A text column is cut into chunks of `CHUNK` signs. Each chunk has a map "state
before -> state behind"; there are so few different maps that each is a number, and
composing two is a look-up; a parallel prefix scan composes them (each round joins maps twice as far apart), which gives every chunk its true entry state; then all chunks run once more side by
side and write their output. So a single text of any length is worked on in parallel, and nothing is cut.

**Tokens.** `CountTransducer` compiles the merge ranks to a deterministic transducer over the bytes of a piece. The
last token of the BPE encoding of every prefix is fixed by the prefix alone: it is the one vocabulary entry ending
there whose start is a prefix that may stand before it (two tokens may be neighbours if encoding their joined bytes
gives them back). A state holds that token and what the bytes to come can still need of earlier prefixes; each
transition carries the number of tokens by which it lengthens the encoding (negative where a merge takes tokens back).
States are made when first reached, and the table starts anew when it holds `MOST_STATES`, so memory is bounded and
the count does not depend on it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from traceweave.llm.words import span_hashes, text_bytes

CHUNK = 64
MOST_STATES = 400_000

# Sign classes.
BLANK, SPACE, LETTER, DIGIT, OTHER, QUOTE, SHORT, R, V, L, E, END = range(12)
CLASSES = 12
# States: what stands before the next sign.
(
    FRESH,  # the start of a text
    BLANK_1,  # one blank
    SPACE_1,  # one other white-space sign
    BLANK_N,  # a longer run that ends in a blank
    SPACE_N,  # a longer run that ends in another sign
    LETTERS,
    DIGITS,
    OTHERS,
    QUOTED,  # an apostrophe that starts a piece
    QUOTED_R,
    QUOTED_V,
    QUOTED_L,
    SHORTENED,  # a whole contraction
) = range(13)
STATES = 13
HERE, BEFORE = 1, 2

_LETTERS = (LETTER, SHORT, R, V, L, E)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    follow = np.zeros((CLASSES, STATES), np.uint8)
    emit = np.zeros((CLASSES, STATES), np.uint8)
    run_of = {DIGIT: DIGITS, OTHER: OTHERS, QUOTE: OTHERS} | dict.fromkeys(_LETTERS, LETTERS)
    unfinished = (QUOTED_R, QUOTED_V, QUOTED_L)
    white = (BLANK_1, SPACE_1, BLANK_N, SPACE_N)
    for state in range(STATES):
        late = BEFORE if state in unfinished else 0
        for sign in range(CLASSES):
            if sign == END:
                to, out = FRESH, late
            elif sign in (BLANK, SPACE):
                long = state in white
                to = (BLANK_N if long else BLANK_1) if sign == BLANK else (SPACE_N if long else SPACE_1)
                out = late | (0 if long else HERE)
            else:
                run = run_of[sign]
                to, out = (QUOTED if sign == QUOTE else run), late | HERE
                if state == BLANK_1:
                    to, out = run, 0
                elif state == BLANK_N:
                    to, out = run, BEFORE
                elif state == SPACE_N:
                    out = BEFORE | HERE
                elif state == run:
                    to, out = run, 0
                elif state == QUOTED and run == OTHERS:
                    to, out = OTHERS, 0
                elif state == QUOTED and sign == SHORT:
                    to, out = SHORTENED, 0
                elif state == QUOTED and sign in (R, V, L):
                    to, out = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[sign], 0
                elif (state, sign) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
                    to, out = SHORTENED, 0
                elif state in unfinished and run == LETTERS:
                    to, out = LETTERS, BEFORE
            follow[sign, state], emit[sign, state] = to, out
    return follow, emit


FOLLOW, EMIT = _machine()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maps "state before -> state behind" that any text can have, and their compositions.

    There are few, so a map is a number: `after_sign[map, class]` and `joined[map, later map]` are look-ups, and
    `of_start[map]` is the state that a text beginning with it is in.
    """
    same = tuple(range(STATES))
    number, maps, queue = {same: 0}, [same], [same]
    while queue:
        current = queue.pop()
        for sign in range(CLASSES):
            moved = tuple(int(FOLLOW[sign, s]) for s in current)
            if moved not in number:
                number[moved] = len(maps)
                maps.append(moved)
                queue.append(moved)
    every = np.array(maps, np.uint8)
    after_sign = np.array([[number[tuple(FOLLOW[sign, m].tolist())] for sign in range(CLASSES)] for m in every], np.uint16)
    joined = np.array([[number[tuple(later[m].tolist())] for later in every] for m in every], np.uint16)
    return after_sign, joined, every[:, FRESH].copy()


AFTER_SIGN, JOINED, OF_START = _monoid()


def _sign_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = [chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in range(0x110000)]
    joined = "".join(every)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        for match in regex.finditer(pattern, joined):
            table[match.start() : match.end()] = value
    for signs, value in ((" ", BLANK), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        for sign in signs:
            table[ord(sign)] = value
    return table


_TABLE: np.ndarray | None = None


def classes_of(codes: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _sign_classes()
    return _TABLE[codes]


def run_machine(signs: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each sign; `signs` are classes, with END behind every text."""
    n = len(signs)
    if n == 0:
        return np.zeros(0, bool)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = signs
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    # The map of every chunk: all chunks side by side, one sign after the other.
    after = AFTER_SIGN.ravel()
    maps = np.zeros(chunks, np.intp)
    for row in grid:
        maps = after.take(maps * CLASSES + row)
    # Inclusive prefix scan: maps[i] becomes the map of chunks 0 to i.
    joined, many, step = JOINED.ravel(), len(JOINED), 1
    maps = maps.astype(np.intp)
    while step < chunks:
        maps[step:] = joined.take(maps[:-step] * many + maps[step:])
        step *= 2
    state = np.concatenate(([FRESH], OF_START[maps[:-1]])).astype(np.intp)
    flat = FOLLOW.ravel().astype(np.intp)
    out = np.empty_like(grid)
    emit = EMIT.ravel()
    for i, row in enumerate(grid):
        at = row * np.intp(STATES) + state
        out[i] = emit.take(at)
        state = flat.take(at)
    out = out.T.ravel()[:n]
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts


@dataclass
class Pieces:
    """Pieces of a batch of texts: `code[p]` is the row of piece p among the distinct ones; `first[d]` is text d's first."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    first: np.ndarray
    #: Of the distinct pieces: their hashes, ascending, and where each stands first.
    hashes: np.ndarray
    where: np.ndarray

    def bytes_of(self, rows: np.ndarray) -> list[bytes]:
        """The bytes of some of the distinct pieces."""
        at = self.where[rows]
        raw = self.data.data
        return [bytes(raw[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    @cached_property
    def distinct(self) -> list[bytes]:
        return self.bytes_of(np.arange(len(self.where)))


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of all pieces of UTF-8 texts that lie between the offsets."""
    n_texts = len(offsets) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    # One END behind each text.
    text_at = np.searchsorted(lead, offsets)
    shift = np.repeat(np.arange(n_texts), np.diff(text_at))
    signs = np.full(len(codes) + n_texts, END, np.uint8)
    place = np.arange(len(codes)) + shift
    signs[place] = classes_of(codes)
    return lead[run_machine(signs)[place]]


def pieces_of(column: pa.Array) -> Pieces:
    data, offsets = text_bytes(column)
    starts = piece_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    ends = np.concatenate((starts[1:], [len(data)])).astype(np.int64) if len(starts) else starts
    hashes = span_hashes(data, starts, ends)
    hashes, where, code = np.unique(hashes, return_index=True, return_inverse=True)
    return Pieces(data, starts, ends, code, first, hashes, where)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class CountTransducer:
    """Number of BPE tokens of a piece, by a transducer that is compiled as its states are reached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.longest = max(map(len, ranks))
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token) + 1)}
        self._clear()

    def _clear(self) -> None:
        # A state: for the bytes still open (the longest suffix that starts a vocabulary entry), the last token and
        # the count of each earlier prefix, counts relative to the whole prefix.
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.start = self._state((b"", ((b"", 0),)))

    def _state(self, key: tuple) -> int:
        found = self.names.get(key)
        if found is None:
            found = self.names[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return found

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one."""
        if token not in self.halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                pairs = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
                at = min(range(len(pairs)), key=pairs.__getitem__)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether left and right stand side by side in the encoding of left + right.

        Going down both tokens' merges from the seam: no pair across the seam may have been merged before the merge
        that hid it.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit, good = left, right, 1 << 61, True
        while True:
            rank = self.ranks.get(a + b)
            if rank is not None and rank < limit:
                good = False
                break
            # The merge done last goes first; at equal rank the left one was done first.
            rank_a = self.ranks[a] if len(a) > 1 else -1
            rank_b = self.ranks[b] if len(b) > 1 else -1
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                limit, a = rank_a, self._split(a)[1]
            else:
                limit, b = rank_b + 1, self._split(b)[0]
        self.fits[left, right] = good
        return good

    def _step(self, key: tuple, byte: int) -> tuple[tuple, int]:
        """The key behind a byte, and the tokens added."""
        open_bytes, before = key
        text = open_bytes + bytes((byte,))
        # before[i] belongs to the prefix that ends at open_bytes[:i].
        base = before[-1][1]
        for i in range(len(text)):
            token = text[i:]
            if token not in self.ranks:
                continue
            last, count = before[i]
            if last == b"" or self._may_follow(last, token):
                now = (token, count + 1)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        history = (*before, now)
        at = 0
        while text[at:] and text[at:] not in self.prefixes:
            at += 1
        kept = history[at:]
        return (text[at:], tuple((t, c - now[1]) for t, c in kept)), now[1] - base

    def count(self, piece: bytes) -> int:
        total, state, table = 0, self.start, self.next
        for byte in piece:
            moved = table[state].get(byte)
            if moved is None:
                key, added = self._step(self.keys[state], byte)
                if len(self.keys) >= MOST_STATES:
                    self._clear()
                    table = self.next
                    state = self._state(key)
                    total += added
                    continue
                moved = table[state][byte] = (self._state(key), added)
            state, added = moved
            total += added
        return total

    def counts(self, pieces: Iterable[bytes]) -> np.ndarray:
        return np.array([self.count(piece) for piece in pieces], np.int64)
