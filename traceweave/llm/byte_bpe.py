"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

Each Python worker keeps one in-memory DuckDB connection. The distinct pieces (matches of the split pattern) of a
slice of texts that it has not met yet become token-position rows, one per byte. A recursive query joins neighbouring
rows with the merge table, contracts each piece's leftmost pair of least rank, and goes on with the pieces that
changed until nothing merges. Ordered aggregation strings a piece's ids together, and ordered aggregation of the ids'
bytes decodes them; texts are then put together from their pieces.

The recursion keeps every intermediate row of a piece, which grows with the square of its bytes. Pieces above
`LONG` bytes (white-space-free runs; none in prose) are therefore merged by a linked list and a heap instead, with the
same result.

Defined cases: null and empty texts have no ids and decode to nothing; a null doc_id stays null; repeated rows give
repeated rows; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow
from traceweave.llm.transducer import pieces_of, read_ranks
from traceweave.llm.words import slices

LONG = 256
#: Pieces whose ids a worker keeps at most.
MOST_KNOWN = 500_000

#: Rounds of one piece are numbered; the rows of its last round are its encoding. Places are below 65,536.
ENCODE = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE tokens(piece, place, id, round) AS (
    SELECT piece, place, id, 0 FROM fresh
    UNION ALL
    SELECT t.piece, t.place, CASE WHEN t.place = b.pick % 65536 THEN (b.pick // 65536)::INTEGER ELSE t.id END, t.round + 1
    FROM tokens t
    JOIN (
        SELECT n.piece, min(m.merged * 65536 + n.place) AS pick,
               arg_min(n.next_place, m.merged * 65536 + n.place) AS gone
        FROM (
            SELECT piece, place, id, lead(place) OVER w AS next_place,
                   CASE WHEN lead(piece) OVER w = piece THEN lead(id) OVER w END AS next_id
            FROM tokens WINDOW w AS (ORDER BY piece, place)
        ) n
        JOIN merges m ON m.first = n.id AND m.second = n.next_id
        GROUP BY n.piece
    ) b USING (piece)
    WHERE t.place <> b.gone
)
SELECT piece, place, id
FROM tokens JOIN (SELECT piece, max(round) AS round FROM tokens GROUP BY piece) USING (piece, round)
"""

#: Decoding: the bytes of a piece's ids, strung together in order. A piece is whole UTF-8, though its tokens may not be.
DECODE = """
SELECT piece, count(*)::BIGINT AS n, string_agg(id::VARCHAR, ' ' ORDER BY place) AS ids,
       decode(unhex(string_agg(hex, '' ORDER BY place))) AS decoded
FROM encoded JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece
"""


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(first, second, merged) for every way in which two tokens join to a third; the rank of a merge is its id."""
    first, second, merged = [], [], []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            a, b = ranks.get(token[:at]), ranks.get(token[at:])
            if a is not None and b is not None:
                first.append(a)
                second.append(b)
                merged.append(rank)
    return pa.table({"first": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "merged": pa.array(merged, pa.int64())})


def long_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one long piece: a heap of (rank, place) over a linked list of tokens."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(a: int) -> None:
        b = after[a]
        if a >= 0 and b < len(parts):
            joined = parts[a] + parts[b]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], a, joined))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, a, joined = heapq.heappop(heap)
        b = after[a] if parts[a] is not None else len(parts)
        if b >= len(parts) or parts[a] + parts[b] != joined:
            continue
        parts[a], parts[b] = joined, None
        after[a] = after[b]
        if after[a] < len(parts):
            before[after[a]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[p] for p in parts if p is not None]


class PartitionCoder:
    """The DuckDB tables of one worker, and what it knows of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self._table("merges", merge_table(ranks))
        tokens = sorted((rank, token) for token, rank in ranks.items())
        self._table("vocabulary", pa.table({"id": pa.array([r for r, _ in tokens], pa.int32()), "hex": [t.hex() for _, t in tokens]}))
        self.single = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self._forget()

    def _table(self, name: str, data: pa.Table) -> None:
        self.db.register("incoming", data)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.ids: list[str] = []
        self.decoded: list[str] = []

    def learn(self, distinct: list[bytes]) -> np.ndarray:
        """The numbers of these pieces, encoding the new ones."""
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > MOST_KNOWN:
            self._forget()
            new = distinct
        for at in range(0, len(new), 50_000):
            self._encode(new[at : at + 50_000])
        return np.array([self.known[p] for p in distinct], np.int64)

    def _encode(self, new: list[bytes]) -> None:
        short = [i for i, p in enumerate(new) if len(p) <= LONG]
        sizes = np.array([len(new[i]) for i in short], np.int64)
        raw = np.frombuffer(b"".join(new[i] for i in short), np.uint8)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        piece = np.repeat(np.array(short, np.int32), sizes)
        self._table("fresh", pa.table({"piece": piece, "place": place.astype(np.int32), "id": self.single[raw]}))
        self.db.execute(ENCODE)
        for i, p in enumerate(new):
            if len(p) > LONG:
                ids = np.array(long_piece(p, self.ranks), np.int32)
                rows = {"piece": np.full(len(ids), i, np.int32), "place": np.arange(len(ids), dtype=np.int32), "id": ids}
                self.db.register("incoming", pa.table(rows))
                self.db.execute("INSERT INTO encoded SELECT piece, place, id FROM incoming")
                self.db.unregister("incoming")
        rows = self.db.sql(DECODE).to_arrow_table()
        for p in new:
            self.known[p] = len(self.known)
        self.counts += rows.column("n").to_pylist()
        self.ids += rows.column("ids").to_pylist()
        self.decoded += rows.column("decoded").to_pylist()

    def texts(self, numbers: np.ndarray, first: np.ndarray) -> tuple[list[int], list[str], list[str]]:
        """Per text: number of ids, sha256 of the ids, sha256 of the decoded bytes."""
        counts, ids, decoded = [], [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            own = numbers[a:b].tolist()
            counts.append(sum(map(self.counts.__getitem__, own)))
            ids.append(hashlib.sha256(" ".join(map(self.ids.__getitem__, own)).encode()).hexdigest())
            decoded.append(hashlib.sha256("".join(map(self.decoded.__getitem__, own)).encode()).hexdigest())
        return counts, ids, decoded


#: One coder per rank file and Python worker, so that later tasks of a worker find the pieces of earlier ones.
_CODERS: dict[str, PartitionCoder] = {}


def coder_of(path: str) -> PartitionCoder:
    if path not in _CODERS:
        _CODERS[path] = PartitionCoder(read_ranks(path))
    return _CODERS[path]


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            coder = coder_of(path)
            pieces = pieces_of(batch.column("text"))
            numbers = coder.learn(pieces.distinct)[pieces.code] if len(pieces.code) else np.zeros(0, np.int64)
            counts, ids, decoded = coder.texts(numbers, pieces.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256 (the bytes of the ids) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(texts, _coded(ranks_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
