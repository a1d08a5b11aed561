"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays in one shard. The bytes of a group are its size.

1. Groups are formed by digest with a grouped sum (combined before the shuffle).
2. `plan` packs sizes, not groups: from large to small, the groups of one size go into the bin with the least room that
   still holds them, found in a balanced tree of the bins by room left. A size's groups go in as counts, so the work is
   sizes x shards. A group above the mean load has a shard to itself; for the others, the capacity is the least for
   which the other shards suffice, found by bisection from their mean.
3. Sizes above `EXACT` bytes are few for their bytes; below, they are themselves the histogram. So that the plan stays
   bounded, sizes above EXACT are rounded up to `STEP`s of their power of two for planning only.
4. Groups take the planned places of their size by a gapless rank within it (two-step numbering).

Defined cases: a null text is empty and equal to empty texts; its row's size is 1; a null doc_id is dealt like any
other; repeated rows are in one group; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import ranked, stored

SHARDS = 8
EXACT = 1 << 14
#: Steps per power of two above EXACT: 64 powers x 1,024 steps bound the plan.
STEP = 1 << 10


def planned_size(size):
    """The size that planning uses: exact up to EXACT, above it rounded up by less than one part in STEP."""
    power = F.floor(F.log2(size.cast("double")))
    step = F.greatest(F.pow(F.lit(2.0), power) / STEP, F.lit(1.0)).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step) * step).cast("long")


class RoomTree:
    """A balanced search tree (treap) of bins, ordered by room left, then by number."""

    def __init__(self):
        self.root: list | None = None  # [key, priority, left, right]
        self.random = random.Random(1)

    def _split(self, node, key):
        """Trees of the keys below and of those from `key` on."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        self.root = self._join(self._join(low, [(room, number), self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that still holds `size`."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(high, (least[0][0], least[0][1] + 1))
        self.root = self._join(low, rest)
        return least[0]


def best_fit(counts: dict[int, int], shards: int | None, capacity: int) -> list[tuple[int, int, int, int]] | None:
    """(size, first rank, last rank + 1, shard) by best fit decreasing, or None if the shards don't suffice.

    Without a number of shards, as many of this capacity are opened as are needed.
    """
    tree, opened, runs = RoomTree(), 0, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        if size > capacity:
            return None
        while left:
            found = tree.take(size)
            if found is None:
                if shards is not None and opened == shards:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            take = min(left, room // size)
            runs.append((size, rank, rank + take, shard))
            rank, left = rank + take, left - take
            tree.add(room - take * size, shard)
    return runs


def plan(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Groups above the mean load alone in the first shards; the rest in the others, at the least capacity that best fit needs.

    Without its largest group the mean of what is left falls, so the next group may be above it too.
    """
    rest, alone = dict(counts), []
    while rest:
        size, left = max(rest), shards - len(alone)
        if size * left <= sum(s * n for s, n in rest.items()):
            break
        # Groups of one size are all above the mean, or none is.
        alone += [(size, rank, rank + 1, len(alone) + rank) for rank in range(rest.pop(size))]
    if not rest:
        return alone
    first, shards = len(alone), shards - len(alone)
    low = high = -(-sum(s * n for s, n in rest.items()) // shards)
    while (found := best_fit(rest, shards, high)) is None:
        low, high = high + 1, high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, shards, middle)
        if tried is None:
            low = middle + 1
        else:
            high, found = middle, tried
    return alone + [(size, start, end, first + shard) for size, start, end, shard in found]


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (gapless in its shard)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("planned", planned_size(F.col("bytes"))), "shard-groups")
    counts = {r["planned"]: r["count"] for r in groups.groupBy("planned").count().collect()}
    runs = docs.sparkSession.createDataFrame(
        plan(counts, shards), "planned long, rank_from long, rank_to long, shard int"
    )
    dealt = (
        ranked(groups, ["planned"], [F.col("digest")], "rank")
        .join(F.broadcast(runs), "planned")  # as long as the histogram, which is bounded
        .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select("digest", "shard")
    )
    placed = rows.join(dealt, "digest").select("doc_id", "size", "text_crc32", "shard")
    return ranked(stored(placed, "shard-placed"), ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot")
