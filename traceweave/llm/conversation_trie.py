"""Conversation prefix trie from vertical bitmaps.

A node is a distinct sequence of the first d turns of a conversation; its members are the conversations that start with
it. Texts never leave the scan: a turn becomes a 16-byte digest of role and text, and the length of its text.

1. `placed` numbers the turns of each conversation from 0 (hot conversations in slices).
2. A (position, turn) that one conversation alone has ends all sharing, so what follows it is a plain chain of nodes
   with one member; these rows become nodes as they are. Only the shared heads go on.
3. Heads are dealt into shards by ranges of conv_id, about `SHARD_ROWS` turns each. A shard's index maps (position,
   turn) to a bitset of its conversations in order of conv_id. From the root downwards, a node's bitset is intersected
   with the posting of the turn that its lowest conversation takes next: that is a child; its bits are taken off and the
   next lowest conversation gives the next child. Counts are population counts, the smallest member is the lowest bit,
   and the conversations that end at a node are an intersection, too.
4. Shards know a node by the chained digest of its turns. Counts are summed over shards and smallest members compared. With
   the merged values each shard adds up its own subtrees: in order of the depth-first walk a subtree is a range, so its
   sum is a difference of running sums. A node counts in the shard that holds its smallest member only, so the sums of
   the shards add up to the node's.
5. Lists of ending conversations stay pieces per shard, in order because shards are ranges; their digest is fed piece
   by piece.

So a turn, prefix or conversation that a third of all rows share is one row per shard, and no task holds more than a shard.

Defined cases: null roles and texts are empty; rows without a conv_id take no part; a null turn comes first; rows of
one conversation with the same turn are in order of their digest, and equal rows are turns of their own; columns that
are not named here are not read. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow, stored
from traceweave.operators.ordered import sequence

#: Turns of one shard, about.
SHARD_ROWS = 20_000
ROOT = bytes(16)
NODE = "shard int, place long, behind long, parent long, id binary, depth long, conv long, n long, n_bytes long, inner boolean, tails long, ends string"


def turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key (digest of role and text) and n_bytes of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn), key, n_bytes."""
    keyed = stored(turn_keys(turns).withColumn("tie", F.xxhash64("key")), "trie-turns")
    rows = sequence(keyed, ["conv_id"], ["turn", "tie"]).numbered("pos").rows()
    return rows.select("conv_id", (F.col("pos") - 1).alias("pos"), "key", "n_bytes")


class Shard:
    """The vertical index of some conversations, in order of their ids, and the walk over it."""

    def __init__(self, ids: list[int], turns: list[list[tuple[bytes, int]]], going_on: list[bool]):
        self.ids, self.turns = ids, turns
        self.postings: dict[tuple[int, bytes], int] = {}
        # By length of the head: conversations that have more turns in it, end there, go on behind it.
        longest = max(map(len, turns), default=0)
        self.alive, self.ending, self.tails = ([0] * (longest + 1) for _ in range(3))
        for i, (own, more) in enumerate(zip(turns, going_on, strict=True)):
            bit = 1 << i
            for pos, (key, _) in enumerate(own):
                self.postings[pos, key] = self.postings.get((pos, key), 0) | bit
                self.alive[pos] |= bit
            (self.tails if more else self.ending)[len(own)] |= bit

    def _lowest(self, bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def children(self, bits: int, depth: int) -> Iterator[tuple[bytes, int, int]]:
        """Digest and bytes of the next turn, and the members, of each child."""
        rest = bits & self.alive[depth]
        while rest:
            key, size = self.turns[self._lowest(rest)][depth]
            child = bits & self.postings[depth, key]
            rest &= ~child
            yield key, size, child

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            i = self._lowest(bits)
            yield self.ids[i]
            bits ^= 1 << i

    def walk(self) -> dict[str, list]:
        """The nodes in depth-first order: columns of `NODE` without the shard."""
        out: dict[str, list] = {name: [] for name in "parent id depth conv n n_bytes inner tails ends".split()}
        behind: list[int] = []
        stack: list[tuple] = [(-1, 0, ROOT, 0, (1 << len(self.ids)) - 1)]
        while stack:
            parent, depth, digest, size, bits = stack.pop()
            if bits is None:
                behind[parent] = len(behind)
                continue
            at = len(behind)
            behind.append(at + 1)
            ending, tails = bits & self.ending[depth], (bits & self.tails[depth]).bit_count()
            children = list(self.children(bits, depth))
            row = (parent, digest, depth, self.ids[self._lowest(bits)], bits.bit_count(), size, bool(children or tails), tails)
            for values, value in zip(out.values(), (*row, ",".join(map(str, self.members(ending))) if ending else None), strict=True):
                values.append(value)
            if children:
                stack.append((at, 0, b"", 0, None))
                for key, length, child in reversed(children):
                    stack.append((at, depth + 1, hashlib.blake2b(digest + key, digest_size=16).digest(), length, child))
        return {"place": list(range(len(behind))), "behind": behind, **out}


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is a shard: rows (conv_id, pos, key, n_bytes, more) by conv_id and pos; pos -1 is no turn."""
    ids: list[int] = []
    turns: list[list[tuple[bytes, int]]] = []
    going_on: list[bool] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "pos", "key", "n_bytes", "more")]
        for conv, pos, key, size, more in zip(*columns, strict=True):
            if not ids or ids[-1] != conv:
                ids.append(conv)
                turns.append([])
                going_on.append(False)
            if pos >= 0:
                turns[-1].append((key, size))
                going_on[-1] = more
    if not ids:
        return
    nodes = Shard(ids, turns, going_on).walk()
    shard = np.full(len(nodes["place"]), TaskContext.get().partitionId(), np.int32)
    kinds = {"id": pa.binary(), "inner": pa.bool_(), "ends": pa.string()}
    arrays = [pa.array(values, kinds.get(name, pa.int64())) for name, values in nodes.items()]
    yield pa.RecordBatch.from_arrays([pa.array(shard), *arrays], names=["shard", *nodes])


def _summed(group: pa.Table) -> pa.Table:
    """The part of one shard in the sums of its nodes."""
    group = group.combine_chunks().sort_by("place")
    parent, behind, n, size, tails, conv = (
        group.column(c).to_numpy() for c in ("parent", "behind", "all_n", "n_bytes", "tails", "all_conv")
    )
    own = group.column("conv").to_numpy() == conv
    inner = group.column("all_inner").to_numpy(zero_copy_only=False).astype(bool)

    def below(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(values)))
        return upto[behind] - upto[:-1]

    children = tails.copy()
    np.add.at(children, parent[own & (parent >= 0)], 1)
    return pa.table(
        {
            "id": group.column("id"),
            "conv_id": conv,
            "depth": group.column("depth"),
            "parent_conv_id": pa.array(conv[np.maximum(parent, 0)], mask=parent < 0),
            "n_convs": n,
            "n_children": children,
            "n_leaves": below((own & ~inner) + tails),
            "saved_tokens": below(own * (n - 1) * size),
        }
    )


_SUMS = "id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, SHA-256 of all pieces, comma-joined) from rows that come by id and order of their pieces."""
    now, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

    for batch in batches:
        done_ids, done = [], []
        for node, piece in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node != now:
                if digest is not None:
                    done_ids.append(now)
                    done.append(digest.hexdigest())
                now, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done_ids, pa.binary()), pa.array(done)], names=["id", "ends_sha256"])
    if digest is not None:
        yield row()


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of placed turns (conv_id, pos, key, n_bytes; a row with pos -1 stands for no turns).

    conv_id (smallest member) and depth name the node; parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (over its subtree, each node's members but one times the bytes of its last text) and ends_sha256 (of the members
    that have no further turn).
    """
    turns = stored(turns, "trie-placed")
    lengths = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    alone = turns.where("pos >= 0").groupBy("pos", "key").agg(F.count("*").alias("rows"), F.min("conv_id").alias("conv_id"))
    cuts = alone.where("rows = 1").groupBy("conv_id").agg(F.min("pos").alias("cut"))
    cut = lengths.join(cuts, "conv_id", "left")
    rows = stored(turns.join(cut, "conv_id"), "trie-cut")
    shared = F.col("cut").isNull() | (F.col("pos") <= F.col("cut"))
    heads = rows.where(shared).select("conv_id", "pos", "key", "n_bytes", (F.col("pos") + 1 < F.col("n")).alias("more"))
    shards = max(1, -(-heads.count() // shard_rows))
    heads = heads.repartitionByRange(shards, "conv_id").sortWithinPartitions("conv_id", "pos")
    nodes = stored(in_arrow(heads, _walked, NODE), "trie-nodes")
    merged = nodes.groupBy("id").agg(
        F.min("conv").alias("all_conv"), F.sum("n").alias("all_n"), F.max("inner").alias("all_inner")
    )
    sums = (
        nodes.drop("ends", "n", "inner")
        .join(merged, "id")
        .groupBy("shard")
        .applyInArrow(_summed, _SUMS)
        .groupBy("id", "conv_id", "depth", "parent_conv_id", "n_convs")
        .agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    )
    pieces = nodes.where("ends IS NOT NULL").select("id", F.split_part("ends", F.lit(","), F.lit(1)).cast("long").alias("at"), "ends")
    digests = in_arrow(pieces.repartition("id").sortWithinPartitions("id", "at"), _end_digests, "id binary, ends_sha256 string")
    none = F.sha2(F.lit(""), 256)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    heads = sums.join(digests, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(names)
    last = F.col("pos") + 1 == F.col("n")
    tails = rows.where(~shared).select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return heads.unionByName(tails)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text)."""
    return prefix_trie(placed(turns))
