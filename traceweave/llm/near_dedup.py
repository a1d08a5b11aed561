"""Near-duplicate documents: MinHash bands propose, odd sketches filter, full shingle sets decide.

`near_duplicates(docs)` links two documents when their sets of `words_per_shingle` word shingles (A-Z lower-cased)
have a Jaccard similarity of at least `percent` / 100 and gives every document the smallest doc_id it can reach.

1. Documents with equal sets form a class; the smallest doc_id stands for it.
2. MinHash samples of each class give `BANDS` band keys of `ROWS` samples. Documents sharing a key meet at the key's
   smallest document; connected components of these star edges are the candidate clusters. Every pair that shares a
   band lies in one cluster, so no list of pairs is made.
3. Each document's set travels once, to its cluster. There the samples are folded into a parity bitmap (odd sketch),
   XOR population counts discard pairs that are clearly too different, pairs already connected are skipped, and what
   is left is confirmed on full sets. Only links that connect something new leave the task.
4. A cluster above `BLOCK` documents is dealt into blocks. First its best-connected documents (hubs) probe all blocks.
   Then each document outside the largest component found so far probes the blocks with a member of another component
   that it may be linked with by prefix filter: linked sets share an item among the rarest size - ceil(percent % of
   size) + 1 of each, in any fixed order of items. The order is by how often an item's bucket of `RARITIES` occurs. Pairs
   inside a component need no test. The probes of a block are dealt into slices of about `block`, so a group of rows
   has about one block and one slice.

Defined cases: a null text, or one without words, has n_shingles 0 and is linked with nothing; fewer words than a
shingle make one shingle of all words; a null doc_id is linked with nothing and is its own component (null); rows
repeating a doc_id are one node that has the links of each of them, and give a result row each. Other columns are not read, so
their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import components, in_arrow, stored
from traceweave.llm.words import mix, powers, shingle_hashes, slices, words_of

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
BLOCK = 1500
HUBS = 8
#: Buckets by which items are counted to put rare ones first; any count gives right results.
RARITIES = 1 << 20
#: Deviations of the sample count that the sketch filter allows a pair at the threshold.
SAFETY = 5.0
_MULTIPLY = np.random.default_rng(7).integers(1, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(8).integers(0, 2**32, SAMPLES, dtype=np.uint32)
_BAND_POWERS = powers(np.uint64(0x9E3779B97F4A7C15), ROWS)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(column, lower=True)
    whole = shingle_hashes(words.hashes, k)
    sets = []
    for start, end in zip(words.first[:-1], words.first[1:], strict=True):
        if end - start >= k:
            sets.append(np.unique(whole[start : end - k + 1]))
        elif end > start:
            sets.append(shingle_hashes(words.hashes[start:end], end - start))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def samples_of(items: np.ndarray) -> np.ndarray:
    """MinHash samples: the least of each of SAMPLES hashings of the set."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, (short[at : at + 2048, None] * _MULTIPLY + _ADD).min(0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    parts = mix(samples.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1))
    return mix((parts * _BAND_POWERS).sum(1, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (place, sample) flips one bit."""
    place = np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)
    bit = mix(samples.astype(np.uint64) | place) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def most_flips(percent: int) -> int:
    """Differing sketch bits that a pair at the threshold practically never exceeds."""
    apart = 1 - percent / 100
    differ = SAMPLES * apart + SAFETY * np.sqrt(SAMPLES * apart * (1 - apart)) + 1
    bits = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differ))
    return int(bits + SAFETY * np.sqrt(2 * differ * 2 * differ / SKETCH_BITS) + 1)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.array([len(s) for s in sets], np.int64)
            first = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            second = np.array([int(np.bitwise_xor.reduce(mix(~s))) for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(samples_of(s)).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(first),
                    pa.array(second),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key_1", "key_2", "bands"],
            )

    return run


def _linked(percent: int, k: int):
    """Links of one block: its probes against its rows. `label` names what is connected already."""
    most = most_flips(percent)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        probe = group.column("probe").to_numpy(zero_copy_only=False)
        labels = group.column("label").to_numpy()
        data = group.column("items").combine_chunks()
        raw, offsets = _binary(data)
        sets = [raw[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(s) for s in sets], np.int64)
        sketches = np.array([odd_sketch(samples_of(s)) for s in sets])
        # Postings of all rows: every item with the row that holds it.
        items = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        roots = {int(x): int(x) for x in labels}

        def root(x: int) -> int:
            while roots[x] != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        found: list[tuple[int, int]] = []
        tops = labels.copy()
        for i in np.flatnonzero(probe):
            flips = np.bitwise_count(sketches ^ sketches[i]).sum(1)
            low, high = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
            near = (flips <= most) & (100 * low >= percent * high)
            near &= tops != tops[i]
            if not near.any():
                continue
            a, b = np.searchsorted(items, sets[i]), np.searchsorted(items, sets[i], "right")
            spans = b - a
            at = np.repeat(a - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            union = sizes + sizes[i] - common
            changed = False
            for j in np.flatnonzero(near & (100 * common >= percent * union)):
                mine, theirs = root(int(labels[i])), root(int(labels[j]))
                if mine != theirs:
                    roots[max(mine, theirs)] = min(mine, theirs)
                    found.append((int(ids[i]), int(ids[j])))
                    changed = True
            if changed:
                tops = np.array([root(int(x)) for x in labels])
        left, right = (list(x) for x in zip(*found, strict=True)) if found else ([], [])
        return pa.table({"left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64())})

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data), offsets - offsets[0]


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            kept = [n for n in batch.schema.names if n != "text"]
            arrays = [batch.column(n) for n in kept] + [pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "items"])

    return run


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    k = words_per_shingle
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    signed = stored(
        in_arrow(known, _signatures(k), "doc_id long, n_shingles long, key_1 long, key_2 long, bands array<long>"),
        "near-signatures",
    )
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("key_1", "key_2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = stored(
        full.select("doc_id", "key_1", "key_2", "n_shingles")
        .join(classes, ["key_1", "key_2", "n_shingles"])
        .select("doc_id", "rep", "n_shingles"),
        "near-classes",
    )
    reps = member.where(F.col("doc_id") == F.col("rep")).select("doc_id").distinct()

    bands = full.join(reps, "doc_id").select("doc_id", F.explode("bands").alias("band"))
    meets = bands.groupBy("band").agg(
        F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("size")
    )
    star = bands.join(meets.where("center < last"), "band").groupBy("doc_id", "center").agg(F.sum("size").alias("weight"))
    star = stored(star, "near-stars")
    cluster = components(star, "doc_id", "center").toDF("doc_id", "cluster")
    weight = star.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    cluster = stored(cluster.join(weight, "doc_id"), "near-clusters")
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("members"), F.max("weight").alias("most"))
    cluster = cluster.join(sizes.where("members > 1"), "cluster")

    sets = stored(
        in_arrow(
            # Merged at every size, so that the work follows the input.
            known.join(cluster.hint("merge"), "doc_id"),
            _item_sets(k),
            "doc_id long, cluster long, weight long, members long, most long, items binary",
        ),
        "near-sets",
    )
    link = _linked(percent, k)
    columns = ["cluster", "doc_id", "items"]
    small = sets.where(F.col("members") <= block)
    links = (
        small.select(*columns, F.lit(True).alias("probe"), F.col("doc_id").alias("label"))
        .groupBy("cluster")
        .applyInArrow(link, "left long, right long")
    )
    links = stored(links, "near-links")
    large = sets.where(F.col("members") > block).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    if not large.isEmpty():
        links = links.union(_large_links(large, link, percent, block))
    return _labelled(texts, member, links)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(RARITIES, np.int64)
    for batch in batches:
        raw, _ = _binary(batch.column("items"))
        counts += np.bincount((mix(raw.view(np.uint64)) % np.uint64(RARITIES)).astype(np.int64), minlength=RARITIES)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def prefix(items: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest items of a set, of which sets linked with it hold at least one among their own."""
    rarity = counts[(mix(items) % np.uint64(RARITIES)).astype(np.int64)]
    return items[np.lexsort((items, rarity))[: len(items) + 1 + -percent * len(items) // 100]]


def _prefixes(counts, percent: int):
    kept = ["cluster", "doc_id", "block", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _binary(batch.column("items"))
            parts = [prefix(raw[a:b].view(np.uint64), counts.value, percent) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if not parts:
                continue
            owner = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            arrays = [batch.column(n).take(owner) for n in kept] + [pa.array(np.concatenate(parts).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "item"])

    return run


def _large_links(large: DataFrame, link, percent: int, block: int) -> DataFrame:
    """Links of the clusters above a block."""
    columns = ["doc_id", "items", "label"]

    def probed(probes: DataFrame, rows: DataFrame) -> DataFrame:
        """Links of probes, each with the block it goes to, with the rows of that block."""
        many = probes.groupBy("cluster", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("slices"))
        many = stored(many, "near-slices")  # a row per `block` members; its size decides how it is joined
        every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        own = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.col("slices")).cast("int").alias("slice")
        dealt = rows.join(many, ["cluster", "block"]).select("cluster", "block", every, *columns, F.lit(False).alias("probe"))
        asked = probes.join(many, ["cluster", "block"]).select("cluster", "block", own, *columns, F.lit(True).alias("probe"))
        return stored(
            dealt.union(asked).groupBy("cluster", "block", "slice").applyInArrow(link, "left long, right long"), "near-links"
        )

    place = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = large.withColumn("label", F.col("doc_id")).withColumn("block", place)
    # Hubs: the best-connected document of each of HUBS slices of a cluster, by one grouped maximum.
    hubs = large.groupBy("cluster", F.pmod(F.xxhash64("doc_id"), F.lit(HUBS)).alias("slice"))
    hubs = hubs.agg(F.max(F.struct("weight", F.col("doc_id").alias("hub"))).alias("top"))
    hub_ids = hubs.select("cluster", F.col("top.hub").alias("doc_id"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = probed(rows.join(hub_ids, ["cluster", "doc_id"]).withColumn("block", everywhere), rows)

    roots = components(first, "left", "right").toDF("doc_id", "root")
    marked = stored(
        rows.join(roots, "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root"), "near-marked"
    )
    counted = marked.groupBy("cluster", "label").count()
    lead = counted.groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("top"))
    lead = lead.select("cluster", F.col("top.label").alias("lead"))
    rest = marked.join(lead, "cluster").where(F.col("label") != F.col("lead")).select("cluster", "doc_id").distinct()
    rest = stored(rest, "near-rest")
    if rest.isEmpty():
        return first
    return first.union(probed(_routed(marked, rest, percent), marked))


def _routed(marked: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """The rows of `rest`, once for each block where one may be linked with a row of another label."""
    open_rows = marked.join(rest.select("cluster").distinct(), "cluster", "left_semi")
    found = in_arrow(open_rows.select("items"), _bucket_counts, "bucket long, n long")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # RARITIES rows at most
    counts = np.zeros(RARITIES, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    sent = marked.sparkSession.sparkContext.broadcast(counts)
    fields = "cluster long, doc_id long, block int, label long, item long"
    rare = in_arrow(open_rows.select("cluster", "doc_id", "block", "label", "items"), _prefixes(sent, percent), fields)
    rare = stored(rare, "near-prefixes")
    met = rare.groupBy("cluster", "item").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.array_sort(F.collect_set("block")).alias("met")
    )
    met = met.where("low < high").select("cluster", "item", "met")
    asking = rare.join(rest, ["cluster", "doc_id"], "left_semi").select("cluster", "item", "doc_id")
    # Common items have the same list of blocks, so few lists of a document are left to explode.
    lists = asking.join(met, ["cluster", "item"]).select("cluster", "doc_id", "met").distinct()
    routes = lists.select("cluster", "doc_id", F.explode("met").alias("block")).distinct()
    return marked.drop("block").join(routes, ["cluster", "doc_id"])


def _labelled(texts: DataFrame, member: DataFrame, links: DataFrame) -> DataFrame:
    reach = components(
        links.union(member.where(F.col("doc_id") != F.col("rep")).select("doc_id", "rep")), "left", "right"
    ).toDF("doc_id", "component_id")
    shown = (
        member.groupBy("doc_id")
        .agg(F.max("n_shingles").alias("n_shingles"))
        .join(reach, "doc_id", "left")
    )
    out = texts.select("doc_id").join(shown, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
