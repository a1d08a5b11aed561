"""Inferred rounds against true ones: clock offset, one-to-one matches, boundary scores.

Matching takes the pair with the highest IoU, then the next whose ends are both free, and so on. Two intervals compete
only if a chain of overlapping intervals joins them, so the intervals of a trace fall into components: in order of
start, a component ends where the next start is not before the running maximum of ends. Components are matched side by
side, each in one pass over its overlapping pairs. As pairs come by falling IoU, the matches at a stricter level are the
matches at a looser one that reach it; one matching serves all levels.

The clock offset of a trace is the start difference that most rounds agree on. Differences are counted in buckets
without listing all pairs: histograms of starts are correlated block by block (FFT), which bounds each bucket from
above; buckets are then counted exactly in order of their bounds until no other can be among the fullest. Each of
those offers the median of its differences, and the offsets are scored by one-to-one matches of starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X
from traceweave.operators.ordered import DEFAULT_LIMIT, sequence

# ---- fixed values -------------------------------------------------------
IOU_LEVELS = (0.25, 0.5, 0.75)
PRIMARY_LEVEL = 0.5
OFFSET_BIN_SEC = 0.25
OFFSET_TOLERANCE_SEC = 0.25
OFFSET_BUCKETS = 64
INDEXED_ROUNDS = 20
# -------------------------------------------------------------------------

#: Histogram bins of one block of a correlation.
BLOCK_BINS = 1 << 18
#: Up to so many pairs of starts, their differences are listed.
LISTED_PAIRS = 1 << 16


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)


def per_row(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], work: Callable, names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """keys and the columns that `work` makes of each row's arrays (one list of tuples); groups are small, so many share a batch."""
    keys, names = list(keys), list(names)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [work(*row) for row in zip(*(batch[c] for c in arrays), strict=True)]
            rows = pd.DataFrame([r for rows in found for r in rows], columns=names, dtype=object)
            owners = batch[keys].iloc[np.repeat(np.arange(len(batch)), [len(rows) for rows in found])]
            yield pd.concat([owners.reset_index(drop=True), rows], axis=1)

    schema = ", ".join([_key_types(df, keys), *[f"{n} {k}" for n, k in zip(names, kinds, strict=True)]])
    return df.select(*keys, *arrays).mapInPandas(over, schema)


# ---- matches ------------------------------------------------------------------


def components(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Both sides (keys, index, start_epoch, end_epoch) with `on_left` and the number of their component within the key."""
    columns = [*keys, F.col("index").cast("long"), F.col("start_epoch").cast("double"), F.col("end_epoch").cast("double")]
    both = left.select(*columns, F.lit(True).alias("on_left")).unionByName(right.select(*columns, F.lit(False).alias("on_left")))
    both = both.where("end_epoch > start_epoch")
    order = sequence(both, keys, ["start_epoch", "end_epoch"], limit)
    order = order.running_max({"_upto": F.col("end_epoch")}).previous({"_before": F.col("_upto")})
    opens = F.col("_before").isNull() | (F.col("start_epoch") >= F.col("_before"))
    order = order.with_columns({"_new": opens.cast("long")}).running_sum({"component": F.col("_new")})
    return order.rows().drop("_upto", "_before", "_new")


def _overlaps(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(left row, right rows, IoU) of intervals with at least this IoU; `right` is in order of start."""
    longest = np.max(right[:, 1] - right[:, 0], initial=0.0)
    for i, (start, end) in enumerate(left):
        a = np.searchsorted(right[:, 0], start - longest, "right")
        b = np.searchsorted(right[:, 0], end)
        span = right[a:b]
        common = np.minimum(end, span[:, 1]) - np.maximum(start, span[:, 0])
        iou = common / (np.maximum(end, span[:, 1]) - np.minimum(start, span[:, 0]))
        good = (common > 0) & (iou >= least)
        yield np.full(int(good.sum()), i), np.arange(a, b)[good], iou[good]


def _take(order: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places, in this order, whose both ends are free when their turn comes."""
    taken, used_i, used_j = [], set(), set()
    for at in order.tolist():
        if i[at] not in used_i and j[at] not in used_j:
            used_i.add(i[at])
            used_j.add(j[at])
            taken.append(at)
    return taken


def greedy_matches(
    left: DataFrame, right: DataFrame, keys: Sequence[str], minimum_iou: float = IOU_LEVELS[0], limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """keys, left_index, right_index, iou, start_error_sec, end_error_sec of the one-to-one matches.

    Pairs come by falling IoU, then rising start error, then the smaller left and right index. Intervals that only touch
    do not overlap; intervals without length match nothing.
    """
    keys = list(keys)

    def matched(a_id, a_start, a_end, b_id, b_start, b_end) -> list[tuple]:
        ids, a, b = (a_id, b_id), np.column_stack([a_start, a_end]), np.column_stack([b_start, b_end])
        found = list(_overlaps(a, b, minimum_iou))
        i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True))
        errors = np.abs(a[i] - b[j])
        order = np.lexsort((ids[1][j], ids[0][i], errors[:, 0], -iou))
        best = _take(order, i, j)
        values = [ids[0][i[best]], ids[1][j[best]], iou[best], errors[best, 0], errors[best, 1]]
        return list(zip(*(v.tolist() for v in values), strict=True))

    table = components(left, right, keys, limit)
    own = F.struct("start_epoch", "index", "end_epoch")
    sides = {"a": F.when(F.col("on_left"), own), "b": F.when(~F.col("on_left"), own)}
    grouped = table.groupBy(*keys, "component").agg(*[F.array_sort(F.collect_list(v)).alias(n) for n, v in sides.items()])
    arrays = [f"{n}_{f}" for n in sides for f in ("index", "start_epoch", "end_epoch")]
    grouped = grouped.where((F.size("a") > 0) & (F.size("b") > 0))
    grouped = grouped.select(*keys, *[F.col(f"{c[0]}.{c[2:]}").alias(c) for c in arrays])
    names = ["left_index", "right_index", "iou", "start_error_sec", "end_error_sec"]
    return per_row(grouped, keys, arrays, matched, names, ["long", "long", "double", "double", "double"])


def boundary_scores(
    matches: DataFrame,
    inferred: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    levels: Sequence[float] = IOU_LEVELS,
    primary: float = PRIMARY_LEVEL,
) -> DataFrame:
    """One row per trace with true rounds: matches, precision and recall at each level, mean errors at the primary one."""
    keys = list(keys)
    count = F.count(F.lit(1))
    main = F.col("iou") >= primary
    names = {level: f"iou_{round(100 * level)}" for level in levels}
    hits = matches.groupBy(*keys).agg(
        *[F.count(F.when(F.col("iou") >= level, 1)).alias(f"matched_rounds_{name}") for level, name in names.items()],
        F.count(F.when(main, 1)).alias("matched_rounds"),
        F.avg(F.when(main, F.col("iou"))).alias("interval_iou_mean"),
        F.avg(F.when(main, F.col("start_error_sec"))).alias("start_error_mean_sec"),
        F.percentile(F.when(main, F.col("start_error_sec")), F.lit(0.5)).alias("start_error_median_sec"),
        F.avg(F.when(main, F.col("end_error_sec"))).alias("end_error_mean_sec"),
    )
    table = (
        truth.groupBy(*keys).agg(count.alias("truth_rounds"))
        .join(inferred.groupBy(*keys).agg(count.alias("inferred_rounds")), keys, "left")
        .join(hits, keys, "left")
    )
    matched = ["matched_rounds", *[f"matched_rounds_{n}" for n in names.values()]]
    table = table.fillna(0, ["inferred_rounds", *matched])
    rates = {}
    for column in matched:
        end = column.removeprefix("matched_rounds")
        rates[f"boundary_precision{end}"] = X.safe_divide(F.col(column), F.col("inferred_rounds"))
        rates[f"boundary_recall{end}"] = X.safe_divide(F.col(column), F.col("truth_rounds"))
    status = F.when(F.col("inferred_rounds") == 0, "no_inferred_rounds").otherwise("evaluated")
    return table.withColumns(rates).withColumn("status", status)


# ---- clock offset -------------------------------------------------------------


def _correlated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of two sorted bin numbers that occur, and how often."""
    def blocks(bins: np.ndarray) -> dict[int, np.ndarray]:
        which = bins // BLOCK_BINS
        return {int(w): np.bincount(bins[which == w] % BLOCK_BINS, minlength=BLOCK_BINS) for w in np.unique(which)}

    ahead, behind = blocks(a), blocks(b)
    size = 2 * BLOCK_BINS
    spectra = [{w: np.fft.rfft(h, size) for w, h in side.items()} for side in (ahead, behind)]
    sums: dict[int, np.ndarray] = {}
    for p, left in spectra[0].items():
        for q, right in spectra[1].items():
            sums[p - q] = sums.get(p - q, 0) + left * right.conj()
    values, counts = [], []
    for apart, spectrum in sums.items():
        held = np.rint(np.fft.irfft(spectrum, size)).astype(np.int64)
        at = np.flatnonzero(held)
        values.append(np.where(at < BLOCK_BINS, at, at - size) + apart * BLOCK_BINS)
        counts.append(held[at])
    values, where = np.unique(np.concatenate(values), return_inverse=True)
    return values, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _common_offsets(a: np.ndarray, b: np.ndarray, width: float, top: int) -> list[float]:
    """Medians of the `top` fullest buckets of differences, fullest first, then in order of a, then b."""
    if len(a) * len(b) > LISTED_PAIRS:
        buckets = Differences(a, b, width)
        return [float(np.median(buckets.of(k))) for k in buckets.fullest(top)]
    apart = (a[:, None] - b).ravel()
    _, first, own, n = np.unique(np.rint(apart / width), return_index=True, return_inverse=True, return_counts=True)
    inside = apart[np.lexsort((apart, own))]
    begins = np.cumsum(n) - n
    medians = (inside[begins + (n - 1) // 2] + inside[begins + n // 2]) / 2
    return medians[np.lexsort((first, -n))[:top]].tolist()


class Differences:
    """All differences a - b of two sorted lists of starts, by bucket of `width` seconds, without listing them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, width: float):
        self.a, self.b, self.width = a, b, width
        base = min(a[0], b[0])
        bins, counts = _correlated(*(np.floor((x - base) / width).astype(np.int64) for x in (a, b)))
        # A difference in bucket k comes from bins that are k - 1, k or k + 1 apart; one bin more for rounding errors.
        self.buckets = np.unique(bins[:, None] + np.arange(-2, 3))
        self.bounds = np.zeros(len(self.buckets), np.int64)
        for off in range(-2, 3):
            np.add.at(self.bounds, np.searchsorted(self.buckets, bins + off), counts)
        self.known: dict[int, np.ndarray] = {}
        self.begins: dict[int, tuple[int, int]] = {}

    def of(self, bucket: int) -> np.ndarray:
        """The differences in one bucket, in order of a, then b."""
        if bucket not in self.known:
            low = np.searchsorted(self.b, self.a - (bucket + 0.5001) * self.width)
            high = np.searchsorted(self.b, self.a - (bucket - 0.5001) * self.width, "right")
            n = np.maximum(high - low, 0)
            i = np.repeat(np.arange(len(self.a)), n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[i]
            apart = self.a[i] - self.b[j]
            own = np.rint(apart / self.width) == bucket
            self.known[bucket] = apart[own]
            if own.any():
                self.begins[bucket] = (int(i[own][0]), int(j[own][0]))
        return self.known[bucket]

    def fullest(self, top: int) -> list[int]:
        """The `top` fullest buckets, fullest first; of equally full ones those that come first in order of a, then b."""
        sizes: dict[int, int] = {}
        for bucket, bound in sorted(zip(self.buckets.tolist(), self.bounds.tolist(), strict=True), key=lambda x: -x[1]):
            if len(sizes) >= top and sorted(sizes.values())[-top] > bound:
                break
            # At the edge ties matter, so buckets that can only tie are counted, too.
            if len(sizes) >= top and bound == 1 and sorted(sizes.values())[-top] == 1:
                break
            if len(self.of(bucket)):
                sizes[bucket] = len(self.of(bucket))
        edge = sorted(sizes.values())[-top] if len(sizes) >= top else 1
        chosen = [k for k, n in sizes.items() if n > edge]
        return sorted(self._filled(chosen, edge, top), key=lambda k: (-len(self.of(k)), self.begins[k]))

    def _filled(self, chosen: list[int], edge: int, top: int) -> list[int]:
        """The chosen buckets and, up to `top`, the first ones that hold `edge` differences."""
        held, tied = set(chosen), []
        for x in self.a:
            for bucket in dict.fromkeys(np.rint((x - self.b) / self.width).astype(np.int64).tolist()):
                if len(held) >= top:
                    break
                if bucket not in held and len(self.of(bucket)) == edge:
                    held.add(bucket)
                    tied.append(bucket)
            if len(held) >= top:
                break
        return [*chosen, *tied]


def _support(a: np.ndarray, b: np.ndarray, tolerance: float) -> tuple[int, float, float]:
    """One-to-one matches of starts within the tolerance, nearest first: how many, median and mean error."""
    low = np.searchsorted(b, a - tolerance * 1.0001)
    n = np.searchsorted(b, a + tolerance * 1.0001, "right") - low
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[i]
    error = np.abs(a[i] - b[j])
    near = error <= tolerance
    i, j, error = i[near], j[near], error[near]
    best = _take(np.argsort(error, kind="stable"), i, j)
    if not best:
        return 0, np.inf, np.inf
    return len(best), float(np.median(error[best])), float(np.mean(error[best]))


def consensus(a: np.ndarray, b: np.ndarray, width: float, tolerance: float, top: int) -> tuple[float, int, float, float]:
    """Offset of sorted starts a against b, its support, and the median and mean error that is left."""
    offsets = []
    if len(a) and len(b):
        # Times since the first start have no rounding errors left that could decide between equal errors.
        base = min(a[0], b[0])
        a, b = a - base, b - base
        offsets = _common_offsets(a, b, width, top)
    offsets.append(0.0)
    n = min(len(a), len(b), INDEXED_ROUNDS)
    if n:
        offsets.append(float(np.median(a[:n] - b[:n])))
    distinct: dict[float, float] = {}
    for offset in offsets:
        distinct.setdefault(round(offset, 6), offset)
    # The most any offset can support: starts of either side that have one of the other near.
    bounds = [_near(a - offset, b, tolerance) for offset in distinct.values()]
    scored, most = [], 0
    for bound, at, offset in sorted(zip(bounds, range(len(distinct)), distinct.values(), strict=True), key=lambda x: -x[0]):
        if bound < most:
            break
        support, median, mean = _support(a - offset, b, tolerance)
        most = max(most, support)
        scored.append((-support, round(median, 6), round(mean, 6), at, offset, median, mean))
    support, _, _, _, offset, median, mean = min(scored)
    return offset, -support, median, mean


def _near(a: np.ndarray, b: np.ndarray, tolerance: float) -> int:
    """No fewer than the one-to-one matches of starts within the tolerance."""
    if not len(a) or not len(b):
        return 0

    def some(x: np.ndarray, y: np.ndarray) -> int:
        slack = tolerance * 1.0001
        return int((np.searchsorted(y, x - slack) < np.searchsorted(y, x + slack, "right")).sum())

    return min(some(a, b), some(b, a))


def clock_offsets(
    inferred: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    bin_sec: float = OFFSET_BIN_SEC,
    tolerance_sec: float = OFFSET_TOLERANCE_SEC,
    top: int = OFFSET_BUCKETS,
) -> DataFrame:
    """keys, clock_offset_sec (inferred minus true), support, start_error_median_sec and _mean_sec of every trace on both sides.

    Of offsets with equal support and errors (to the microsecond) the one from the fuller bucket is taken (then zero, then that of the first
    rounds side by side). Without any match the offset is 0.
    """
    keys = list(keys)
    names = ["clock_offset_sec", "clock_alignment_support", *(f"clock_alignment_start_error_{x}_sec" for x in ("median", "mean"))]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("start_epoch").cast("double").alias("t"), F.lit(name).alias("side"))

    def scored(a: np.ndarray, b: np.ndarray) -> list[tuple]:
        offset, support, median, mean = consensus(a, b, bin_sec, tolerance_sec, top)
        return [(offset if support else 0.0, support, *[x if np.isfinite(x) else None for x in (median, mean)])]

    both = side(inferred, "inferred").unionByName(side(truth, "truth")).where("t IS NOT NULL")
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("t")))).alias(n) for n in ("inferred", "truth")]
    starts = both.groupBy(*keys).agg(*sides).where((F.size("inferred") > 0) & (F.size("truth") > 0))
    return per_row(starts, keys, ["inferred", "truth"], scored, names, ["double", "long", "double", "double"])


def validate_rounds(inferred: DataFrame, truth: DataFrame, keys: Sequence[str], **options) -> dict[str, DataFrame]:
    """Offsets, matches on the shifted clock, and boundary scores with the offset's support."""
    keys = list(keys)
    offsets = clock_offsets(inferred, truth, keys, **options)
    shift = F.coalesce(F.col("clock_offset_sec"), F.lit(0.0))
    shifted = inferred.join(offsets.select(*keys, "clock_offset_sec"), keys, "left").select(
        *keys, "index", (F.col("start_epoch") - shift).alias("start_epoch"), (F.col("end_epoch") - shift).alias("end_epoch")
    )
    matches = greedy_matches(shifted, truth, keys)
    scores = boundary_scores(matches, shifted, truth, keys).join(offsets, keys, "left")
    return {"offsets": offsets, "matches": matches, "scores": scores}
