"""Range joins and other joins the trace operators share.

Intervals are dealt by length: level L holds those of at most 2^L seconds, in buckets of 2^L seconds. So an interval
touches one or two buckets whatever its length, and one long interval among short ones costs no more than they do.
Where points meet intervals, every level in use would be one more copy of all points. Levels whose intervals are few are
served by the buckets of a lower one, which these intervals touch many of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceweave.functions import exprs as X

#: Levels of lengths from a microsecond up to 2^40 seconds.
LOWEST, HIGHEST = -20, 40


def _level(length: Column) -> Column:
    exact = F.ceil(F.log2(F.greatest(length, F.lit(2.0**LOWEST))))
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), exact)).cast("int")


def _level_counts(df: DataFrame, start: str, end: str) -> dict[int, int]:
    """Intervals of each level in use: at most HIGHEST - LOWEST + 1 numbers."""
    level = _level(F.col(end) - F.col(start)).alias("level")
    found = df.select(level).where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return {r["level"]: r["n"] for r in found.collect()}


def _serving(counts: dict[int, int], points: int) -> dict[int, int]:
    """The level that serves each level in use: itself or a lower one, so that copies of points and intervals are fewest."""
    levels = sorted(counts)
    best: list[tuple[int, int]] = [(0, 0)]  # rows for the first so many levels, and where the last group of them begins
    for upto in range(1, len(levels) + 1):
        ways = []
        for first in range(upto):
            own = sum(counts[v] * (2 ** (v - levels[first]) + 1) for v in levels[first:upto])
            ways.append((best[first][0] + points + own, first))
        best.append(min(ways))
    served, upto = {}, len(levels)
    while upto:
        first = best[upto][1]
        served |= {v: levels[first] for v in levels[first:upto]}
        upto = first
    return served


def _bucket(time: Column, level: Column) -> Column:
    return F.floor(time / F.pow(F.lit(2.0), level))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
) -> DataFrame:
    """Points inside closed intervals of the same key.

    A point gets one copy per level that serves others, with its bucket there as
    an extra equi key, which also spreads a hot key over many tasks. Points are
    many times what the size of their compressed files tells, and never broadcast.
    """
    counts = _level_counts(intervals, start, end) or {0: 0}
    served = _serving(counts, points.count() if len(counts) > 1 else 0)
    left = points.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in sorted({*served.values()})])))
    left = left.withColumn("_bucket", _bucket(F.col(time), F.col("_level")))
    own = _level(F.col(end) - F.col(start))
    right = intervals.withColumn("_level", F.coalesce(*[F.when(own == v, F.lit(by)) for v, by in served.items()]))
    touched = F.sequence(_bucket(F.col(start), F.col("_level")), _bucket(F.greatest(start, end), F.col("_level")))
    right = right.withColumn("_bucket", F.explode(touched))
    inside = (F.col(f"_p.{time}") >= F.col(f"_i.{start}")) & (F.col(f"_p.{time}") <= F.col(f"_i.{end}"))
    equal = F.lit(True)
    for name in [*keys, "_level", "_bucket"]:
        equal = equal & (F.col(f"_p.{name}") == F.col(f"_i.{name}"))
    joined = left.alias("_p").hint("merge").join(right.alias("_i"), equal & inside)
    extra = [c for c in intervals.columns if c not in keys]
    return joined.select(*[f"_p.{c}" for c in points.columns], *[f"_i.{c}" for c in extra])


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of intervals of one key that overlap, with their IoU and start errors.

    ``left``/``right``: keys, ``index``, ``start_epoch``, ``end_epoch``.  Two
    intervals meet at the level of the longer one, in the first bucket both
    touch there, hence once.
    """
    levels = sorted({v for side in (left, right) for v in _level_counts(side, "start_epoch", "end_epoch")}) or [0]
    at = F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_own"))).alias("_level")

    def spread(df: DataFrame, prefix: str) -> DataFrame:
        named = df.select(
            *keys,
            F.col("index").alias(f"{prefix}_index"),
            F.col("start_epoch").alias(f"{prefix}_start"),
            F.col("end_epoch").alias(f"{prefix}_end"),
            _level(F.col("end_epoch") - F.col("start_epoch")).alias("_own"),
        ).select("*", at)
        first = _bucket(F.col(f"{prefix}_start"), F.col("_level"))
        last = _bucket(F.greatest(f"{prefix}_start", f"{prefix}_end"), F.col("_level"))
        return named.select(
            "*", first.alias(f"_{prefix}_first"), F.explode(F.sequence(first, last)).alias("_bucket")
        ).withColumnRenamed("_own", f"_{prefix}_own")

    pairs = spread(left, "left").join(spread(right, "right"), [*keys, "_level", "_bucket"])
    once = (F.col("_bucket") == F.greatest("_left_first", "_right_first")) & (
        F.col("_level") == F.greatest("_left_own", "_right_own")
    )
    iou = X.interval_iou(*[F.col(c) for c in ("left_start", "left_end", "right_start", "right_end")])
    return pairs.where(once).select(
        *keys,
        "left_index",
        "right_index",
        iou.alias("iou"),
        F.abs(F.col("left_start") - F.col("right_start")).alias("start_error_sec"),
        F.abs(F.col("left_end") - F.col("right_end")).alias("end_error_sec"),
    ).where("iou > 0")
