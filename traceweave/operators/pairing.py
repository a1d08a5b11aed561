"""Downloads paired with the uploads that answer them: a waiting download as composable maps over segments.

Rule: major bursts come in order of start and end. At most one download waits. It waits until the first burst that
settles it: a download of at least its size, which waits in its place, or an upload that starts behind its end and
either answers it (sizes within the allowed ratio, whole round within the allowed time) or comes too late, which ends
the wait without a pair. Uploads that overlap the download, or whose size does not fit, leave it waiting.

What settles a download depends on the download and the bursts behind it only, so a stretch of a trace (a *segment*)
is a map from the download that waits before it to the one that waits behind it:

1. Each segment lists the downloads that nothing inside settles, and a summary that says which downloads it must settle.
2. Per trace, these lists meet the summaries of the segments behind: what may still wait at each border.
3. Each segment is evaluated for these few downloads, and for none. That is its map.
4. Per trace, the maps are composed in order: the download that really waits at each border.
5. Each segment is walked once more from there, and gives its pairs.

Steps 1, 3 and 5 run over all segments side by side, 2 and 4 see a few rows per segment. A trace of one segment needs
step 5 only; there a segment is a row of arrays, and many of them share a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.operators.matching import per_row
from traceweave.operators.ordered import DEFAULT_LIMIT, null_safe_join, sequence
from traceweave.session import cut_lineage

#: Major bursts of one segment.
SEGMENT_ROWS = 100_000
FIELDS = ("start_epoch", "end_epoch", "dominant_bytes", "purity")


@dataclass(frozen=True)
class Wait:
    """A waiting download."""

    start: float
    end: float
    size: float
    purity: float


@dataclass(frozen=True)
class Rule:
    longest: float
    ratio: float

    def late(self, wait: Wait, end: np.ndarray) -> np.ndarray:
        """Whether a round up to `end` would be too long, or no time at all."""
        return (end - wait.start > self.longest) | (end <= wait.start)

    def alike(self, wait: Wait, size: np.ndarray) -> np.ndarray:
        return np.maximum(size, wait.size) <= self.ratio * np.maximum(np.minimum(size, wait.size), 1)


class Segment:
    """Major bursts of one stretch of a trace, in order."""

    def __init__(self, down: np.ndarray, fields: Sequence[np.ndarray], rule: Rule) -> None:
        self.rule = rule
        self.down = np.asarray(down, bool)
        self.start, self.end, self.size, self.purity = (np.asarray(f, float) for f in fields)
        self.downs = np.flatnonzero(self.down)

    @classmethod
    def of(cls, rows: pd.DataFrame, rule: Rule) -> Segment:
        rows = rows.sort_values("_n")
        return cls((rows["direction"] == "down").to_numpy(), [rows[f].to_numpy(float) for f in FIELDS], rule)

    def wait(self, i: int) -> Wait:
        return Wait(float(self.start[i]), float(self.end[i]), float(self.size[i]), float(self.purity[i]))

    def settled(self, wait: Wait, since: int) -> int | None:
        """The first burst from `since` on that settles a download, if any; looked for in growing steps."""
        step = 64
        while since < len(self.down):
            part = slice(since, since + step)
            end, size = self.end[part], self.size[part]
            answer = (self.start[part] > wait.end) & (self.rule.late(wait, end) | self.rule.alike(wait, size))
            hit = np.where(self.down[part], size >= wait.size, answer)
            if hit.any():
                return since + int(hit.argmax())
            since, step = since + step, 2 * step
        return None

    def walk(self, wait: Wait | None) -> tuple[list[tuple[Wait, int]], Wait | None]:
        """Pairs (download, place of its upload) from a waiting download on, and the one that waits at the end."""
        pairs, at = [], 0
        while True:
            if wait is None:
                later = np.searchsorted(self.downs, at)
                if later == len(self.downs):
                    return pairs, None
                at = int(self.downs[later]) + 1
                wait = self.wait(at - 1)
            found = self.settled(wait, at)
            if found is None:
                return pairs, wait
            if self.down[found]:
                wait = self.wait(found)
            else:
                if not self.rule.late(wait, self.end[found]):
                    pairs.append((wait, found))
                wait = None
            at = found + 1

    def unsettled(self) -> Iterator[Wait]:
        """Downloads that nothing behind them in this segment settles."""
        top = -np.inf
        for i in self.downs[::-1]:
            if self.size[i] > top:
                top = self.size[i]
                if self.settled(self.wait(i), int(i) + 1) is None:
                    yield self.wait(i)

    def summary(self) -> tuple[float, float, float]:
        """Largest download, start and end of the last upload."""
        ups = np.flatnonzero(~self.down)
        last = (self.start[ups[-1]], self.end[ups[-1]]) if len(ups) else (-np.inf, -np.inf)
        return (self.size[self.downs].max() if len(self.downs) else -np.inf, *last)


def _may_pass(wait: Wait, summary: tuple[float, float, float], rule: Rule) -> bool:
    """Whether a segment with this summary may leave the download waiting; if not, it settles it for sure."""
    top, start, end = summary
    return top < wait.size and not (start > wait.end and rule.late(wait, np.float64(end)))


_ENTRY = ", ".join(f"{f} double" for f in FIELDS)
_LEFT = ", ".join(f"left_{f} double" for f in FIELDS)


def _fields(wait: Wait | None) -> tuple:
    return (None,) * 4 if wait is None else (wait.start, wait.end, wait.size, wait.purity)


def _waits(rows: pd.DataFrame, prefix: str = "") -> list[Wait | None]:
    """One per row; a row without a start stands for none."""
    values = rows[[prefix + f for f in FIELDS]].itertuples(index=False)
    return [None if pd.isna(v[0]) else Wait(*map(float, v)) for v in values]


def _frame(key: dict, rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=list(names), dtype=object)
    for i, (name, value) in enumerate(key.items()):
        frame.insert(i, name, pd.Series([value] * len(frame), dtype=object))
    return frame


def _entries(runs: DataFrame, keys: list[str], types: str, rule: Rule) -> DataFrame:
    """keys, _run, FIELDS: the download that waits before each segment but a trace's first (steps 1 to 4)."""
    part = [*keys, "_run"]
    many = null_safe_join(runs, runs.where("_run = 1").select(*keys).distinct(), keys, "left_semi")

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        segment = Segment.of(rows, rule)
        out = [(*_fields(None), *segment.summary())]
        out += [(*_fields(wait), None, None, None) for wait in segment.unsettled()]
        return _frame({k: rows[k].iloc[0] for k in part}, out, [*FIELDS, "top", "last_start", "last_end"])

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        out, waiting = [], []
        for run, own in rows.groupby("_run", sort=True):
            out += [(run, *_fields(w)) for w in [None, *waiting]]
            summary = tuple(own.loc[own["top"].notna(), ["top", "last_start", "last_end"]].iloc[0])
            new = _waits(own[own["top"].isna()])
            waiting = list(dict.fromkeys([w for w in waiting if _may_pass(w, summary, rule)] + new))
        return _frame({k: rows[k].iloc[0] for k in keys}, out, ["_run", *FIELDS])

    def mapped(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        segment = Segment.of(rows, rule)
        out = [(*_fields(wait), *_fields(segment.walk(wait)[1])) for wait in _waits(before)]
        return _frame({k: rows[k].iloc[0] for k in part}, out, [*FIELDS, *[f"left_{f}" for f in FIELDS]])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        out, wait = [], None
        for run, own in rows.groupby("_run", sort=True):
            if wait is not None:
                out.append((run, *_fields(wait)))
            wait = dict(zip(_waits(own), _waits(own, "left_"), strict=True))[wait]
        return _frame({k: rows[k].iloc[0] for k in keys}, out, ["_run", *FIELDS])

    run = f"{types}, _run long"
    lists = many.groupBy(*part).applyInPandas(listed, f"{run}, {_ENTRY}, top double, last_start double, last_end double")
    borders = lists.groupBy(*keys).applyInPandas(carried, f"{run}, {_ENTRY}")
    maps = many.groupBy(*part).cogroup(borders.groupBy(*part)).applyInPandas(mapped, f"{run}, {_ENTRY}, {_LEFT}")
    return maps.groupBy(*keys).applyInPandas(composed, f"{run}, {_ENTRY}")


def pair_transfers(
    major: DataFrame,
    longest: float,
    ratio: float,
    keys: Sequence[str],
    segment_rows: int = SEGMENT_ROWS,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """keys, down_* and up_* of every pair, from major bursts (keys, direction, FIELDS)."""
    keys, rule = list(keys), Rule(float(longest), float(ratio))
    ordered = sequence(major, keys, ["start_epoch", "end_epoch"], limit).numbered("_n").rows()
    runs = ordered.select(
        *keys,
        "direction",
        *[F.col(f).cast("double").alias(f) for f in FIELDS],
        "_n",
        F.floor((F.col("_n") - 1) / segment_rows).alias("_run"),
    )
    runs = cut_lineage(runs)
    part = [*keys, "_run"]
    types = ", ".join(f"`{k}` {dict(major.dtypes)[k]}" for k in keys)
    waits = _entries(runs, keys, types, rule).select(*part, F.struct(*FIELDS).alias("_wait"))
    own = F.struct("_n", (F.col("direction") == "down").alias("down"), *FIELDS).alias("_own")
    lists = (
        runs.select(*part, own)
        .unionByName(waits, allowMissingColumns=True)
        .groupBy(*part)
        .agg(F.array_sort(F.collect_list("_own")).alias("_own"), F.max("_wait").alias("_wait"))
    )
    arrays = {f"own_{f}": F.col(f"_own.{f}") for f in ("down", *FIELDS)} | {f"wait_{f}": F.col(f"_wait.{f}") for f in FIELDS}
    rows = lists.select(*keys, *[c.alias(n) for n, c in arrays.items()])

    def paired(is_down: np.ndarray, *fields) -> list[tuple]:
        bursts, before = fields[: len(FIELDS)], fields[len(FIELDS) :]
        segment = Segment(is_down, bursts, rule)
        pairs, _ = segment.walk(None if pd.isna(before[0]) else Wait(*map(float, before)))
        return [(*_fields(down), *_fields(segment.wait(up))) for down, up in pairs]

    names = [f"{side}_{f}" for side in ("down", "up") for f in FIELDS]
    return per_row(rows, keys, list(arrays), paired, names, ["double"] * len(names))
