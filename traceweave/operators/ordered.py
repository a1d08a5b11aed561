"""Ordered per-key operators that stay parallel when one key is huge.

A window partitioned by a key runs in one task per key.  When a single key may
hold a third of all rows that task becomes the job.  Here such keys are cut
into *slices*: contiguous runs of the key's order, each below ``limit`` rows.
Windows then run per (key, slice) and a tiny per-slice summary carries the
state (last value, running total) from one slice to the next, so results are
the same as without slices.

Planning costs one narrow count per refinement level; only a yes/no reaches the
driver.  Every cell that is refined holds more than ``limit`` rows, so the
table of such cells has fewer than rows/limit entries and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
FAN_OUT = 1024
#: Slices of one cut that are not ranges of finite values: null, -inf, inf and NaN, in the order of a sort.
APART = 4
#: Six levels of 1,024 slices fill the slice number's 60 bits.
MAX_LEVELS = 6
DEFAULT_LIMIT = 1_000_000
SALTS = 32


def null_safe(left: Column, right: Column, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join on ``names`` in which null meets null; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{n}" for n in names])


@dataclass(frozen=True)
class Sequenced:
    """Rows with a total order inside each key; ``sliced`` if any key was cut."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool

    @property
    def parts(self) -> list[str]:
        return [*self.keys, SLICE] if self.sliced else list(self.keys)

    def _window(self) -> Window:
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def _with(self, df: DataFrame) -> "Sequenced":
        return Sequenced(df, self.keys, self.order, self.sliced)

    def with_columns(self, columns: Mapping[str, Column]) -> "Sequenced":
        return self._with(self.df.withColumns(dict(columns)))

    def previous(self, columns: Mapping[str, Column]) -> "Sequenced":
        """Last non-null value of each expression strictly before the row."""
        before = self._window().rowsBetween(Window.unboundedPreceding, -1)
        if not self.sliced:
            return self.with_columns(
                {name: F.last(value, ignorenulls=True).over(before) for name, value in columns.items()}
            )
        names = list(columns)
        position = F.struct(*self.order)
        per_slice = self.df.groupBy(*self.parts).agg(
            *[
                F.max_by(columns[n], F.when(columns[n].isNotNull(), position)).alias(f"_carry_{n}")
                for n in names
            ]
        )
        earlier = (
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_slice.select(
            *self.parts,
            *[F.last(f"_carry_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in names],
        )
        local = self.df.withColumns(
            {n: F.last(columns[n], ignorenulls=True).over(before) for n in names}
        )
        return self._with(
            null_safe_join(local, carry, self.parts)
            .withColumns({n: F.coalesce(n, f"_carry_{n}") for n in names})
            .drop(*[f"_carry_{n}" for n in names])
        )

    def running_sum(self, columns: Mapping[str, Column]) -> "Sequenced":
        """Sum of each expression up to and including the row."""
        return self._running(columns, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    def running_max(self, columns: Mapping[str, Column]) -> "Sequenced":
        """Largest value of each expression up to and including the row."""
        return self._running(columns, F.max, F.greatest)

    def _running(self, columns: Mapping[str, Column], total, both) -> "Sequenced":
        """`total` of each expression from the key's first row to this one; `both` joins it with that of earlier slices."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.df.withColumns({n: total(value).over(upto) for n, value in columns.items()})
        if not self.sliced:
            return self._with(local)
        names = list(columns)
        per_slice = self.df.groupBy(*self.parts).agg(
            *[total(columns[n]).alias(f"_total_{n}") for n in names]
        )
        earlier = (
            Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        )
        offset = per_slice.select(
            *self.parts,
            *[total(f"_total_{n}").over(earlier).alias(f"_total_{n}") for n in names],
        )
        return self._with(
            null_safe_join(local, offset, self.parts)
            .withColumns(
                {
                    n: F.when(
                        F.col(n).isNotNull() | F.col(f"_total_{n}").isNotNull(), both(F.col(n), F.col(f"_total_{n}"))
                    )
                    for n in names
                }
            )
            .drop(*[f"_total_{n}" for n in names])
        )

    def numbered(self, name: str = "row_number") -> "Sequenced":
        """1-based position inside the key."""
        if not self.sliced:
            return self.with_columns({name: F.row_number().over(self._window()).cast("long")})
        return self.running_sum({name: F.lit(1).cast("long")})

    def key_stats(self, columns: Mapping[str, Column]) -> "Sequenced":
        """Attach whole-key aggregates to every row."""
        if not self.sliced:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({n: agg.over(whole) for n, agg in columns.items()})
        stats = self.df.groupBy(*self.keys).agg(*[agg.alias(n) for n, agg in columns.items()])
        return self._with(salted_attach(self.df, stats, self.keys, F.struct(*self.order)))

    def rows(self) -> DataFrame:
        return self.df.drop(SLICE) if self.sliced else self.df


def sequence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    limit: int = DEFAULT_LIMIT,
) -> Sequenced:
    """Plan slices for ``order`` (numeric columns) inside ``keys``.

    Slices follow the first order column; cells whose first column is constant
    are cut along the next one, so equal timestamps do not defeat the split.
    Nulls and values that are not finite get slices of their own, where a sort
    puts them: null, -inf, finite values, inf, NaN. Null keys are keys.
    """
    keys, order = tuple(keys), tuple(order)
    current = df
    sliced = False
    for _ in range(MAX_LEVELS):
        parts = [*keys, SLICE] if sliced else list(keys)
        bounds = []
        for i, name in enumerate(order):
            kind, value = _kind(name), F.col(name).cast("double")
            finite = F.when(kind == 2, value)
            bounds += [F.min(finite).alias(f"_lo{i}"), F.max(finite).alias(f"_hi{i}")]
            bounds.append((F.min(kind) != F.max(kind)).alias(f"_mixed{i}"))
        cells = (
            current.groupBy(*parts)
            .agg(F.count(F.lit(1)).alias("_n"), *bounds)
            .where((F.col("_n") > limit) & _splittable(len(order)))
            .withColumn("_ways", F.least(F.lit(FAN_OUT - APART), F.ceil(2 * F.col("_n") / limit)).cast("long"))
        )
        if cells.isEmpty():
            break
        inside = F.lit(0).cast("long")
        for i in reversed(range(len(order))):
            kind = _kind(order[i])
            span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
            cut = F.floor((F.col(order[i]).cast("double") - F.col(f"_lo{i}")) / span * F.col("_ways"))
            finite = F.lit(2) + F.when(span > 0, F.least(cut, F.col("_ways") - 1)).otherwise(F.lit(0))
            place = F.when(kind < 2, kind).when(kind > 2, F.col("_ways") + kind - 1).otherwise(finite)
            inside = F.when(_varies(i), place).otherwise(inside)
        base = F.col(SLICE) * FAN_OUT if sliced else F.lit(0).cast("long")
        helper = ["_n", "_ways", *[f"_{b}{i}" for i in range(len(order)) for b in ("lo", "hi", "mixed")]]
        current = (
            null_safe_join(current, F.broadcast(cells), parts)
            .withColumn(SLICE, base + F.coalesce(inside, F.lit(0)))
            .drop(*helper)
        )
        sliced = True
    return Sequenced(current, keys, order, sliced)


def _kind(name: str) -> Column:
    """0 null, 1 -inf, 2 finite, 3 inf, 4 NaN: the order in which a sort puts them."""
    value = F.col(name).cast("double")
    return (
        F.when(value.isNull(), 0)
        .when(F.isnan(value), 4)
        .when(value == float("inf"), 3)
        .when(value == float("-inf"), 1)
        .otherwise(2)
    ).cast("long")


def _varies(i: int) -> Column:
    return F.col(f"_mixed{i}") | F.coalesce(F.col(f"_hi{i}") > F.col(f"_lo{i}"), F.lit(False))


def _splittable(width: int) -> Column:
    condition = F.lit(False)
    for i in range(width):
        condition = condition | _varies(i)
    return condition


def salted_attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread: Column,
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join one stats row per key to many rows without one task per key.

    Rows are spread over ``salts`` sub-keys and the (one row per key) stats are
    repeated for each sub-key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = stats.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return null_safe_join(salted, copies, [*keys, "_salt"], how).drop("_salt")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key from a value/count table.

    Copies of a value collapse first (map side), the remaining distinct values
    are ranked with sliced running counts, and only the rows that sit on a
    wanted rank survive.  No task sees a whole key.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    ranked = sequence(counts, keys, [value], limit).running_sum({"_upto": F.col("_copies")})
    totals = counts.groupBy(*keys).agg(F.sum("_copies").alias("_size"))
    rows = salted_attach(ranked.rows(), totals, keys, F.col(value), how="inner")
    picks = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_size") - 1)
        for side, position in (("l", F.floor(rank)), ("h", F.ceil(rank))):
            hit = (F.col("_upto") - F.col("_copies") <= position) & (position < F.col("_upto"))
            picks.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{side}{i}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"_w{i}"))
    picked = rows.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).alias(name)
            for i, name in enumerate(names)
        ],
    )
