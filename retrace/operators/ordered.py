"""Sequence operators over keyed, time-ordered rows that stay parallel when one key is huge.

A plain `Window.partitionBy(device)` puts a whole device into one task. Here a key is cut into one slice per SLICE_ROWS of
its rows along its order, the window runs inside each (key, slice), and what has to cross a slice border (previous row,
running total, last known value) comes from a table with one row per slice of the keys that were cut: at most two for every
SLICE_ROWS rows of the input. It is checkpointed, so Spark knows its size and broadcasts it only if it is small, and a chain
of operators stays a chain and does not double with every step. Where every key is one slice there are no borders, and the
window alone is left.

The layout is found by counting rows per key, once for a chain: a step on rows derived from an earlier step's takes over that
step's layout (`like`) if its keys are the same, or if no key was cut.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace.session import materialise

SLICE_ROWS = 2_000_000  # rows of one key for one task
REMEMBERED = 256  # layouts kept for frames that are used again

SLICE = "_slice"
HOT = "_hot"


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Null-safe equi-join on columns of the same name, keeping the left copy."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    match = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return left.join(renamed, match, how).drop(*[f"_r_{n}" for n in names])


def _rank_value(df: DataFrame, by: str) -> Column:
    """A number that orders like the column. Texts go by their first six bytes: equal ones share a slice."""
    kind = df.schema[by].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(F.col(by), "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(by).cast("timestamp")).cast("double")
    return F.col(by).cast("double")


_layouts: OrderedDict = OrderedDict()


def hot_bounds(df: DataFrame, keys: list[str], by: str, slice_rows: int = SLICE_ROWS):
    """Borders for `df`, looked up if the same frame was laid out before; borders decide on balance, never on results."""
    name = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), by, slice_rows)
    if name not in _layouts:
        _layouts[name] = _count_bounds(df, keys, by, slice_rows)
        if len(_layouts) > REMEMBERED:
            _layouts.popitem(last=False)
    return _layouts[name]


def _count_bounds(df: DataFrame, keys: list[str], by: str, slice_rows: int) -> list[tuple]:
    """(keys..., slice borders) of each key above `slice_rows`: all in all at most two numbers per `slice_rows` rows."""
    group = keys or [F.lit(0).alias("_all")]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0]
    if not largest or largest <= slice_rows:
        return []
    most = -(-largest // slice_rows)
    steps = F.array(*[F.lit(i / most) for i in range(1, most)])
    borders = F.percentile_approx(_rank_value(df, by), steps, max(2000, 20 * most)).alias("_bounds")
    source = df
    if keys:
        # fewer keys than the input has stretches of `slice_rows` rows
        source = join_same(df, counts.where(F.col("_n") > slice_rows).select(*keys), keys, "left_semi")
    found = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), borders).collect()
    # literal borders keep every evaluation of the plan identical; a smaller key takes every so many of them
    every = lambda r: max(1, most // -(-r["_n"] // slice_rows))
    return [(*[r[k] for k in keys], r["_bounds"][every(r) - 1 :: every(r)]) for r in found]


def _slice_number(value: Column) -> Column:
    """How many borders lie at or below the value; the first of every block is tested before the one block."""
    block = F.size(F.filter("_coarse", lambda b: b <= value))
    inside = F.slice(F.col("_bounds"), block * F.col("_step") + 1, F.col("_step"))
    return block * F.col("_step") + F.size(F.filter(inside, lambda b: b <= value))


@dataclass(frozen=True)
class Ordered:
    """A DataFrame together with its sequence keys, its order and the slice layout."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    by: str
    bounds: tuple = ()

    @staticmethod
    def of(
        df: DataFrame, keys: list[str], order: list[str], by: str | None = None, slice_rows: int = SLICE_ROWS, like: "Ordered | None" = None
    ) -> "Ordered":
        """`like` is an earlier step of which `df` is derived: it has as many rows or fewer of each of its keys, and `keys` are
        these or more."""
        by = by or order[0]
        if like is not None and (not like.sliced or (set(keys) == set(like.keys) and df.schema[by].dataType == like.df.schema[like.by].dataType)):
            rows = [tuple(r[like.keys.index(k)] for k in keys) + (r[-1],) for r in like.bounds]
        else:
            rows = hot_bounds(df, keys, by, slice_rows)
        if not rows:
            return Ordered(df.withColumn(SLICE, F.lit(0)).withColumn(HOT, F.lit(False)), keys, order, by)
        numbers = T.ArrayType(T.DoubleType())
        step = lambda bounds: math.isqrt(len(bounds)) + 1
        packed = [(*r, r[-1][step(r[-1]) - 1 :: step(r[-1])], step(r[-1])) for r in rows]
        names = [T.StructField("_bounds", numbers), T.StructField("_coarse", numbers), T.StructField("_step", T.IntegerType())]
        if keys:
            table = df.sparkSession.createDataFrame(packed, T.StructType([df.schema[k] for k in keys] + names))
            joined = join_same(df, F.broadcast(table), keys, "left")
        else:
            literal = lambda values: F.array(*[F.lit(b) for b in values]).cast(numbers)
            joined = df.withColumns({"_bounds": literal(packed[0][0]), "_coarse": literal(packed[0][1]), "_step": F.lit(packed[0][2])})
        number = F.when(F.col("_bounds").isNull(), 0).otherwise(F.coalesce(_slice_number(_rank_value(df, by)), F.lit(0)))
        out = joined.withColumn(SLICE, number).withColumn(HOT, F.col("_bounds").isNotNull()).drop("_bounds", "_coarse", "_step")
        return Ordered(out, keys, order, by, tuple(rows))

    @property
    def sliced(self) -> bool:
        return bool(self.bounds)

    # -- plumbing -------------------------------------------------------------------------------

    @property
    def window(self):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    @property
    def until_now(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def map(self, fn) -> "Ordered":
        """Apply a row-wise change that keeps keys, order and slice columns."""
        return replace(self, df=fn(self.df))

    def done(self) -> DataFrame:
        return self.df.drop(SLICE, HOT)

    def _borders(self, aggregates: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """One row per hot slice, with values carried over from its neighbours."""
        parts = self.df.where(F.col(HOT)).groupBy(*self.keys, SLICE).agg(*[c.alias(n) for n, c in aggregates.items()])
        return parts.select(*self.keys, SLICE, *[c.alias(n) for n, c in carried.items()])

    def _attach(self, borders: DataFrame) -> DataFrame:
        # stored, so Spark knows its size: broadcast if small, else joined by key and slice, which are even
        return join_same(self.df, materialise(borders), self.keys + [SLICE], "left")

    def _slices(self):
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _neighbour(self, columns: dict[str, str], back: bool) -> "Ordered":
        shift = F.lag if back else F.lead
        step = self.df
        values = {out: shift(F.col(src)).over(self.window) for out, src in columns.items()}
        if not self.sliced:
            return replace(self, df=step.withColumns(values))
        pick = F.max_by if back else F.min_by
        packed = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns.values())])
        borders = self._borders(
            {"_edge": pick(packed, F.struct(*self.order))}, {"_edge": shift(F.col("_edge")).over(self._slices())}
        )
        base = replace(self, df=self._attach(borders))
        at_edge = shift(F.lit(True)).over(self.window).isNull()
        step = base.df.withColumn("_at_edge", at_edge)
        step = step.withColumns({out: shift(F.col(src)).over(self.window) for out, src in columns.items()})
        step = step.withColumns(
            {
                out: F.when(F.col("_at_edge"), F.col("_edge").getField(f"v{i}")).otherwise(F.col(out))
                for i, out in enumerate(columns)
            }
        )
        return replace(self, df=step.drop("_at_edge", "_edge"))

    # -- operators ------------------------------------------------------------------------------

    def lag(self, **columns: str) -> "Ordered":
        """Value of the previous row: `lag(prev_ts="ts")`."""
        return self._neighbour(columns, back=True)

    def lead(self, **columns: str) -> "Ordered":
        return self._neighbour(columns, back=False)

    def running_sum(self, **values: Column) -> "Ordered":
        """Sum up to and including the current row."""
        inner = self.df.withColumns({f"_v_{n}": c for n, c in values.items()})
        base = replace(self, df=inner)
        out = {n: F.sum(f"_v_{n}").over(self.until_now) for n in values}
        if self.sliced:
            before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
            borders = base._borders(
                {f"_c_{n}": F.sum(f"_v_{n}") for n in values},
                {f"_c_{n}": F.sum(f"_c_{n}").over(before) for n in values},
            )
            inner = base._attach(borders)
            out = {n: F.coalesce(c, F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n, c in out.items()}
        step = inner.withColumns(out).drop(*[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])
        return replace(self, df=step)

    def row_number(self, name: str) -> "Ordered":
        return self.running_sum(**{name: F.lit(1).cast("bigint")})

    def last_known(self, **columns: Column) -> "Ordered":
        """Latest non-null value at or before the current row."""
        inner = self.df.withColumns({f"_v_{n}": c for n, c in columns.items()})
        base = replace(self, df=inner)
        out = {n: F.last(f"_v_{n}", ignorenulls=True).over(self.until_now) for n in columns}
        if self.sliced:
            before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
            rank = F.struct(*self.order)
            borders = base._borders(
                {
                    f"_c_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), rank))
                    for n in columns
                },
                {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in columns},
            )
            inner = base._attach(borders)
            out = {n: F.coalesce(c, F.col(f"_c_{n}")) for n, c in out.items()}
        step = inner.withColumns(out).drop(*[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns])
        return replace(self, df=step)

    def islands(self, name: str, value: Column) -> "Ordered":
        """Number the runs of equal neighbouring values (1, 2, ... per key)."""
        step = self.map(lambda d: d.withColumn("_value", value).withColumn("_one", F.lit(True)))
        step = step.lag(_before="_value", _seen="_one")
        start = F.col("_seen").isNull() | ~F.col("_value").eqNullSafe(F.col("_before"))
        step = step.running_sum(**{name: start.cast("bigint")})
        return step.map(lambda d: d.drop("_value", "_one", "_before", "_seen"))

    def gaps(self, name: str, time: str, seconds: float, until: str | None = None) -> "Ordered":
        """Number the groups separated by pauses longer than `seconds` (a pause of exactly that joins)."""
        step = self.lag(_until=until or time)
        pause = F.unix_micros(time) - F.unix_micros("_until")
        start = F.col("_until").isNull() | (pause > F.lit(int(seconds * 1_000_000)))
        return step.running_sum(**{name: start.cast("bigint")}).map(lambda d: d.drop("_until"))
