"""Sessions, runs and intervals rebuilt from change points."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.functions.captures import day_name, seconds_between
from retrace.operators.ordered import Ordered

# Each gap state and the state that ends it.
GAP_RESOLVERS = {"sleep": "wake", "screens_off": "screens_on", "locked": "unlocked", "capture_failed": "capture_ok"}


def sessions(frames: DataFrame, gap: float, keys: list[str] = ["device"], order: list[str] = ["base"], until=None,
             **layout) -> DataFrame:
    """Number sessions per key: a pause longer than `gap` seconds (strictly) since the last row starts one."""
    o = Ordered.of(frames, keys, ["ts", *order], by="ts", **layout)
    return o.gaps("session", "ts", gap, until=until).done()


def session_summary(frames: DataFrame, keys: list[str] = ["device"], until: str = "ts", chars: Column | None = None) -> DataFrame:
    size = F.lit(0) if chars is None else chars
    return frames.groupBy(*keys, "session").agg(
        F.min("ts").alias("start"),
        F.max(until).alias("end"),
        F.count(F.lit(1)).alias("frames"),
        F.sum(size).cast("bigint").alias("chars"),
    )


def runs(rows: DataFrame, value: str, keys: list[str], order: list[str] = ["base"], **layout) -> DataFrame:
    """Islands of equal neighbouring values: value, first and last time, rows."""
    return _spans(Ordered.of(rows, keys, ["ts", *order], by="ts", **layout).islands("run", F.col(value)), value, order)


def _spans(o: Ordered, value: str, order: list[str]) -> DataFrame:
    return o.done().groupBy(*o.keys, "run").agg(
        F.min_by(value, F.struct("ts", *order)).alias(value),
        F.min("ts").alias("start"),
        F.max("ts").alias("last"),
        F.count(F.lit(1)).alias("rows"),
    )


def app_runs(frames: DataFrame, keys: list[str] = ["device"], app: str = "pkg", **layout) -> DataFrame:
    """Runs of one app inside a session. A run ends where the next one starts, or with its session."""
    inside = [*keys, "session"]
    o = Ordered.of(frames, inside, ["ts", "base"], by="ts", **layout).islands("run", F.col(app))
    o = Ordered.of(_spans(o, app, ["base"]), inside, ["start", "run"], by="start", like=o, **layout).lead(_next="start")
    return (
        o.done()
        .withColumn("end", F.coalesce("_next", "last"))
        .withColumn("switched", F.col("_next").isNotNull())
        .withColumn("span_s", seconds_between(F.col("end"), F.col("start")))
        .drop("_next")
    )


def changes_only(rows: DataFrame, value: str, keys: list[str], order: list[str] = ["base"], **layout) -> DataFrame:
    """Change-point log: rows whose value differs from the row before, and the first row of each day."""
    known = rows.where(F.col(value).isNotNull()).withColumn("_day", day_name(F.col("ts")))
    o = Ordered.of(known, keys, ["ts", *order], by="ts", **layout).lag(_before=value, _before_day="_day")
    changed = ~F.col(value).eqNullSafe(F.col("_before")) | ~F.col("_day").eqNullSafe(F.col("_before_day"))
    return o.done().where(changed).drop("_before", "_before_day", "_day")


def blackout_log(frames: DataFrame, flag: str, keys: list[str] = ["device"], order: list[str] = ["base"], **layout) -> DataFrame:
    """`start` when a frame turns uninformative or stays so over midnight, `end` when it turns informative."""
    rows = frames.withColumn("_day", day_name(F.col("ts")))
    o = Ordered.of(rows, keys, ["ts", *order], by="ts", **layout).lag(_was=flag, _was_day="_day")
    was = F.coalesce(F.col("_was"), F.lit(False))
    rolled = F.col("_was_day").isNotNull() & (F.col("_was_day") != F.col("_day"))
    state = F.when(F.col(flag) & (~was | rolled), "start").when(~F.col(flag) & was, "end")
    return o.done().withColumn("state", state).where(F.col("state").isNotNull()).drop("_was", "_was_day", "_day")


def state_intervals(points: DataFrame, state: str, keys: list[str] = ["device"], order: list[str] = [], **layout) -> DataFrame:
    """Intervals from change points: a state lasts until the next point; repeats of a state merge."""
    o = Ordered.of(points, keys, ["ts", *order], by="ts", **layout).lag(_before=state)
    changed = ~F.col(state).eqNullSafe(F.col("_before"))
    starts = o.done().where(changed).drop("_before")
    nxt = Ordered.of(starts, keys, ["ts", *order], by="ts", like=o, **layout).lead(end="ts")
    return nxt.done().withColumnRenamed("ts", "start").select(*keys, state, "start", "end")


def gap_intervals(points: DataFrame, keys: list[str] = ["device"], order: list[str] = [], **layout) -> DataFrame:
    """Why there are no frames: each gap state until its own resolver, independent of the other states."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable((b, a) for a, b in GAP_RESOLVERS.items())])
    opens = F.col("state").isin(*GAP_RESOLVERS)
    kind = F.when(opens, F.col("state")).otherwise(F.element_at(pairs, F.col("state")))
    marked = points.withColumn("gap", kind).where(F.col("gap").isNotNull()).withColumn("_open", opens)
    spans = state_intervals(marked, "_open", [*keys, "gap"], order, **layout)
    return spans.where(F.col("_open")).drop("_open")


def gap_log(points: DataFrame, keys: list[str] = ["device"], order: list[str] = [], **layout) -> DataFrame:
    """Suppress repeats of an active gap and resolvers of an inactive one; other states pass unchanged."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable((b, a) for a, b in GAP_RESOLVERS.items())])
    opens = F.col("state").isin(*GAP_RESOLVERS)
    marked = points.withColumn("_gap", F.when(opens, F.col("state")).otherwise(F.element_at(pairs, F.col("state"))))
    marked = marked.withColumn("_open", opens)
    gaps = Ordered.of(marked.where(F.col("_gap").isNotNull()), [*keys, "_gap"], ["ts", *order], by="ts", **layout)
    effective = gaps.lag(_before="_open").done().where(
        F.col("_open") != F.coalesce(F.col("_before"), F.lit(False))
    )
    plain = marked.where(F.col("_gap").isNull()).withColumn("_before", F.lit(None).cast("boolean"))
    return effective.unionByName(plain).drop("_gap", "_open", "_before")


def failure_streak(rows: DataFrame, failed: Column, keys: list[str], order: list[str], threshold: int = 10, **layout) -> DataFrame:
    """Rows where the run of consecutive failures reaches a multiple of the threshold."""
    o = Ordered.of(rows.withColumn("_failed", failed), keys, ["ts", *order], by="ts", **layout)
    o = o.islands("_run", F.col("_failed"))
    inner = Ordered.of(o.done(), [*keys, "_run"], ["ts", *order], by="ts", like=o, **layout).row_number("streak")
    out = inner.done().where(F.col("_failed") & (F.col("streak") % threshold == 0))
    return out.drop("_failed", "_run")


def stride_sample(rows: DataFrame, want: int, keys: list[str], order: list[str], **layout) -> DataFrame:
    """Every max(1, n / want)-th row in order, at most `want` per key."""
    o = Ordered.of(rows, keys, order, by=order[0], **layout).row_number("_n")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / want))
    at = F.col("_n") - 1
    joined = o.done().join(sizes, keys)
    return joined.where((at % step == 0) & (at / step < want)).drop("_n", "_total")
