"""Trigger candidates from sessions of frames: (device, kind, ts, session, detail, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.functions.captures import seconds_between
from retrace.functions.text import signals
from retrace.operators import folds, intervals
from retrace.operators.ordered import Ordered

# Fixed values of the trigger rules.
SESSION_GAP = 180
RETURN_GAP = 1200
RETURN_FRAMES = 6
LONG_SESSION = 900
LONG_DWELL = 1500
APP_SPAN = 600
STUCK_SIMILARITY = 0.90
STUCK_FRAMES = 8
NIGHT_HOURS = (1, 5)
NIGHT_SESSION = 1800
COOLDOWN = 1200
CONTEXT_SIMILARITY = 0.88
CONTEXT_CHARS = 400


def _minutes(seconds):
    # round half to even, as printf-style formatting does
    return F.bround(seconds / 60.0, 0).cast("bigint").cast("string")


def _candidate(df: DataFrame, kind, detail, score: int) -> DataFrame:
    return df.select("device", kind.alias("kind"), "ts", "session", detail.alias("detail"), F.lit(score).alias("score"))


def returns(frames: DataFrame, sessions: DataFrame, gap: float = RETURN_GAP, anchor: int = RETURN_FRAMES, **layout) -> DataFrame:
    """Back after a long pause; reported at the sixth frame, when the screen has settled."""
    back = Ordered.of(sessions, ["device"], ["start"], by="start", **layout).lag(_end="end").done()
    away = seconds_between(F.col("start"), F.col("_end"))
    back = back.where((away >= gap) & (F.col("frames") >= anchor)).withColumn("_away", away).select("device", "session", "_away")
    w = Window.partitionBy("device", "session").orderBy("ts", "base")
    # the rank limit is applied before the shuffle, so a session sends at most `anchor` rows per task
    nth = frames.select("device", "session", "ts", "base").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= anchor)
    hit = nth.where(F.col("_n") == anchor).join(back, ["device", "session"])
    return _candidate(hit, F.lit("return"), F.concat(_minutes(F.col("_away")), F.lit(" 分ぶりに画面を点けた")), 2)


def session_ends(sessions: DataFrame, minimum: float = LONG_SESSION) -> DataFrame:
    length = seconds_between(F.col("end"), F.col("start"))
    hit = sessions.where(length >= minimum).withColumn("ts", F.col("end"))
    return _candidate(hit, F.lit("session_end"), F.concat(_minutes(length), F.lit(" 分のセッションが終わる直前")), 1)


def late_nights(sessions: DataFrame, minimum: float = NIGHT_SESSION, hours=NIGHT_HOURS) -> DataFrame:
    length = seconds_between(F.col("end"), F.col("start"))
    hour = F.hour("end")
    hit = sessions.where((length >= minimum) & hour.between(*hours)).withColumn("ts", F.col("end"))
    detail = F.concat(F.lit("深夜 "), hour.cast("string"), F.lit(" 時台に "), _minutes(length), F.lit(" 分連続"))
    return _candidate(hit, F.lit("late_night"), detail, 3)


def apps_done(app_runs: DataFrame, minimum: float = APP_SPAN) -> DataFrame:
    hit = app_runs.where(F.col("span_s") >= minimum).withColumn("ts", F.col("end"))
    detail = F.concat(F.col("pkg"), F.lit(" を "), _minutes(F.col("span_s")), F.lit(" 分見て切り替えた"))
    return _candidate(hit, F.lit("app_done"), detail, 2)


def long_dwells(frames: DataFrame, minimum: float = LONG_DWELL, **layout) -> DataFrame:
    """Frames far into one app run, at least `minimum` apart per device (a long run fires again)."""
    o = Ordered.of(frames, ["device", "session"], ["ts", "base"], by="ts", **layout).islands("_run", F.col("pkg"))
    # time order makes the first row of a run its start
    starts = o.done().groupBy("device", "session", "_run").agg(F.min("ts").alias("_start"))
    inside = o.done().join(starts, ["device", "session", "_run"])
    age = seconds_between(F.col("ts"), F.col("_start"))
    eligible = inside.where(age >= minimum).select("device", "session", "ts", "base", "pkg", age.alias("_age"))
    kept = folds.thin(eligible, minimum, ["device"], ["base"], **layout).where(F.col("kept"))
    detail = F.concat(F.col("pkg"), F.lit(" に "), _minutes(F.col("_age")), F.lit(" 分"))
    return _candidate(kept, F.lit("long_dwell"), detail, 3)


def stuck(frames: DataFrame, repeats: int = STUCK_FRAMES, similarity: float = STUCK_SIMILARITY, tick: int = 10, **layout) -> DataFrame:
    """The screen stayed nearly the same for `repeats` frames in a row; once per run."""
    marks = folds.near_duplicates(frames, [similarity], ["device", "session"], both_empty=0.0, **layout)
    hit = marks.where(F.col("repeats") == repeats)
    return _candidate(hit, F.lit("stuck"), F.lit(f"同じ画面のまま {repeats * tick} 秒"), 2)


def first_signals(frames: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """First frame of a session for each signal category."""
    named = frames.select("device", "session", "ts", F.explode(signals(F.col("text"), categories)).alias("_name"))
    first = named.groupBy("device", "session", "_name").agg(F.min("ts").alias("ts"))
    return _candidate(first, F.concat(F.lit("signal:"), "_name"), F.concat(F.lit("「"), "_name", F.lit("」の画面")), 4)


def signal_counts(frames: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    return frames.select(F.explode(signals(F.col("text"), categories)).alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("frames")
    )


def candidates(frames: DataFrame, gap: float = SESSION_GAP, categories=None, **layout) -> DataFrame:
    """All triggers over frames (device, ts, base, text, pkg); the cooldown comes after."""
    split = intervals.sessions(frames, gap, **layout)
    per_session = intervals.session_summary(split)
    parts = [
        returns(split, per_session, **layout),
        session_ends(per_session),
        long_dwells(split, **layout),
        apps_done(intervals.app_runs(split, **layout)),
        stuck(split, **layout),
        first_signals(split, categories),
        late_nights(per_session),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cooldown(rows: DataFrame, seconds: float = COOLDOWN, **layout) -> DataFrame:
    """Keep candidates at least `seconds` apart per device, higher scores first on equal times."""
    ranked = rows.withColumn("_rank", -F.col("score"))
    return folds.thin(ranked, seconds, ["device"], ["_rank", "kind", "session"], **layout).drop("_rank")


def context(
    kept: DataFrame,
    frames: DataFrame,
    back: float = 900,
    limit: int = 22,
    similarity: float = CONTEXT_SIMILARITY,
    **layout,
) -> DataFrame:
    """The last `limit` near-distinct frames of the `back` seconds before each candidate.

    The time range is an equi-join: a candidate meets the frames of its own and of the previous time slot,
    each `back` long, and nothing else.
    """
    step = int(back * 1_000_000)
    slot = F.floor(F.unix_micros("ts") / step).cast("bigint")
    asked = kept.select("device", F.col("ts").alias("at"), "kind", "session").withColumn(
        "_slot", F.explode(F.array(F.floor(F.unix_micros("at") / step).cast("bigint"),
                                   (F.floor(F.unix_micros("at") / step) - 1).cast("bigint")))
    )
    seen = frames.select("device", "ts", "day", "base", "pkg", "text").withColumn("_slot", slot)
    near = seen.join(asked, ["device", "_slot"]).where(
        (F.col("ts") <= F.col("at")) & (F.unix_micros("ts") >= F.unix_micros("at") - step)
    )
    ids = ["device", "at", "kind", "session"]
    near = near.withColumn("_cut", F.substring("text", 1, CONTEXT_CHARS))
    marked = folds.near_duplicates(near, [similarity], ids, both_empty=0.0, extra=["pkg", "_cut"], **layout)
    w = Window.partitionBy(*ids).orderBy(F.desc("ts"), F.desc("base"))
    last = marked.where("kept").withColumn("back_no", F.row_number().over(w)).where(F.col("back_no") <= limit)
    return last.select(*ids, "ts", "base", "pkg", "back_no", F.col("_cut").alias("text"))


def export(kept: DataFrame, contexts: DataFrame) -> DataFrame:
    """One nested row per candidate with its context in time order (at most the context limit)."""
    ids = ["device", "at", "kind", "session"]
    item = F.struct("ts", F.date_format("ts", "HH:mm").alias("t"), "pkg", "text")
    packed = contexts.groupBy(*ids).agg(F.array_sort(F.collect_list(item)).alias("context"))
    rows = kept.withColumnRenamed("ts", "at").join(packed, ids, "left")
    return rows.select(
        "*",
        F.date_format("at", "yyyy-MM-dd").alias("day"),
        F.date_format("at", "HH:mm").alias("time"),
    )


def report(kept: DataFrame) -> DataFrame:
    """Kept candidates by kind and by day."""
    kinds = kept.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    days = kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("by", F.lit("kind")).unionByName(days.withColumn("by", F.lit("day")))
