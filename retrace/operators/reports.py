"""Aggregates over frames, logs and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.functions.captures import day_name, duration_text, format_bytes, window_id
from retrace.functions.text import squeeze, strip_all
from retrace.operators import folds, intervals
from retrace.operators.dictionary import split_lines
from retrace.operators.ordered import Ordered
from retrace.session import materialise


def _rows() -> Column:
    return F.count(F.lit(1))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def _shuffled(seed: int, *columns: str) -> Column:
    """Repeatable random order: a digest of seed and identity."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


# -- archive ------------------------------------------------------------------------------------


def days(frames: DataFrame) -> DataFrame:
    """Readable frames per day."""
    return frames.where(F.col("status") == "ok").groupBy("day").agg(_rows().alias("shots"))


def span(day_rows: DataFrame) -> DataFrame:
    return day_rows.agg(_rows().alias("days"), F.min("day").alias("first_day")).withColumn(
        "span",
        F.when(F.col("days") == 0, "—").otherwise(F.concat(F.col("days").cast("string"), F.lit(" 日分（"), "first_day", F.lit("〜）"))),
    )


def archive_stats(captures: DataFrame) -> DataFrame:
    """Count, size and covered time. Rows: bytes, ts (NULL for odd names), modified."""
    at = F.coalesce("ts", "modified")
    return captures.agg(
        _rows().alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min(at).alias("first"), F.max(at).alias("last")
    ).select("*", format_bytes(F.col("bytes")).alias("size_text"), duration_text(F.col("first"), F.col("last")).alias("duration_text"))


def status_report(frames: DataFrame, now: Column) -> DataFrame:
    """Range of days, frames, latest readable time, and the last hour's frames by status."""
    recent = frames.where(F.unix_micros("ts") >= F.unix_micros(now) - F.lit(3_600_000_000))
    hour = recent.groupBy("status").agg(_rows().alias("n"))
    packed = hour.agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("l")).scalar()
    return frames.agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        _rows().alias("frames"),
        F.max(F.when(F.col("status") == "ok", F.col("ts"))).alias("latest_ok"),
    ).withColumn("last_hour", packed)


def latest(captures: DataFrame, limit: int) -> DataFrame:
    """Newest captures by day and base name."""
    return captures.orderBy(F.desc("day"), F.desc("base"), F.desc("device")).limit(max(limit, 0))


def backfill_report(frames: DataFrame) -> DataFrame:
    return frames.groupBy("status").agg(_rows().alias("n"), F.avg("ocr_ms").alias("mean_ms"))


def missing(captures: DataFrame, frames: DataFrame, retry_failed: bool, keys=("device", "day", "base")) -> DataFrame:
    """Captures that still need reading. With `retry_failed`, failed reads count as missing."""
    known = frames.where(F.col("status") != "failed") if retry_failed else frames
    return captures.join(known.select(*keys), list(keys), "left_anti")


def missing_per_day(todo: DataFrame) -> DataFrame:
    return todo.groupBy("day").agg(_rows().alias("remaining"))


def long_form(row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table, values as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.inline(pairs))


def ingest_report(sources: dict[str, DataFrame], shots: DataFrame, bad: DataFrame) -> DataFrame:
    """(metric, value) rows: rows per source, unresolved apps, rejected rows and the covered days; each table is read once."""
    seen = shots.agg(_count(F.col("pkg").isNull()).alias("unresolved"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    out = long_form(seen)
    for name, df in [*sources.items(), ("bad", bad)]:
        out = out.unionByName(long_form(df.agg(_rows().alias(name))))
    return out


# -- distributions ------------------------------------------------------------------------------


def order_statistics(df: DataFrame, value: str, points: list[float], keys: list[str] = [], cap: float | None = None, **layout) -> DataFrame:
    """Exact percentiles without interpolation: the element at min(n - 1, int(n * p)) of the sorted values.

    Equal values are counted first, so a value that fills a third of the rows is one weighted row.
    """
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(_rows().alias("_w"))
    o = Ordered.of(grouped, keys, [value], by=value, **layout).running_sum(_cum=F.col("_w"))
    level = lambda p: min(p, cap) if cap is not None else p
    place = lambda n, p: F.least(n - 1, F.floor(n * F.lit(float(level(p)))).cast("bigint"))
    wanted = lambda n: F.array(*[F.struct(F.lit(float(p)).alias("p"), place(n, p).alias("k")) for p in points])
    total = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(wanted(_rows()).alias("_targets"))
    if keys:
        placed = o.done().join(total, keys)
    else:
        placed = o.done().withColumn("_targets", total.scalar())
    inside = lambda t: (t["k"] >= F.col("_cum") - F.col("_w")) & (t["k"] < F.col("_cum"))
    hits = F.filter("_targets", inside)
    return placed.select(*keys, F.explode(hits).alias("t"), value).select(*keys, F.col("t.p").alias("p"), value)


def loss_report(decisions: DataFrame, worst: int = 3, **layout) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text lost by folding: percentiles, share above ten percent, and the worst frames per threshold."""
    dropped = materialise(decisions.where(~F.col("kept")))  # folded once, read for the layout and for each table
    points = order_statistics(dropped, "loss", [0.5, 0.75, 0.9, 0.95, 0.99, 1.0], ["thr"], cap=0.999, **layout)
    over = dropped.groupBy("thr").agg(
        _rows().alias("dropped"), _count(F.col("loss") > 0.10).alias("over"),
    ).withColumn("over_pct", F.lit(100.0) * F.col("over") / F.col("dropped"))
    w = Window.partitionBy("thr").orderBy(F.desc("loss"), "ts", "base")
    top = dropped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= worst)
    return points, over, top


def adjacent_differences(signatures: DataFrame, difference, keys=["device", "day"], order=["base"], sig="sig", **layout) -> DataFrame:
    """Difference of each signature to the one before it on the same day."""
    o = Ordered.of(signatures, keys, order, by=layout.pop("by", order[0]), **layout).lag(_before=sig)
    rows = o.done().where(F.col("_before").isNotNull())
    return rows.withColumn("diff", difference(F.col("_before"), F.col(sig))).drop("_before")


def difference_thresholds(diffs: DataFrame, thresholds: list[float], per_second: float = 0.5) -> DataFrame:
    """How many frames stay when neighbours differing by at most the threshold fold together."""
    sums = [F.struct(F.lit(float(t)).alias("thr"), (_count(F.col("diff") > t) + 1).alias("kept")) for t in thresholds]
    out = diffs.agg(_rows().alias("n"), F.array(*sums).alias("rows")).where(F.col("n") > 0)
    out = out.select("n", F.inline("rows"))
    return out.select(
        "thr",
        "kept",
        (F.lit(100.0) * F.col("kept") / F.col("n")).alias("pct"),
        (F.col("kept") / F.lit(per_second) / 3600).alias("hours"),
    )


def latency_profile(frames: DataFrame, **layout) -> DataFrame:
    """Median and p90 of read time and the least-squares line over the number of lines."""
    points = order_statistics(frames, "ocr_ms", [0.5, 0.9], **layout)
    at = lambda p: points.where(F.col("p") == p).agg(F.max("ocr_ms").alias("v")).scalar()
    return frames.agg(
        _rows().alias("n"), F.regr_slope("ocr_ms", "lines").alias("ms_per_line"), F.regr_intercept("ocr_ms", "lines").alias("base_ms")
    ).select("*", at(0.5).alias("median_ms"), at(0.9).alias("p90_ms"))


# -- corpus -------------------------------------------------------------------------------------


def kept_sessions(decisions: DataFrame, gap: float = 300, keys=["device"], carry: list[str] = [], **layout) -> DataFrame:
    """Collapsed frames with their session; the pause counts from the end of the previous dwell."""
    kept = materialise(folds.collapse(decisions, keys, carry))  # folded once, read for the layout and the sessions
    return intervals.sessions(kept, gap, [*keys, "thr"], until="until", **layout)


def corpus_summary(frames: DataFrame, sessions: DataFrame, prices: dict[str, float] = {"small": 0.10, "large": 3.0}) -> DataFrame:
    """One row: frames, characters, days, what collapsing leaves, sessions, token and cost estimates.

    `sessions` are the kept frames of one threshold with their session; they are folded and read once. One character counts
    as one token; prices are per million tokens.
    """
    kept = sessions.agg(
        _rows().alias("kept_frames"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("kept_chars"),
        F.count_distinct("device", "session").alias("sessions"),
    )
    whole = frames.agg(
        _rows().alias("frames"),
        F.sum(F.length("text")).cast("bigint").alias("raw_chars"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_distinct("day").alias("days"),
    )
    out = whole.crossJoin(kept)  # one row each
    out = out.withColumn("char_reduction_pct", F.lit(100.0) * (F.lit(1.0) - F.col("kept_chars") / F.col("raw_chars")))
    for name, price in prices.items():
        out = out.withColumn(f"cost_{name}", F.col("kept_chars") / F.lit(1e6) * F.lit(price))
    first = next(iter(prices))
    return out.withColumn("cost_per_day", F.col(f"cost_{first}") / F.greatest("days", F.lit(1)))


def longest_sessions(sessions: DataFrame, limit: int = 15) -> DataFrame:
    """Sessions with most text: frames, minutes, characters."""
    per = intervals.session_summary(sessions, until="until", chars=F.col("chars"))
    minutes = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(60_000_000.0)
    return per.withColumn("minutes", minutes).orderBy(F.desc("chars"), "device", "session").limit(limit)


def session_detail(sessions: DataFrame, device: str, session: int, limit: int = 20) -> DataFrame:
    """First frames of one session, with the `head` of the text they carry through the fold."""
    one = sessions.where((F.col("device") == device) & (F.col("session") == session))
    return one.orderBy("ts", "base").limit(limit)


def timeline_head(text: Column, chars: int) -> Column:
    return F.substring(squeeze(text), 1, chars)


def human_timeline(sessions: DataFrame) -> DataFrame:
    """`[HH:mm xDwell] head` for every kept frame; `head` came through the fold."""
    dwell = F.when(F.col("dwell") > 1, F.concat(F.lit("x"), F.col("dwell").cast("string"))).otherwise(F.lit("  "))
    line = F.concat(F.lit("["), F.date_format("ts", "HH:mm"), F.lit(" "), dwell, F.lit("] "), F.col("head"))
    return sessions.select("device", "session", "ts", "base", line.alias("line"))


# -- comparisons of two readings -----------------------------------------------------------------


def compare_versions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two versions of a table: which side lacks them, or which columns changed."""
    values = [c for c in old.columns if c not in keys]
    left = old.select(*keys, F.struct(*values).alias("_old"))
    right = new.select(*keys, F.struct(*values).alias("_new"))
    both = left.join(right, keys, "full")
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in values])
    )
    side = F.when(F.col("_new").isNull(), "only_old").when(F.col("_old").isNull(), "only_new").otherwise("changed")
    out = both.select(*keys, side.alias("side"), F.when(side == "changed", differing).alias("columns"))
    return out.where((F.col("side") != "changed") | (F.size("columns") > 0))


def character_coverage(pairs: DataFrame) -> DataFrame:
    """Share of the non-space characters of `text_a` whose character occurs anywhere in `text_b`."""
    chars = lambda c: F.filter(F.split(strip_all(F.col(c)), ""), lambda ch: ch != "")
    slim = pairs.select(chars("text_a").alias("a"), F.array_distinct(chars("text_b")).alias("b"))
    kept = F.size(F.filter("a", lambda ch: F.array_contains("b", ch)))
    return slim.agg(F.sum(kept).cast("bigint").alias("kept"), F.sum(F.size("a")).cast("bigint").alias("total")).withColumn(
        "coverage", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("kept") / F.col("total"))
    )


def layout_effect(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per frame: lines before, lines and regions after the layout step, and boxes that it cut (`layout.cut_counts`)."""
    lines = lambda c: F.size(F.filter(split_lines(c), lambda s: s != "")).cast("bigint")
    return pairs.join(cuts, "frame_id", "left").select(
        "frame_id",
        lines("text_a").alias("old_lines"),
        lines("text_b").alias("new_lines"),
        F.size(F.split("text_b", "\n\n", -1)).cast("bigint").alias("regions"),
        F.coalesce("cut", F.lit(0)).alias("cut"),
    )


def text_survival(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Per generation: mean lines, kept character share, share of lines with a near match.

    `pairs(gen, text_a, text_b)` holds the first and the later reading of a frame. Two lines match when
    1 - levenshtein / longer length reaches the threshold.
    """
    non_blank = lambda c: F.filter(split_lines(c), lambda s: s != "")
    a, b = non_blank("text_a"), non_blank("text_b")


    def close(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        allowed = (F.floor(longer * (1 - threshold)) + 1).cast("int")  # one more than can match
        # lengths alone rule most pairs out; the distance is not followed beyond the bound (then it is -1)
        distance = F.when(F.abs(F.length(x) - F.length(y)) <= allowed, F.call_function("levenshtein", x, y, allowed))
        return F.coalesce((distance >= 0) & (F.lit(1.0) - distance / longer >= threshold), F.lit(False))

    near = lambda x: F.exists(b, lambda y: close(x, y))
    exact = lambda x: F.array_contains(b, x) | near(x)
    return pairs.groupBy("gen").agg(
        F.avg(F.size(b)).alias("mean_lines"),
        (F.sum(F.least(F.length("text_b"), F.length("text_a"))) / F.sum(F.length("text_a"))).alias("kept_chars"),
        (F.sum(F.size(F.filter(a, exact))) / F.sum(F.size(a))).alias("matched_lines"),
    )


def stratified_sample(frames: DataFrame, strata: int, per_stratum: int, seed: int = 7, **layout) -> DataFrame:
    """Frames spread over quantiles of their line count, the same number from each.

    Frames of one device at the same time of different days share a digest; their day decides between them.
    """
    o = Ordered.of(frames, [], ["lines", "device", "base", "day"], by="lines", **layout).row_number("_n")
    total = frames.agg(_rows().alias("n")).scalar()
    banded = o.done().withColumn("stratum", F.floor((F.col("_n") - 1) * strata / total).cast("bigint"))
    w = Window.partitionBy("stratum").orderBy(_shuffled(seed, "device", "base"), "device", "base", "day")
    return banded.withColumn("_pick", F.row_number().over(w)).where(F.col("_pick") <= per_stratum).drop("_n", "_pick")


def rare_lines(frames: DataFrame, max_windows: int = 2, min_chars: int = 3000, sample: int = 25, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(lines seen in few windows of their day, sampled windows with enough text)."""
    shown = frames.where((F.col("status") == "ok") & (F.col("text") != ""))
    win = window_id(F.col("ts")).alias("win")
    lines = shown.select("device", "day", win, F.explode(split_lines("text")).alias("line")).distinct()
    rare = lines.groupBy("device", "day", "line").agg(_rows().alias("windows")).where(F.col("windows") <= max_windows)
    size = lines.groupBy("device", "win").agg(F.sum(F.length("line") + 1).cast("bigint").alias("chars"))
    large = size.where(F.col("chars") >= min_chars)
    picked = large.orderBy(_shuffled(seed, "device", "win"), "device", "win").limit(sample)
    return rare, picked


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, hit_at: int = 5, rank_at: int = 10) -> DataFrame:
    """hit@k and MRR@k per query class from (class, query, item, rank) and relevant (query, item)."""
    queries = ranked.select("class", "query").distinct()
    good = ranked.join(relevant.select("query", "item").distinct(), ["query", "item"], "left_semi")
    best = good.groupBy("class", "query").agg(F.min("rank").alias("best"))
    scored = queries.join(best, ["class", "query"], "left")
    return scored.groupBy("class").agg(
        _rows().alias("queries"),
        F.avg(F.when(F.col("best") <= hit_at, 1.0).otherwise(0.0)).alias("hit"),
        F.avg(F.when(F.col("best") <= rank_at, F.lit(1.0) / F.col("best")).otherwise(0.0)).alias("mrr"),
    )
