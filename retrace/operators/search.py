"""Substring search over lines, grouped to ten-minute windows; passages; timelines under a budget."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.functions.captures import WINDOW_SECONDS, window_id
from retrace.functions.text import contains_term, split_terms
from retrace.operators import dictionary
from retrace.operators.ordered import Ordered

SPLIT_MIN_CHARS = 6
MAX_LINES = 20
MAX_LINE_CHARS = 200
NEWEST_HITS = 300


def in_range(frames: DataFrame, since=None, until=None) -> DataFrame:
    """Time range, inclusive at both ends; None leaves an end open."""
    if since is not None:
        frames = frames.where(F.col("ts") >= F.lit(since))
    if until is not None:
        frames = frames.where(F.col("ts") <= F.lit(until))
    return frames


def _term_numbers(text: Column, patterns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(contains_term(text, p), F.lit(i)) for i, p in enumerate(patterns)]))


def matching_lines(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Dictionary lines holding at least one pattern, with the numbers of the patterns they hold."""
    return lines.withColumn("hits", _term_numbers(F.col("text"), patterns)).where(F.size("hits") > 0)


def matching_text_ids(lines: DataFrame, runs: DataFrame, term: str) -> DataFrame:
    """Ids of the texts holding a term: dictionary lines, then their runs unfolded (no range join)."""
    hits = lines.where(contains_term(F.col("text"), term)).select("line_id")
    return dictionary.expand_runs(runs.join(hits, "line_id", "left_semi")).select("text_id").distinct()


def frames_with_term(frames: DataFrame, lines: DataFrame, runs: DataFrame, term: str) -> DataFrame:
    readable = frames.where(F.col("status") == "ok")
    return readable.join(matching_text_ids(lines, runs, term), "text_id", "left_semi")


def hits_from_text(frames: DataFrame, patterns: list[str], keys: list[str]) -> DataFrame:
    """(keys, ts, line, hits) straight from frames that still carry text; whole texts are tested first."""
    found = frames.where((F.col("status") == "ok") & (F.size(_term_numbers(F.col("text"), patterns)) > 0))
    lines = found.select(*keys, "ts", F.explode(dictionary.split_lines("text")).alias("line"))
    return lines.withColumn("hits", _term_numbers(F.col("line"), patterns)).where(F.size("hits") > 0)


def hits_from_dictionary(store: dictionary.Dictionary, patterns: list[str], keys: list[str]) -> DataFrame:
    """The same hits from the stored dictionary: lines are tested, only runs of hit lines are unfolded and met with frames."""
    lines = matching_lines(store.lines, patterns).select("line_id", F.col("text").alias("line"), "hits")
    places = dictionary.expand_runs(store.runs.join(lines.select("line_id"), "line_id", "left_semi"))
    frames = store.frames.where(F.col("status") == "ok").select(*keys, "ts", "text_id")
    # one row per line and window before the text of the line comes back
    seen = frames.join(places, "text_id").groupBy(*keys, window_id(F.col("ts")).alias("_w"), "line_id").agg(F.max("ts").alias("ts"))
    return seen.join(lines, "line_id").select(*keys, "ts", "line", "hits")


def window_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Latest sight of each hit line per window; combines before the shuffle."""
    return (
        hits.groupBy(*keys, window_id(F.col("ts")).alias("win"), "line", "hits")
        .agg(F.max("ts").alias("last_seen"))
    )


def rank_windows(per_line: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """Windows by number of distinct terms hit, then by latest hit."""
    terms = per_line.select(*keys, "win", "last_seen", F.explode("hits").alias("term"))
    scored = terms.groupBy(*keys, "win", "term").agg(F.max("last_seen").alias("last_seen"))
    scored = scored.groupBy(*keys, "win").agg(
        F.count(F.lit(1)).alias("matched_terms"), F.max("last_seen").alias("latest")
    )
    if limit is None:
        return scored
    order = [F.desc("matched_terms"), F.desc("latest"), *[F.asc(k) for k in keys], F.desc("win")]
    return scored.orderBy(*order).limit(limit)


def search(
    source: DataFrame | dictionary.Dictionary,
    query: str,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    limit: int | None = 10,
    keys: list[str] = ["device"],
    max_lines: int | None = MAX_LINES,
    max_chars: int | None = MAX_LINE_CHARS,
) -> DataFrame:
    """Windowed multi-term search: the best `limit` windows, each with up to `max_lines` of its hit lines, cut to `max_chars`.

    None lifts a limit: all windows, all lines, whole lines.

    One phrase of six characters or more that is found nowhere is retried as its two halves (either may
    match), marked `partial`. The halves are found in the same pass as the phrase, since a line with the
    phrase always holds both halves.
    """
    terms = split_terms(query)
    if not terms:
        raise ValueError("query is empty")
    can_split = len(terms) == 1 and len(terms[0]) >= SPLIT_MIN_CHARS
    half = len(terms[0]) // 2
    patterns = [terms[0], terms[0][:half], terms[0][half:]] if can_split else terms

    if isinstance(source, dictionary.Dictionary):
        ranged = replace(source, frames=in_range(source.frames, since, until))
        hits = hits_from_dictionary(ranged, patterns, keys)
    else:
        hits = hits_from_text(in_range(source, since, until), patterns, keys)
    lines = window_hits(hits, keys)

    partial = F.lit(False)
    if can_split:
        exact = F.array_contains("hits", 0)
        found = lines.agg(F.coalesce(F.max(exact), F.lit(False)).alias("found")).scalar()
        partial = ~found
        lines = lines.where(exact | partial).withColumn("hits", F.array(F.lit(0)))
    ranked = rank_windows(lines, keys, limit)
    picked = lines.join(ranked, [*keys, "win"])  # broadcast by Spark if the caller's limit leaves little
    w = Window.partitionBy(*keys, "win").orderBy("last_seen", "line")
    top = picked.withColumn("line_no", F.row_number().over(w))
    if max_lines is not None:
        top = top.where(F.col("line_no") <= max_lines)
    return top.select(
        *keys,
        F.timestamp_seconds(F.col("win") * WINDOW_SECONDS).alias("start"),
        F.timestamp_seconds((F.col("win") + 1) * WINDOW_SECONDS).alias("end"),
        "matched_terms",
        "latest",
        partial.alias("partial"),
        "line_no",
        (F.col("line") if max_chars is None else F.substring("line", 1, max_chars)).alias("line"),
    )


# -- trigram table ------------------------------------------------------------------------------


trigrams = dictionary.trigrams


def _buckets(table: DataFrame, wanted: list[str]) -> list[int]:
    """Folders of the wanted grams, computed without a table."""
    rows = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in wanted])).alias("gram"))
    return sorted({r[0] for r in rows.select(dictionary.gram_bucket(F.col("gram"))).collect()})


def search_with_trigrams(lines: DataFrame, table: DataFrame, term: str) -> DataFrame:
    """Lines holding the term: all its trigrams first, then the substring test itself."""
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not wanted:
        return lines.where(contains_term(F.col("text"), term))
    candidates = (
        # the buckets reach a stored table's scan as a partition filter
        table.where(F.col("bucket").isin(_buckets(table, wanted)) & F.col("gram").isin(wanted))
        .groupBy("line_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return lines.join(candidates, "line_id", "left_semi").where(contains_term(F.col("text"), term))


# -- passages -----------------------------------------------------------------------------------


def passages(frames: DataFrame, images: DataFrame | None = None, keys: list[str] = ["device", "day"]) -> DataFrame:
    """Collapse neighbouring frames of one day that show the same text.

    Frames that are not ok or blank are left out first, so they never end a passage. With `images`
    (keys, base) each passage also names its latest frame whose image survives.
    """
    shown = frames.where((F.col("status") == "ok") & (F.trim(F.col("text"), F.lit(" \t\r\n")) != ""))
    if images is not None:
        kept = images.select(*keys, "base").distinct().withColumn("_image", F.lit(True))
        shown = shown.join(kept, [*keys, "base"], "left")
    else:
        shown = shown.withColumn("_image", F.lit(None).cast("boolean"))
    slim = shown.select(*keys, "base", "ts", "text", "_image", F.sha2("text", 256).alias("_digest"))
    runs = Ordered.of(slim, keys, ["ts", "base"], by="ts").islands("run", F.col("_digest")).done()
    out = runs.groupBy(*keys, "run").agg(
        F.min("base").alias("first_base"),
        F.max("base").alias("last_base"),
        F.count(F.lit(1)).alias("count"),
        F.first("text").alias("text"),
        F.max(F.when(F.col("_image"), F.col("base"))).alias("image_base"),
    )
    return out.drop("run")


def search_passages(frames: DataFrame, term: str, limit: int = NEWEST_HITS) -> DataFrame:
    """Newest frames holding the term, limited first and collapsed afterwards (the limit bounds the window)."""
    found = frames.where((F.col("status") == "ok") & contains_term(F.col("text"), term))
    newest = found.orderBy(F.desc("ts"), F.desc("device"), F.desc("base")).limit(limit)
    w = Window.orderBy(F.desc("ts"), F.desc("device"), F.desc("base"))
    same = F.col("text").eqNullSafe(F.lag("text").over(w)) & F.col("day").eqNullSafe(F.lag("day").over(w))
    runs = newest.withColumn("rn", F.row_number().over(w)).withColumn("_start", ~same)
    runs = runs.withColumn("run", F.sum(F.col("_start").cast("bigint")).over(w))
    out = runs.groupBy("run", "day").agg(
        F.min_by("base", "rn").alias("first_base"),
        F.max_by("base", "rn").alias("last_base"),
        F.count(F.lit(1)).alias("count"),
        F.min_by("text", "rn").alias("text"),
    )
    total = F.sum("count").over(Window.partitionBy())
    return out.withColumn("truncated", total >= limit)


# -- timeline -----------------------------------------------------------------------------------


def window_lines(frames: DataFrame, keys: list[str] = ["device"]) -> DataFrame:
    """Distinct lines per window with their first appearance (time, frame, place in the frame)."""
    shown = frames.where((F.col("status") == "ok") & (F.col("text") != ""))
    lines = shown.select(
        *keys,
        window_id(F.col("ts")).alias("win"),
        "ts",
        "base",
        F.posexplode(dictionary.split_lines("text")).alias("pos", "line"),
    )
    firsts = lines.groupBy(*keys, "win", "line").agg(F.min(F.struct("ts", "base", "pos")).alias("first"))
    return firsts.select(*keys, "win", "line", "first.ts", "first.base", "first.pos")


def timeline(
    frames: DataFrame,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    max_chars: int = 20000,
    keys: list[str] = ["device"],
) -> DataFrame:
    """Lines of each window in first-appearance order, cut where the window's share of `max_chars` ends.

    The share is `max_chars` divided by the number of windows. The cut is a prefix because every line costs
    its length plus one.
    """
    ranged = in_range(frames, since, until)
    shown = ranged.where((F.col("status") == "ok") & (F.col("text") != ""))
    counted = shown.groupBy(*keys, window_id(F.col("ts")).alias("win")).agg(F.count(F.lit(1)).alias("frames"))
    share = counted.groupBy(*keys).agg(F.floor(F.lit(max_chars) / F.count(F.lit(1))).alias("budget"))
    lines = window_lines(ranged, keys).withColumn("cost", F.length("line") + 1)
    used = Ordered.of(lines, [*keys, "win"], ["ts", "base", "pos"], by="ts").running_sum(
        used=F.col("cost").cast("bigint"), line_no=F.lit(1).cast("bigint")
    )
    budgeted = used.done().join(share, keys)
    inside = F.col("used") <= F.col("budget")
    totals = budgeted.groupBy(*keys, "win").agg(F.sum((~inside).cast("bigint")).alias("omitted_lines"))
    body = budgeted.where(inside).select(*keys, "win", "line_no", "line")
    heads = counted.join(totals, [*keys, "win"])
    return (
        heads.join(body, [*keys, "win"], "left")
        .withColumn("truncated", F.col("omitted_lines") > 0)
        .select(
            *keys,
            F.timestamp_seconds(F.col("win") * WINDOW_SECONDS).alias("start"),
            "frames",
            "line_no",
            "line",
            "omitted_lines",
            "truncated",
        )
    )


# -- checks of a stored dictionary ---------------------------------------------------------------


def compare_searches(old: DataFrame, new: DataFrame, words: list[str]) -> DataFrame:
    """Per word: frames found by the old and the new path, and how many differ."""
    pairs = None
    for side, frames in (("old", old), ("new", new)):
        found = frames.where(F.col("status") == "ok").select(
            "device", "day", "base", F.explode(_words_in(F.col("text"), words)).alias("word"), F.lit(side).alias("side")
        )
        pairs = found if pairs is None else pairs.unionByName(found)
    per_frame = pairs.groupBy("word", "device", "day", "base").agg(
        F.max(F.col("side") == "old").alias("in_old"), F.max(F.col("side") == "new").alias("in_new")
    )
    return per_frame.groupBy("word").agg(
        F.sum(F.col("in_old").cast("bigint")).alias("old_hits"),
        F.sum(F.col("in_new").cast("bigint")).alias("new_hits"),
        F.sum((F.col("in_old") != F.col("in_new")).cast("bigint")).alias("differing"),
    )


def _words_in(text: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(contains_term(text, w), F.lit(w)) for w in words]))
