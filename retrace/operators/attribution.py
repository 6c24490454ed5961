"""Which app a frame belongs to, and what follows from it: usage, exclusion, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.functions.captures import display_name
from retrace.operators.ordered import Ordered, join_same

# Packages that float over the app in front.
OVERLAYS = ["com.android.systemui", "com.android.pixeldisplayservice"]


def as_of(rows: DataFrame, changes: DataFrame, value: str, keys: list[str] = ["device"], tie: list[str] = [], **layout) -> DataFrame:
    """Latest change at or before each row (never the nearest one after); NULL before the first change.

    `keys=["device"]` carries over midnight, `keys=["device", "day"]` starts every day as unknown. Both
    sides share one shuffle: changes are merged into the row stream and sort first on equal times.
    """
    tagged = changes.select(*keys, "ts", F.col(value).alias("_change"), *[c for c in tie if c in changes.columns])
    tagged = tagged.withColumn("_is_row", F.lit(0)).withColumn("_has", F.lit(True))
    stream = rows.withColumn("_is_row", F.lit(1)).unionByName(tagged, allowMissingColumns=True)
    o = Ordered.of(stream, keys, ["ts", "_is_row", *tie], by="ts", **layout)
    o = o.last_known(_found=F.when(F.col("_has"), F.struct("_change")))
    return (
        o.done()
        .where(F.col("_is_row") == 1)
        .withColumn(value, F.col("_found._change"))
        .drop("_is_row", "_change", "_has", "_found")
    )


def is_overlay(pkg: Column, ime: list[str] = []) -> Column:
    """System surfaces and enabled keyboards; launchers are apps in their own right."""
    return pkg.isin(*OVERLAYS, *ime)


def effective_app(frames: DataFrame, overlay: Column, keys: list[str] = ["device"], order: list[str] = ["base"], app="pkg", **layout) -> DataFrame:
    """Give frames attributed to an overlay the last real app before them."""
    o = Ordered.of(frames, keys, ["ts", *order], by="ts", **layout)
    return o.last_known(pkg_eff=F.when(~overlay, F.col(app))).done()


def without_excluded(rows: DataFrame, excluded: DataFrame, app: str = "pkg") -> DataFrame:
    """Excluded apps leave no row, neither among frames nor in the app log."""
    names = excluded.select(F.col(app).alias("_excluded")).distinct()
    return rows.join(names, F.col(app) == F.col("_excluded"), "left_anti")


def stored_frames(frames: DataFrame, uninformative: Column) -> tuple[DataFrame, DataFrame]:
    """(frames to store, times for the app log): blank or zero-byte frames are dropped from the first only."""
    return frames.where(~uninformative & (F.col("bytes") > 0)), frames.select("device", "ts", "pkg")


def latest_labels(app_log: DataFrame) -> DataFrame:
    """Last label written for each package."""
    named = app_log.where(F.col("label").isNotNull())
    return named.groupBy("pkg").agg(F.max_by("label", F.struct("ts", "label")).alias("label"))


def usage(frames: DataFrame, app_log: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Frames and bytes per app. Unknown app is a group; excluded apps without frames appear with zero."""
    counted = frames.groupBy("pkg").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
    if excluded is not None:
        listed = excluded.select("pkg").distinct().withColumn("excluded", F.lit(True))
        counted = counted.join(listed, "pkg", "full")
    else:
        counted = counted.withColumn("excluded", F.lit(False))
    named = join_same(counted, latest_labels(app_log), ["pkg"], "left")
    return named.select(
        "pkg",
        "label",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"),
        display_name(F.col("label"), F.col("pkg")).alias("display_name"),
    )


def usage_order() -> list[Column]:
    return [F.desc("count"), F.asc("display_name")]


def split_groups(usage_rows: DataFrame) -> DataFrame:
    """Excluded apps first, then recorded ones, each in usage order; the unknown app counts as recorded."""
    group = F.when(F.col("excluded") & F.col("pkg").isNotNull(), F.lit("excluded")).otherwise(F.lit("recording"))
    return usage_rows.withColumn("group", group).orderBy("group", *usage_order())


def filter_apps(usage_rows: DataFrame, query: str) -> DataFrame:
    needle = query.strip()
    if not needle:
        return usage_rows
    low = F.lower(F.lit(needle))
    return usage_rows.where(
        F.contains(F.lower("display_name"), low) | F.coalesce(F.contains(F.lower("pkg"), low), F.lit(False))
    )


def images_of_app(images: DataFrame, pkg: str | None) -> DataFrame:
    """Images that belong to one app (NULL selects the unknown ones); logs are never part of it."""
    return images.where(F.col("pkg").eqNullSafe(F.lit(pkg)))


def overlap_seconds(values: DataFrame, value: str, states: DataFrame, keys: list[str] = ["device"], **layout) -> DataFrame:
    """Seconds each value was current while the state was `start`.

    Both change logs are merged into one sequence; every segment between two points has one value and one
    state, so no pairs of intervals are formed. An interval still open at the last point has no length.
    """
    left = values.select(*keys, "ts", F.struct(F.col(value)).alias("_v"), F.lit(None).cast("string").alias("_s"))
    right = states.select(*keys, "ts", F.lit(None).cast(left.schema["_v"].dataType).alias("_v"), F.col("state").alias("_s"))
    merged = left.unionByName(right)
    o = Ordered.of(merged, keys, ["ts", "_v", "_s"], by="ts", **layout)
    o = o.last_known(_value=F.col("_v"), _state=F.col("_s")).lead(_next="ts")
    dark = o.done().where((F.col("_state") == "start") & F.col("_value").isNotNull() & F.col("_next").isNotNull())
    micros = F.unix_micros("_next") - F.unix_micros("ts")
    return dark.groupBy(*keys, F.col(f"_value.{value}").alias(value)).agg(
        (F.sum(micros) / F.lit(1_000_000.0)).alias("seconds")
    ).where(F.col("seconds") > 0)


def audit(frames: DataFrame, keys: list[str] = ["device"], order: list[str] = ["base"], app: str = "pkg", **layout) -> DataFrame:
    """Per app: frames, their share of all frames, number of intervals, total and longest duration."""
    o = Ordered.of(frames, keys, ["ts", *order], by="ts", **layout).islands("run", F.col(app)).lead(_next="ts")
    spans = o.done().groupBy(*keys, "run", app).agg(
        F.count(F.lit(1)).alias("frames"), F.min("ts").alias("start"), F.max(F.coalesce("_next", "ts")).alias("end")
    )
    spans = spans.withColumn("us", F.unix_micros("end") - F.unix_micros("start"))
    per_app = spans.groupBy(app).agg(
        F.sum("frames").alias("frames"),
        F.count(F.lit(1)).alias("intervals"),
        (F.sum("us") / F.lit(1_000_000.0)).alias("total_s"),
        (F.max("us") / F.lit(1_000_000.0)).alias("longest_s"),
    )
    total = per_app.agg(F.sum("frames").alias("n")).scalar()
    return per_app.withColumn("share", F.col("frames") / total)
