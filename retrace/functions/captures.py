"""Expressions over capture paths, stems, times and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
WINDOW_SECONDS = 600


def day_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def gen_of(path: Column) -> Column:
    gen = F.regexp_extract(_stem(path), r"\.g([123])$", 1)
    return F.when(gen == "", F.lit(0)).otherwise(gen.cast("int"))


def base_of(path: Column) -> Column:
    return F.regexp_replace(_stem(path), r"\.g[123]$", "")


def capture_time(day: Column, base: Column) -> Column:
    """Time written in directory and file name; NULL for names outside the convention."""
    return F.try_to_timestamp(F.concat(day, F.lit(" "), base), F.lit("yyyy-MM-dd HHmmss_SSS"))


def stem_of(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss_SSS")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def window_id(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def clock_text(base: Column) -> Column:
    clock = F.concat_ws(":", F.substring(base, 1, 2), F.substring(base, 3, 2), F.substring(base, 5, 2))
    return F.when(F.length(base) >= 6, clock).otherwise(base)


def duration_text(first: Column, last: Column) -> Column:
    seconds = F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(1_000_000)).cast("bigint")
    days = F.floor(seconds / 86400)
    hours = F.floor((seconds % 86400) / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    as_text = lambda c: c.cast("bigint").cast("string")
    return (
        F.when(first.isNull() | last.isNull() | ~(last > first), F.lit("—"))
        .when(days > 0, F.concat(as_text(days), F.lit("日と"), as_text(hours), F.lit("時間")))
        .when(hours > 0, F.concat(as_text(hours), F.lit("時間"), as_text(minutes), F.lit("分")))
        .otherwise(F.concat(as_text(minutes), F.lit("分")))
    )


def format_bytes(size: Column) -> Column:
    """Decimal units with one digit, plain bytes below one thousand."""
    scaled = lambda power, unit: F.format_string("%.1f " + unit, size / F.lit(float(10**power)))
    return (
        F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < 10**6, scaled(3, "KB"))
        .when(size < 10**9, scaled(6, "MB"))
        .when(size < 10**12, scaled(9, "GB"))
        .otherwise(scaled(12, "TB"))
    )


def display_name(label: Column, pkg: Column) -> Column:
    return F.coalesce(label, pkg, F.lit("不明"))
