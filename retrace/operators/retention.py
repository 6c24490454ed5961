"""Which captures may be deleted. Deleting itself is left to the caller."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.operators.ordered import Ordered

GB = 1_000_000_000
LAPTOP = {"budget": 40 * GB, "days": 3, "watermark_tenths": 10}
PHONE = {"budget": 10 * GB, "days": 14, "watermark_tenths": 9}


def decide(
    captures: DataFrame,
    now: dt.datetime,
    budget: int,
    days: int,
    watermark_tenths: int = 10,
    keys: list[str] = ["device"],
    order: list[str] = ["base"],
    **layout,
) -> DataFrame:
    """Decision per capture: `delete`, `blocked` (due, but its text is not secured) or `keep`.

    Captures are considered from the oldest on while they are past the age limit or the space still in use
    exceeds the limit. Once over budget, the limit drops to the watermark (tenths of the budget). Space in use
    before a row is the total minus the secured bytes of older rows; both tests hold on a prefix, so they need
    only a running sum.
    """
    cutoff = now - dt.timedelta(days=days)
    o = Ordered.of(captures, keys, ["ts", *order], by="ts", **layout)
    freed = F.when(F.col("secured"), F.col("bytes")).otherwise(0)
    rows = o.running_sum(_freed=freed.cast("bigint")).done()
    totals = captures.groupBy(*keys).agg(F.sum("bytes").alias("_total"))
    limit = F.when(F.col("_total") > budget, F.lit(budget // 10 * watermark_tenths)).otherwise(F.lit(budget))
    if watermark_tenths == 10:
        limit = F.lit(budget)
    left = F.col("_total") - (F.col("_freed") - freed)
    due = (F.col("ts") < F.lit(cutoff)) | (left > limit)
    decision = F.when(due & F.col("secured"), "delete").when(due, "blocked").otherwise("keep")
    return rows.join(totals, keys).withColumn("decision", decision).drop("_freed", "_total")


def summary(decisions: DataFrame, keys: list[str] = ["device"]) -> DataFrame:
    deleted = F.col("decision") == "delete"
    return decisions.groupBy(*keys).agg(
        F.sum(deleted.cast("bigint")).alias("deleted"),
        F.sum(F.when(deleted, F.col("bytes")).otherwise(0)).alias("freed_bytes"),
        F.sum((F.col("decision") == "blocked").cast("bigint")).alias("blocked"),
    )
