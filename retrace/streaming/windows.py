"""Streaming sessions, counts and deduplication, none of which depends on how far other devices are; fresh-plus-backlog ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.streaming.machines import Sessions
from retrace.streaming.stateful import DELAY_MS, SLICE_MS, STATE_STORE, run_machine


def sessions(stream: DataFrame, gap_seconds: int, delay_ms: int = DELAY_MS, slice_ms: int = SLICE_MS, key: str = "device") -> DataFrame:
    """Sessions of each device, given out once its own horizon is a pause behind them."""
    return run_machine(stream, Sessions(gap_seconds), key, delay_ms=delay_ms, slice_ms=slice_ms)


def status_counts(batch: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(start, status, n) of a batch; counts of batches add up, whenever a row comes."""
    counted = batch.groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def last_hour(counts: DataFrame, now) -> DataFrame:
    """Counts of the windows of the last hour before `now`, a value or a column."""
    recent = counts.where(F.col("start") >= (now if hasattr(now, "alias") else F.lit(now)) - F.expr("INTERVAL 1 HOUR"))
    return recent.groupBy("status").agg(F.sum("n").alias("n"))


def once(stream: DataFrame, identity: list[str], keep_ms: int = 3_600_000) -> DataFrame:
    """Overlapping queries deliver rows twice; each identity passes once.

    An identity is remembered for `keep_ms` of the machine's clock at least, whatever its event time: a device may be as late as
    it likes. The watermark is one of the clock, of which all rows of a batch have the same time, so none is too late.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    clocked = stream.withColumn("_clock", F.current_timestamp()).withWatermark("_clock", f"{keep_ms} milliseconds")
    return clocked.dropDuplicatesWithinWatermark(identity).drop("_clock")


def ingest(fresh: DataFrame, backlog: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """New files and the backlog through one query, so that one writer at a time merges into the table.

    Each batch takes what is new and as much of the backlog as its source's rate limit (`maxFilesPerTrigger`) lets through;
    new files don't wait for the backlog to end.
    """
    both = fresh.unionByName(backlog, allowMissingColumns=True)
    return both.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()
