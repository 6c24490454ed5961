"""Frame tables and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.functions.captures import day_name
from retrace.session import materialise
from retrace.sources.logs import last_written

FRAME_KEY = ["device", "day", "base"]


def history(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """Frames from a day-partitioned table; a day list prunes partitions."""
    frames = spark.read.parquet(path)
    return frames.where(F.col("day").isin(days)) if days else frames


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str] = FRAME_KEY, sequence: str | None = None) -> DataFrame:
    """Merge so that a fresh row replaces every column of the stored row with its key.

    Of several fresh rows with one key the one with the largest `sequence` wins, for instance the place in the log they were
    read from. Without a sequence, or where it ties, the largest row by its columns in order wins, whatever order they come in.
    """
    shared = [F.col(c) for c in fresh.columns if c in stored.columns and c not in keys and c != sequence]
    rank = F.struct(F.lit(1), (F.col(sequence) if sequence else F.lit(None).cast("bigint")).alias("s"), F.struct(*shared).cast("string"))
    new = fresh.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in fresh.columns if c not in keys]), rank).alias("_row"))
    new = new.select(*keys, "_row.*")
    if sequence and sequence not in stored.columns:
        new = new.drop(sequence)
    merged = stored.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return last_written(merged, keys, "_gen").drop("_gen")


def write_frames(frames: DataFrame, path: str) -> None:
    """Rewrite only the days present in `frames`."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def touched(spark: SparkSession, path: str, days: list[str]) -> DataFrame:
    """Stored frames of the given days; the day list reaches the scan as a partition filter."""
    return spark.read.parquet(path).where(F.col("day").isin(days))


def upsert_table(
    spark: SparkSession, path: str, fresh: DataFrame, keys: list[str] = FRAME_KEY, sequence: str | None = None
) -> None:
    """Upsert into a day-partitioned table; only the days of `fresh` are read and rewritten.

    One writer at a time: streams that feed one table share one query (see `streaming.windows.ingest`). The merged days are
    stored aside first, since a table cannot be overwritten while it is read.
    """
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # one value per calendar day of the batch
    if days:
        write_frames(materialise(upsert(touched(spark, path, days), fresh, keys, sequence)), path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append change points as JSON lines in day directories, below a directory per device where there is that column.

    Every call adds files, so `streaming.live` can follow the folder.
    """
    folders = [c for c in ("device",) if c in rows.columns] + ["day"]
    rows.withColumn("day", day_name(F.col("ts"))).drop("ts").write.mode("append").partitionBy(*folders).json(path)


def write_candidates(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)
