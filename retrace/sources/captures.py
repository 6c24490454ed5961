"""Capture archives: image listings, day directories, text-bearing days."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.functions.captures import DAY_PATTERN, base_of, capture_time, day_of, gen_of


def listing(spark: SparkSession, root: str, device: str | None = "local", days: list[str] | None = None) -> DataFrame:
    """Images below `root/<day>/`: names, sizes and times only. File contents are never read.

    With `days` only those folders are listed. Without a `device` the archive is `root/<device>/<day>/` and the folder names it.
    """
    below = root.rstrip("/") + ("/*" if device is None else "")
    reader = (
        spark.read.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.[jJ][pP][gG]")
        .option("recursiveFileLookup", "true")
    )
    try:
        files = reader.load(root if days is None else f"{below}/{{{','.join(days)}}}")
    except AnalysisException as missing:
        if days is None or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long")  # none of the days is there
    return describe(files.select("path", "length", "modificationTime"), device, days)


def add_to_listing(captures: DataFrame, out: str, batch: int) -> None:
    """Add a batch of captures to a stored listing: rows in folders by day, and captures per day. A retry overwrites its own."""
    captures.write.mode("overwrite").partitionBy("day").parquet(f"{out}/rows/batch={batch}")
    captures.groupBy("day").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/days/batch={batch}")


def follow(spark: SparkSession, root: str, out: str, device: str | None = None, files_per_batch: int = 100_000) -> None:
    """Add the images that are new below `root` since the last call to the listing in `out`.

    The stream remembers what it has seen, so nobody holds all images at once; contents are never read.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.[jJ][pP][gG]")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    add = lambda batch, number: add_to_listing(in_day_directories(describe(batch, device)), out, number)
    query = files.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()


def newest(spark: SparkSession, out: str, limit: int) -> DataFrame:
    """The newest `limit` captures of a stored listing; only the days that can hold one of them are read."""
    if limit <= 0:
        return spark.read.parquet(f"{out}/rows").limit(0)
    per_day = spark.read.parquet(f"{out}/days").groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("day"))
    needed, seen = [], 0
    for row in per_day.limit(limit).collect():  # one row per calendar day, and no more days than captures wanted
        if seen >= limit:
            break
        needed.append(row["day"])
        seen += row["n"]
    rows = spark.read.parquet(f"{out}/rows").where(F.col("day").isin(needed)).withColumn("day", F.col("day").cast("string"))
    return rows.orderBy(F.desc("day"), F.desc("base"), F.desc("device")).limit(limit)


def describe(files: DataFrame, device: str | None = "local", days: list[str] | None = None) -> DataFrame:
    """Day, base name, generation and capture time from the path; names outside the convention have no time."""
    path = F.col("path")
    named = files.withColumn("day", day_of(path)).withColumn("base", base_of(path)).withColumn("gen", gen_of(path))
    visible = ~F.regexp_extract(path, r"([^/]+)$", 1).startswith(".")
    out = named.where(visible).select(
        (F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1) if device is None else F.lit(device)).alias("device"),
        "day",
        "base",
        "gen",
        capture_time(F.col("day"), F.col("base")).alias("ts"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
        "path",
    )
    return out.where(F.col("day").isin(days)) if days else out


def in_day_directories(captures: DataFrame) -> DataFrame:
    return captures.where(F.col("day").rlike(DAY_PATTERN) & F.col("ts").isNotNull())


def one_per_base(captures: DataFrame) -> DataFrame:
    """The generation is not part of a capture's identity; the lowest generation stands for it."""
    return captures.groupBy("device", "day", "base").agg(
        F.min_by(F.struct("gen", "ts", "bytes", "modified", "path"), F.struct("gen", "path")).alias("c")
    ).select("device", "day", "base", "c.*")


def remote_listing(files: DataFrame) -> DataFrame:
    """File names and sizes per day as a listing shows them: unfinished uploads are hidden."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(day_of(F.col("path")).alias("day"), name.alias("name"), F.col("length").alias("bytes"))
    return rows.where(F.col("day").rlike(DAY_PATTERN) & ~F.col("name").endswith(".tmp")).orderBy("day", "name")
