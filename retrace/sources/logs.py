"""JSON-lines logs in day directories, read tolerantly: bad rows are set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace import schemas
from retrace.functions.captures import capture_time

FILES = {
    "ocr": ("ocr.jsonl", schemas.OCR_LOG),
    "apps": ("apps.jsonl", schemas.APP_LOG),
    "blackouts": ("blackouts.jsonl", schemas.BLACKOUT_LOG),
    "gaps": ("gaps.jsonl", schemas.GAP_LOG),
    "keys": ("keys.jsonl", schemas.KEY_LOG),
}

DUMP_ROW = r"^\s*time=(\d+) type=ACTIVITY_(RESUMED|PAUSED|STOPPED) package=(\S+) class=(\S+) instanceId=(\d+)"


#: a folder's name, or the value of a partition folder `day=...`
_FOLDER = r"(?:[^/=]*=)?([^/=]+)"


def located(text: DataFrame) -> DataFrame:
    """Lines with their place, from the file's metadata: path and start of the file's split."""
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def in_order(lines: DataFrame) -> DataFrame:
    """Day and byte order of located lines: order inside a split follows the row id, splits follow their start."""
    day = F.regexp_extract("path", _FOLDER + "/[^/]+$", 1)
    return lines.withColumn("seq", F.struct("block", F.monotonically_increasing_id().alias("row"))).withColumn("day", day)


def raw_lines(spark: SparkSession, root: str, file_name: str) -> DataFrame:
    """Lines of one log file of every day, with their place: day, path, byte-ordered line number."""
    return in_order(located(spark.read.option("pathGlobFilter", file_name).option("recursiveFileLookup", "true").text(root)))


def parse(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Attach the parsed row and the reason why a line is unusable: `invalid` (no JSON) or `no t`; blank lines vanish."""
    text = F.trim("value")
    loose = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json(text, loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(text != "").withColumn("row", row)
    # a JSON value that is no object, or an object without t
    reason = F.when(F.try_parse_json(text).isNull(), "invalid").when(F.col("row.t").isNull(), "no t")
    return rows.withColumn("reason", reason)


def judged(lines: DataFrame, schema: T.StructType, device: str | None = "local") -> tuple[DataFrame, DataFrame]:
    """(rows, bad-row ledger) of lines in order; without a `device` it is the folder above the day.

    The ledger (device, day, path, line_no, reason, line) has whole lines. Line numbers count within one file, which holds one
    day of one device; they are only worked out when the ledger is read.
    """
    owner = (F.regexp_extract("path", _FOLDER + "/[^/]+/[^/]+$", 1) if device is None else F.lit(device)).alias("device")
    parsed = parse(lines, schema)
    good = parsed.where(F.col("reason").isNull()).select(owner, "day", "row.*", "seq").drop("_corrupt")
    in_file = Window.partitionBy("path").orderBy("seq")
    numbered = parse(lines.withColumn("line_no", F.row_number().over(in_file)), schema)
    bad = numbered.where(F.col("reason").isNotNull()).select(owner, "day", "path", "line_no", "reason", F.col("value").alias("line"))
    return with_time(good), bad


def read(spark: SparkSession, root: str, kind: str, device: str | None = "local") -> tuple[DataFrame, DataFrame]:
    """(rows, bad-row ledger) of one log kind, see `judged`."""
    file_name, schema = FILES[kind]
    return judged(raw_lines(spark, root, file_name), schema, device)


def ledger_report(bad: DataFrame, first: int = 5, chars: int = 80) -> DataFrame:
    """(total, shown): number of bad rows and the first few, by file and line, with the head of their line."""
    item = F.struct("path", "line_no", "reason", F.substring("line", 1, chars).alias("head"))
    shown = bad.orderBy("path", "line_no").limit(first).agg(F.sort_array(F.collect_list(item)).alias("shown"))
    return bad.agg(F.count(F.lit(1)).alias("total")).crossJoin(shown)  # one row each


def with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", capture_time(F.col("day"), F.col("t"))).withColumnRenamed("t", "base")


def ocr_entries(rows: DataFrame) -> DataFrame:
    """Rows of the text log that count as readings: a status is required, missing numbers are zero."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("gen", "w", "h", "bytes", "lines", "ms")}
    return rows.where(F.col("status").isNotNull()).withColumns({**zero, "text": F.coalesce("text", F.lit(""))})


def app_entries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("base").isNotNull() & F.col("pkg").isNotNull())


def attempted_stems(lines: DataFrame) -> DataFrame:
    """Stems whose reading was tried, failed and torn rows included: only the head of the line is looked at."""
    stem = F.regexp_extract("value", r'^\{"t":"([^"]+)"', 1)
    return lines.select("day", stem.alias("base")).where(F.col("base") != "").distinct()


def secured_stems(entries: DataFrame) -> DataFrame:
    """Stems whose text is settled: read, or read as empty."""
    return entries.where(F.col("status").isin("ok", "empty")).select("device", "day", "base").distinct()


def last_written(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key, the one written last; the rest of the row follows it (upsert semantics)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def activity_dump(spark: SparkSession, path: str, device: str = "local") -> DataFrame:
    """Activity events from a usage dump: matching rows, exact duplicates once, numbered in time order."""
    return parse_dump(spark.read.text(path), device)


def parse_dump(lines: DataFrame, device: str = "local") -> DataFrame:
    """Events in the `value` lines of a usage dump; what isn't an event is left out."""
    part = lambda i: F.regexp_extract("value", DUMP_ROW, i)
    rows = lines.where(F.col("value").rlike(DUMP_ROW)).select(
        F.lit(device).alias("device"),
        part(1).cast("bigint").alias("time"),
        part(2).alias("type"),
        part(3).alias("pkg"),
        part(4).alias("cls"),
        part(5).alias("instance_id"),
    )
    return rows.dropDuplicates()


def to_frames(entries: DataFrame) -> DataFrame:
    """Text-log entries as frames."""
    return entries.select(
        "device", "day", "base", "gen", "ts", F.col("w").alias("width"), F.col("h").alias("height"), "bytes", "text",
        "lines", F.col("ms").alias("ocr_ms"), "status", "err",
    )


def status_norm(status: Column) -> Column:
    """Backfills wrote `error` where readers know `failed`; the raw value is kept beside this one."""
    return F.when(status == "error", "failed").otherwise(status)
