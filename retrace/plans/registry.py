"""Registered queries: a Spark callable and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["Tables"], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(Tables(prepare(spark), folder)))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: times as microseconds, all integers as BIGINT."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column.cast("timestamp"))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


class Tables:
    """The test tables seen as screen history."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def jittered(self) -> DataFrame:
        """Documents as frames whose pauses vary: one millisecond later per character."""
        return self.frames(late=F.col("n_chars"))

    def frames(self, device: str = "source", late=None) -> DataFrame:
        """One document per five-second tick."""
        micros = (F.lit(1704067200) + F.col("doc_id") * 5) * 1_000_000
        ts = F.timestamp_micros(micros if late is None else micros + late * 1000)
        docs = self.table("documents").withColumn("ts", ts)
        return docs.select(
            F.col(device).alias("device"),
            F.date_format("ts", "yyyy-MM-dd").alias("day"),
            F.date_format("ts", "HHmmss_SSS").alias("base"),
            "ts",
            "text",
            F.when(F.trim("text") == "", "empty").otherwise("ok").alias("status"),
            F.col("n_chars").alias("bytes"),
            F.col("lang").alias("pkg"),
            "doc_id",
        )

    def events(self) -> DataFrame:
        """Activity of users: one row per event with the event type as state or app."""
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("user_id").alias("device"),
            ts.alias("ts"),
            F.date_format(ts, "yyyy-MM-dd").alias("day"),
            F.date_format(ts, "HHmmss_SSS").alias("base"),
            "event_id",
            "event_type",
            "value",
            "props",
        )

    def signatures(self) -> DataFrame:
        """Embeddings as gray signatures of 0..255, one label per device."""
        gray = F.transform(
            "embedding",
            lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1.0) * 128.0), F.lit(0)), F.lit(255)).cast("int"),
        )
        return self.table("embeddings").select(
            F.col("label").alias("device"), F.lit("2024-01-01").alias("day"), F.col("vec_id").alias("base"), gray.alias("sig")
        )


# SQL counterparts of the views above, to be put behind WITH.
FRAMES = """frames AS (
  SELECT source AS device, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H%M%S_%g') AS base, ts, text,
         CASE WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status, n_chars AS bytes, lang AS pkg, doc_id
  FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 5) AS ts FROM documents))"""
JITTERED = FRAMES.replace("to_seconds(doc_id * 5)", "to_seconds(doc_id * 5) + to_milliseconds(n_chars)")
LANG_FRAMES = FRAMES.replace("source AS device", "lang AS device")
EVENTS = """ev AS (
  SELECT user_id AS device, ts, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H%M%S_%g') AS base,
         event_id, event_type, value, props
  FROM events)"""
SIGNATURES = """sigs AS (
  SELECT CAST(label AS BIGINT) AS device, '2024-01-01' AS day, vec_id AS base,
         list_transform(embedding, lambda v: CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1.0) * 128.0), 0), 255) AS INTEGER)) AS sig
  FROM embeddings)"""
LINES = """lines_all AS (
  SELECT device, day, base, ts, doc_id, text, status, pkg, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM frames WHERE text <> '')"""
LINE_IDS = """line_ids AS (
  SELECT line, row_number() OVER (ORDER BY f) AS line_id
  FROM (SELECT line, min({'ts': ts, 'device': device, 'base': base, 'pos': pos}) AS f FROM lines_all GROUP BY line))"""
TEXT_IDS = """text_ids AS (
  SELECT text, row_number() OVER (ORDER BY f) AS text_id
  FROM (SELECT text, min({'ts': ts, 'device': device, 'base': base}) AS f FROM frames WHERE text <> '' GROUP BY text))"""
PAIRS = """pairs AS (
  SELECT DISTINCT line_id, text_id FROM lines_all JOIN line_ids USING (line) JOIN text_ids USING (text))"""
KEY = """CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT)"""


def key_sql(text: str) -> str:
    unsigned = f"CAST(CAST('0x' || substr(sha256({text}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return KEY.replace("u >=", f"{unsigned} >=").replace("THEN u -", f"THEN {unsigned} -").replace("ELSE u", f"ELSE {unsigned}")


def shingles_sql(text: str) -> str:
    """Distinct 4-grams without white space; the one-element list binds the characters once."""
    chars = f"string_split(regexp_replace({text}, '\\s+', '', 'g'), '')"
    return (
        f"list_transform([list_filter({chars}, lambda x: x <> '')], lambda c: "
        "CASE WHEN len(c) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(c) < 4 THEN [array_to_string(c, '')] ELSE "
        "list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) END)[1]"
    )
