"""The dictionary as a stored, growing history.

Every append is a folder `append=N` in each table and becomes visible with its row in `appends`, which is written last; an
append that failed is overwritten by the next try. Old ids never move, so an append has to know of the history only
which lines and texts there are (`keys`, `text_keys`: 128-bit digests with their ids) and which runs reach the last text id
(`tail`). Other runs are closed: they are written once and never read again by an append.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retrace.functions.text import contains_term, text_key
from retrace.operators import dictionary as D
from retrace.session import materialise

SCHEMAS = {
    "keys": "digest binary, line_id bigint, append int",
    "text_keys": "digest binary, text_id bigint, append int",
    "tail": "line_id bigint, first_text bigint, last_text bigint, append int",
    "grams": "gram string, line_id bigint, append int",
    "gram_counts": "gram string, lines bigint, append int",
    "appends": "last_line bigint, last_text bigint, append int",
}

#: lines in one packed row of a trigram, and bytes of lines whose trigrams are packed together
GRAM_LINES = 1024
GRAM_BYTES = 4 << 20
#: ids that rise within a trigram are stored as differences
RISING = {"parquet.writer.version": "v2", "parquet.enable.dictionary#line_id": "false"}
_HIGH, _MIDDLE, _CHAR = np.uint64(42), np.uint64(21), np.uint64((1 << 21) - 1)


def digest(text: Column) -> Column:
    """128 bits of SHA-256: equal digests are taken as equal texts."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


@dataclass(frozen=True)
class Store:
    """A folder as of one append."""

    spark: SparkSession
    folder: str
    append: int
    last_line: int
    last_text: int

    def table(self, name: str) -> DataFrame:
        """Rows of all appends up to this one; of `tail` those of this one."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA") or name not in SCHEMAS:
                raise
            rows = self.spark.createDataFrame([], SCHEMAS[name])
        upto = F.col("append") == self.append if name == "tail" else F.col("append") <= self.append
        return rows.where(upto).drop("append")

    def dictionary(self) -> D.Dictionary:
        runs = self.table("runs").unionByName(self.table("tail"))
        frames = self.table("frames")
        frames = frames.withColumn("day", F.col("day").cast("string"))
        return D.Dictionary(self.table("lines"), self.table("texts"), frames, runs, self.table("grams"))


def open_store(spark: SparkSession, folder: str) -> Store:
    """The store as of its last finished append; a folder without one is an empty store."""
    newest = Store(spark, folder, 1 << 30, 0, 0)
    try:
        rows = spark.read.schema(SCHEMAS["appends"]).parquet(f"{folder}/appends")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Store(spark, folder, -1, 0, 0)
    last = rows.agg(F.max(F.struct("append", "last_line", "last_text")).alias("r")).first()["r"]
    return newest if last is None else Store(spark, folder, last["append"], last["last_line"], last["last_text"])


def append(spark: SparkSession, folder: str, fresh: DataFrame, rank: list[str] = D.RANK) -> Store:
    """Add frames (device, day, base, ts, text, ...) and return the store with them. One writer at a time."""
    store = open_store(spark, folder)
    number = store.append + 1

    def write(rows: DataFrame, name: str, *by: str, **options: str) -> DataFrame:
        writer = rows.write.mode("overwrite").options(compression="zstd", **options)
        (writer.partitionBy(*by) if by else writer).parquet(f"{folder}/{name}/append={number}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}/append={number}")

    written = fresh.where(F.col("text") != "")
    place = written.select(*rank, F.posexplode(D.split_lines(F.col("text"))).alias("pos", "line"))
    seen = place.groupBy(digest(F.col("line")).alias("digest")).agg(F.min(F.struct(*rank, "pos")).alias("first"), F.first("line").alias("text"))
    unseen = seen.join(store.table("keys"), "digest", "left_anti").drop("digest")
    added = D.dense_ids(unseen, ["first"], "line_id", store.last_line + 1)
    lines = write(added.select("line_id", text_key("text").alias("key"), "text"), "lines")
    keys = write(lines.select(digest(F.col("text")).alias("digest"), "line_id"), "keys")

    # of a text only its digest and those of its lines are moved and kept
    listed = F.transform(D.split_lines(F.col("text")), digest)
    body = written.select(*rank, digest(F.col("text")).alias("digest"), text_key("text").alias("key"), listed.alias("listed"))
    distinct = body.groupBy("digest").agg(F.min(F.struct(*rank)).alias("first"), F.first("key").alias("key"), F.first("listed").alias("listed"))
    unseen = distinct.join(store.table("text_keys"), "digest", "left_anti")
    new_texts = D.dense_ids(unseen, ["first"], "text_id", store.last_text + 1)
    text_keys = write(new_texts.select("digest", "text_id"), "text_keys")
    texts = write(with_line_ids(new_texts, store.table("keys").unionByName(keys)), "texts")
    write(point_frames(fresh, store.table("text_keys").unionByName(text_keys)), "frames", "day")

    ends = lines.agg(F.max("line_id")).first()[0], texts.agg(F.max("text_id")).first()[0]
    last_line, last_text = ends[0] or store.last_line, ends[1] or store.last_text
    runs = materialise(grown_runs(store, D.line_runs(D.postings(texts))))
    still_open = F.col("last_text") == last_text
    write(runs.where(~still_open).repartitionByRange("line_id").sortWithinPartitions("line_id"), "runs")
    write(runs.where(still_open), "tail")

    # sorted ranges: a search skips files and row groups by their least and largest gram, and a gram that most lines have is
    # cut like any other stretch of rows
    packed = packed_grams(lines).repartitionByRange("gram", "line_id").sortWithinPartitions("gram", "line_id")
    postings = write(unpacked_grams(packed), "grams", **RISING)
    write(postings.groupBy("gram").agg(F.count("*").alias("lines")).repartitionByRange("gram").sortWithinPartitions("gram"), "gram_counts")
    write(spark.createDataFrame([(last_line, last_text)], "last_line bigint, last_text bigint"), "appends")
    return Store(spark, folder, number, last_line, last_text)


def with_line_ids(texts: DataFrame, line_ids: DataFrame) -> DataFrame:
    """Texts (text_id, key, line_ids) of (text_id, key, listed), `listed` holding the digests of the lines in order."""
    words = texts.select("text_id", F.posexplode("listed").alias("pos", "digest"))
    items = F.array_sort(F.collect_list(F.struct("pos", "line_id"))).alias("items")
    per_text = words.join(line_ids, "digest").groupBy("text_id").agg(items)
    return texts.select("text_id", "key").join(per_text, "text_id").select("text_id", "key", F.col("items.line_id").alias("line_ids"))


def point_frames(frames: DataFrame, text_ids: DataFrame) -> DataFrame:
    """Frames carry text_id instead of text."""
    left = frames.withColumn("_digest", F.when(F.col("text") != "", digest(F.col("text")))).drop("text")
    return left.join(text_ids.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def _pack(rows: pa.Table) -> pa.RecordBatch:
    """The distinct trigrams of some lines; a trigram's row ends with GRAM_LINES lines or where their ids pass 16 bits."""
    rows = rows.sort_by("line_id")
    ids, texts = rows.column("line_id").to_numpy(), rows.column("text").to_pylist()
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    whole = owner[:-2] == owner[2:]
    code = (chars[:-2] << _HIGH | chars[1:-1] << _MIDDLE | chars[2:])[whole]
    order = np.argsort(code, kind="stable")
    code, line = code[order], ids[owner[:-2][whole][order]]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (line[1:] != line[:-1])
    code, line = code[new], line[new]
    place, begins = np.arange(len(code)), np.ones(len(code), dtype=bool)
    begins[1:] = code[1:] != code[:-1]
    begins |= (place - np.maximum.accumulate(np.where(begins, place, 0))) % GRAM_LINES == 0
    begins[1:] |= (line[1:] - ids[0]) >> 16 != (line[:-1] - ids[0]) >> 16
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, len(code))
    step = np.where(begins, 0, np.diff(line, prepend=0)).astype("<u2").view(np.uint8).reshape(-1, 2)
    away = np.empty(2 * len(code), dtype=np.uint8)  # the low bytes of a row, then its high ones, which are mostly zero
    low = place + np.repeat(starts, np.diff(bounds))
    away[low], away[low + np.repeat(np.diff(bounds), np.diff(bounds))] = step[:, 0], step[:, 1]
    heads = np.stack([code[starts] >> _HIGH, code[starts] >> _MIDDLE & _CHAR, code[starts] & _CHAR], axis=1)
    text = heads.astype("<u4").tobytes().decode("utf-32-le")
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(away.tobytes())])
    found = [text[i : i + 3] for i in range(0, len(text), 3)]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(line[starts]), lines], ["gram", "line_id", "away"])


def packed_grams(lines: DataFrame) -> DataFrame:
    """Rows (gram, line_id, away) of lines of three characters or more, case folded: a trigram, the first of several lines that hold
    it, and the steps from id to id, from zero, two bytes each. So a posting moves as two bytes, not as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += held[-1].nbytes
                if size >= GRAM_BYTES:
                    yield _pack(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield _pack(pa.Table.from_batches(held))

    folded = lines.where(F.length("text") >= 3).select("line_id", F.lower("text").alias("text"))
    return folded.mapInArrow(run, "gram string, line_id bigint, away binary")


def unpacked_grams(packed: DataFrame) -> DataFrame:
    """Rows (gram, line_id) in the order of the packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                away = part.column("away").to_pylist()
                sizes = np.array([len(a) // 2 for a in away])
                starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(away)), sizes)
                planes, low = np.frombuffer(b"".join(away), dtype=np.uint8).astype(np.int64), np.arange(len(row)) + starts[row]
                gone = np.cumsum(planes[low] + 256 * planes[low + sizes[row]])  # a row's first step is zero
                line = part.column("line_id").to_numpy()[row] + gone - gone[starts][row]
                yield pa.RecordBatch.from_arrays([part.column("gram").take(pa.array(row)), pa.array(line)], ["gram", "line_id"])

    return packed.mapInArrow(run, "gram string, line_id bigint")


def grown_runs(store: Store, fresh: DataFrame) -> DataFrame:
    """Runs of the new texts, joined to the tail's where they go on, and the tail's own."""
    begins = F.col("first_text") == store.last_text + 1
    head = fresh.where(begins).select("line_id", F.col("first_text").alias("_first"), F.col("last_text").alias("_last"))
    joined = store.table("tail").join(head, "line_id", "full").select(
        "line_id", F.coalesce("first_text", "_first").alias("first_text"), F.coalesce("_last", "last_text").alias("last_text")
    )
    return joined.unionByName(fresh.where(~begins))


def lines_with_term(store: Store, term: str) -> DataFrame:
    """Lines (line_id, key, text) that hold the term: of its trigrams only the rarest one's postings are read, then the lines.

    A term below three characters, which has none, is looked for in all lines.
    """
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    lines = store.table("lines")
    if not wanted:
        return lines.where(contains_term(F.col("text"), term))
    counts = store.table("gram_counts").where(F.col("gram").isin(wanted))  # one row per gram of the term and append
    size = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("lines").alias("n")).collect()}
    rarest = min(wanted, key=lambda g: (size.get(g, 0), g))
    found = store.table("grams").where(F.col("gram") == rarest).select("line_id").distinct()
    return lines.join(found, "line_id", "left_semi").where(contains_term(F.col("text"), term))
