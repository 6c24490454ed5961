"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of every text: h = 2 h + G[byte] in 16 bits, so it depends on the last 16 bytes only. Where
its top bits are zero, and were not within the `least` bytes before, a chunk ends; stretches without an end are cut every
`most` bytes. Ends depend on the bytes around them, so an insertion moves the chunks near it and no others. Chunks are
deduplicated by a 128-bit digest: the first one, by (doc_id, place), stays, later ones are repeats. Repeats that follow each
other in a text are merged, and runs of at least `min_run` bytes are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.simhash import text_digest
from retrace.llm.textbytes import Texts, blocks, keys, lists, signed
from retrace.llm.xxh import xxh64

GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """16-bit gear hash of the bytes up to and including each one."""
    out, span = GEAR[data], 1
    while span < 16:  # from windows of `span` bytes to windows of twice as many
        longer = out.copy()
        longer[span:] += out[:-span] << np.uint16(span)
        out, span = longer, 2 * span
    return out


def chunk_starts(texts: Texts, bits: int, least: int, most: int) -> np.ndarray:
    """Sorted starts of the chunks in a block of texts; every text starts one, none starts within a character."""
    data, first = texts.data, texts.offsets[:-1]
    hash_ = gear(data)
    # the first bytes of a text would look into the text before
    place = np.flatnonzero(hash_ >> np.uint16(16 - bits) == 0)
    owner = np.searchsorted(texts.offsets, place, side="right") - 1
    whole = place - first[owner] >= 15
    place, owner = place[whole], owner[whole]
    far = (np.diff(place, prepend=-least - 1) > least) | (np.diff(owner, prepend=-1) > 0)
    ends = place[far] + 1
    limit = texts.offsets[-1]
    for _ in range(3):  # on to the next character
        inside = (ends < limit) & ((data[np.minimum(ends, limit - 1)] & 0xC0) == 0x80)
        ends = ends + inside
    starts = np.unique(np.concatenate([first, ends[ends < limit]]))
    gaps = np.diff(np.append(starts, limit))
    extra = (gaps - 1) // most
    if extra.sum():
        base = np.repeat(starts, extra)
        step = np.arange(len(base)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        more = base + most * step
        for _ in range(3):
            more = more + ((more < limit) & ((data[np.minimum(more, limit - 1)] & 0xC0) == 0x80))
        starts = np.unique(np.concatenate([starts, more[more < limit]]))
    return starts


def chunks(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    """Rows (row, doc_id, digest, starts, sizes, h1, h2) of all texts, the chunks as arrays, stored once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = Texts(batch.column("text"))
            starts = chunk_starts(texts, bits, least, most)
            sizes = np.diff(np.append(starts, texts.offsets[-1]))
            owner = np.searchsorted(texts.offsets, starts, side="right") - 1
            last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
            sizes = sizes - last  # without the line feed after each text
            counts = np.bincount(owner, minlength=texts.count)
            columns = [
                lists((starts - texts.offsets[owner]).astype(np.int32), counts, pa.int32()),
                lists(sizes.astype(np.int32), counts, pa.int32()),
                lists(signed(xxh64(texts.data, starts, sizes)), counts, pa.int64()),
                lists(signed(keys(texts.data, starts, sizes)), counts, pa.int64()),
            ]
            own = [batch.column("doc_id"), batch.column("digest")]
            yield pa.RecordBatch.from_arrays([*own, *columns], ["doc_id", "digest", "starts", "sizes", "h1", "h2"])

    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"),
        F.col("text").cast("string").alias("text"),
    )
    fields = "doc_id bigint, digest bigint, starts array<int>, sizes array<int>, h1 array<bigint>, h2 array<bigint>"
    return stored(own.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "chunks")


def repeats(docs: DataFrame, bits: int = 4, least: int = 16, most: int = 512, min_run: int = 100) -> DataFrame:
    """Rows (row, doc_id, digest, start, size, chunks, first_doc_id): runs of repeated chunks, in bytes of the UTF-8 text.

    first_doc_id has the first occurrence of the run's first chunk. Null and empty texts have no chunks. Null doc_ids come
    before all others; rows of equal doc_id are in the order they were read. A repeated row repeats the first one wholly if
    it is long enough. Other columns aren't looked at. An empty table gives no rows.
    """
    rows = chunks(docs, bits, least, most)
    each = rows.select("row", "doc_id", F.explode(F.arrays_zip("starts", "sizes", "h1", "h2")).alias("c"))
    each = each.select("row", "doc_id", F.col("c.starts").alias("start"), F.col("c.sizes").alias("size"), "c.h1", "c.h2")
    each = each.where("size > 0")
    first = each.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("first"))
    first = first.where("n > 1").select("h1", "h2", "first")
    later = each.join(first, ["h1", "h2"]).where("struct(doc_id, row, start) <> first")
    in_text = Window.partitionBy("row").orderBy("start")
    begins = F.coalesce(F.lag(F.col("start") + F.col("size")).over(in_text) < F.col("start"), F.lit(True))
    later = later.withColumn("begins", begins.cast("int"))
    later = later.withColumn("run", F.sum("begins").over(in_text))
    runs = later.groupBy("row", "run").agg(
        F.min("start").cast("bigint").alias("start"), F.sum("size").alias("size"), F.count("*").alias("chunks"),
        F.min_by("first.doc_id", "start").alias("first_doc_id"),
    )
    return runs.where(F.col("size") >= min_run).join(rows.select("row", "doc_id", "digest"), "row").drop("run")


def without_repeats(docs: DataFrame, **limits) -> DataFrame:
    """All rows and columns of `docs`, the reported runs cut out of the texts; rows that repeat a whole row lose it as well.

    Rows with the same doc_id and text can't be told apart: only what goes from all of them is cut.
    """
    found = repeats(docs, **limits)
    spans = found.groupBy("doc_id", "digest", "row").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))
    spans = spans.groupBy(F.col("doc_id").alias("_retrace_d"), F.col("digest").alias("_retrace_t")).agg(
        F.min_by("spans", F.size("spans")).alias("_retrace_spans")
    )
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_retrace_d")) & (text_digest(docs["text"]) == F.col("_retrace_t"))
    joined = docs.join(spans, same, "left")
    raw = F.encode(F.col("text"), "UTF-8")
    cut = F.aggregate(
        "_retrace_spans",
        F.struct(F.lit("").cast("binary").alias("kept"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(
            F.concat(s["kept"], F.substring(raw, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("kept"),
            (x["start"] + x["size"]).alias("at"),
        ),
        lambda s: F.concat(s["kept"], F.substring(raw, (s["at"] + 1).cast("int"), F.octet_length(raw))),
    )
    text = F.when(F.col("_retrace_spans").isNull(), F.col("text")).otherwise(F.decode(cut, "UTF-8"))
    return joined.withColumn("text", text).select(*docs.columns)
