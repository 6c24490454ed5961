"""Token-ID files: Parquet with one row per document and its ids in a list column.

Documents are sorted, encoded and written in one pass. The id column is dictionary-encoded; doc_id, row number and offset,
which rise steadily, are delta-encoded. Row groups and pages are held to given sizes, and Spark's writer adds page indexes, so
a reader that asks for a range of doc_ids, or for metadata only, reads those pages and columns only. A small table beside the
files has the number of tokens before each file's first one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrace.llm.simhash import text_digest
from retrace.llm.textbytes import LOWER, PLAIN_WORD, Texts, blocks, keys, lists

CACHED_PIECES = 1_000_000  # pieces a worker remembers; then it starts afresh

# classes of bytes: white space, letters, digits, other ASCII, beyond ASCII
_SPACE, _LETTER, _DIGIT, _OTHER, _HIGH = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[~PLAIN_WORD] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x80:] = _HIGH
# a piece may end between these classes, whatever stands around; see _cuts for the rest
_CUT = np.zeros((5, 5), dtype=bool)
_CUT[_SPACE, 1:] = _CUT[1:, _SPACE] = True
_CUT[_LETTER, [_DIGIT, _OTHER]] = _CUT[_DIGIT, [_LETTER, _DIGIT, _OTHER]] = _CUT[_OTHER, [_LETTER, _DIGIT]] = True
_APOSTROPHE = 0x27

_encoders: dict[str, "Encoder"] = {}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether the word-level tokenizer surely starts a new word at each byte.

    Letters, digits and marks form words of their own, except that an apostrophe may take letters with it. Beyond ASCII
    only the letters of Latin-1 (0xC3 and a byte, but for the signs of multiplication and division) are told apart.
    """
    kind = _CLASS[data]
    out = np.ones(len(data), dtype=bool)
    if len(data) < 2:
        return out
    out[1:] = _CUT[kind[:-1], kind[1:]]
    out[1:] &= ~((data[:-1] == _APOSTROPHE) & (kind[1:] == _LETTER))
    latin = np.zeros(len(data), dtype=bool)  # first bytes of such letters
    latin[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out[1:] |= latin[1:] & (kind[:-1] == _OTHER) & (data[:-1] != _APOSTROPHE)
    out[2:] |= latin[:-2] & (kind[2:] == _OTHER)
    return out


class Encoder:
    """A tokenizer of the tokenizers library with a memory of pieces. Ids are those of encoding each text whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            size = self.tokenizer.get_vocab_size()
            self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        if len(self.known) + len(pieces) > CACHED_PIECES:
            self.known.clear()
        plain, other = [], []
        for piece in pieces:
            text = piece.decode()
            (plain if self.ends is not None and text.isalpha() else other).append(text)
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = self.whole([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                other += part
                continue
            for text, found in zip(part, np.split(ids, stops[:-1]), strict=True):
                self.known[text.encode()] = found.tobytes()
        for i in range(0, len(other), 500):
            part = other[i : i + 500]
            for text, found in zip(part, self.whole(part), strict=True):
                self.known[text.encode()] = found.tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after the other, and their number per text. Null counts as empty."""
        texts = Texts(column)
        data = texts.data
        marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))  # a special token may be spelt out
        special = np.unique(np.searchsorted(texts.offsets, marked, side="right") - 1)
        lower = LOWER[data]
        begin = np.flatnonzero(_cuts(data))
        length = np.diff(np.append(begin, len(data)))
        word = PLAIN_WORD[data[begin]]
        begin, length = begin[word], length[word]
        owner = np.searchsorted(texts.offsets, begin, side="right") - 1
        if len(special):
            normal = ~np.isin(owner, special)
            begin, length, owner = begin[normal], length[normal], owner[normal]
        codes, distinct = pd.factorize(keys(lower, begin, length))
        first = np.empty(len(distinct), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = lower.tobytes()
        pieces = [raw[a : a + n] for a, n in zip(begin[first].tolist(), length[first].tolist(), strict=True)]
        if missing := [p for p in pieces if p not in self.known]:
            self._learn(missing)
            if any(p not in self.known for p in pieces):
                self._learn([p for p in pieces if p not in self.known])
        found = [self.known[p] for p in pieces]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter((len(f) for f in found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        per_piece = sizes[codes]
        total = int(per_piece.sum())
        place = np.arange(total) - np.repeat(np.cumsum(per_piece) - per_piece, per_piece) + np.repeat(starts[codes], per_piece)
        ids = flat[place]
        counts = np.bincount(owner, weights=per_piece, minlength=texts.count).astype(np.int64)
        if len(special):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            direct = self.whole([column[int(i)].as_py() for i in special])
            for i, found_ids in zip(special, direct, strict=True):
                parts[i], counts[i] = found_ids, len(found_ids)
            ids = np.concatenate(parts)
        return ids, counts


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with `end_id` after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 1, order: list[Column] | None = None) -> DataFrame:
    """Rows (doc_id, source, at, n_tokens, offset, ids) of all documents, sorted; offset counts the partition's tokens before.

    The order is that of `order`, or of doc_id and then of the text's digest. `at` is the row's number, partition first.
    Null and empty texts have the end id only; null doc_ids come first; repeated rows stay and stand together.
    """
    order = order or [F.col("doc_id").cast("bigint"), text_digest(F.col("text"))]
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    names = [f"_o{i}" for i in range(len(order))]
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"),
        *[c.alias(n) for c, n in zip(order, names, strict=True)],
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = own.repartitionByRange(*names, "_row").sortWithinPartitions(*names, "_row")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder.of(tokenizer), 0
        for batch in blocks(batches):
            ids, counts = _ended(*encoder.encode(batch.column("text")), end_id)
            offsets = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(counts), pa.array(offsets), lists(ids.astype(np.int32), counts, pa.int32())],
                ["doc_id", "source", "n_tokens", "offset", "ids"],
            )

    fields = "doc_id bigint, source string, n_tokens bigint, offset bigint, ids array<int>"
    out = rows.select("doc_id", "source", "text").mapInArrow(run, fields)
    return out.withColumn("at", F.monotonically_increasing_id())


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, order: list[Column] | None = None,
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
) -> None:
    """Write token files to `path`/tokens and the tokens before each of them to `path`/files.

    A run that fails leaves no committed files; one that repeats lost tasks writes the same rows.
    """
    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary#ids.list.element": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "offset", "n_tokens")},
    }
    encoded(docs, tokenizer, end_id, order).write.options(**options).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/tokens").groupBy(F.shiftright("at", 33).alias("file")).agg(F.sum("n_tokens").alias("n"))
    # one row per file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("file", before.alias("before")).write.parquet(f"{path}/files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, source, n_tokens, start, ids): `start` counts the tokens of all documents before."""
    rows = spark.read.parquet(f"{path}/tokens")
    files = spark.read.parquet(f"{path}/files").select(F.col("file").alias("_file"), "before")
    joined = rows.join(files, F.shiftright("at", 33) == F.col("_file"))
    return joined.select("doc_id", "source", "n_tokens", (F.col("before") + F.col("offset")).alias("start"), "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """Replace `ids` by ids_crc32, the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            offsets = column.offsets.to_numpy().astype(np.int64) * 4
            raw = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            found = np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)
            kept = [batch.column(c) for c in ("doc_id", "source", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], ["doc_id", "source", "start", "n_tokens", "ids_crc32"])

    fields = "doc_id bigint, source string, start bigint, n_tokens bigint, ids_crc32 bigint"
    return rows.select("doc_id", "source", "start", "n_tokens", "ids").mapInArrow(run, fields)
