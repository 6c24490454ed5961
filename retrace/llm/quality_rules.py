"""Quality rules: document statistics, and lines that many documents of a host repeat.

The lines of every document are hashed after normalising (lower case, single spaces). For each host the distinct documents
of each line are counted; exact copies count once, by the digest of the whole text, so that a text copied many times is left
to deduplication and isn't taken for boilerplate. Lines above the limit are removed, and documents that keep too few of their
words are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.simhash import text_digest
from retrace.llm.textbytes import LOWER, PLAIN_WORD, Texts, U64, blocks, keys, lists, mixed, rolling, signed, sums

#: a line in so many documents of a host stays whatever their share
FEW = 10
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
_NO_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ROW = "doc_id bigint, host string, digest bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<at:int,hash:bigint,words:int>>"


def _counts(groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, minlength=n).astype(np.int64)


def _repeats(codes: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    numbers, distinct = pd.factorize(codes)
    return np.bincount(numbers, minlength=len(distinct))[numbers] > 1


def block_statistics(column: pa.Array) -> dict[str, pa.Array]:
    """Columns of _ROW from n_words on, for a block of texts."""
    texts = Texts(column)
    words = texts.words(PLAIN_WORD)
    per_text = words.per_text
    word_keys = words.keys()
    low = keys(LOWER[texts.data], words.starts, words.lengths)

    inside = PLAIN_WORD[texts.data] & _NO_CONTINUATION[texts.data]
    first, of = words.windows(3)
    repeated = _repeats(rolling(word_keys, first, 3) ^ mixed(of.astype(U64)))
    covered = np.zeros(len(words) + 2, dtype=bool)
    for i in range(3):
        covered[first[repeated] + i] = True

    # lines that have a word
    ends = np.flatnonzero(texts.data == 0x0A)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    line_word = np.searchsorted(words.starts, np.append(begins, len(texts.data)))
    in_line = np.diff(line_word)
    line_owner = np.searchsorted(texts.offsets, begins, side="right") - 1
    at = np.arange(len(begins)) - np.searchsorted(begins, texts.offsets[line_owner])
    some = np.flatnonzero(in_line > 0)
    raw = keys(texts.data, begins[some], ends[some] - begins[some]) ^ mixed(line_owner[some].astype(U64))
    of_line = line_owner[some]
    distinct = _counts(of_line[np.unique(raw, return_index=True)[1]], texts.count)
    line_count = _counts(of_line, texts.count)

    # Karp-Rabin over the lower-case words of a line, as a sum of word key times a power of its place
    base = U64(0xD6E8FEB86659FD93)
    longest = int(in_line.max()) if len(in_line) else 0
    powers = np.cumprod(np.full(longest + 1, base, dtype=U64)) if longest else np.ones(1, dtype=U64)
    line_of_word = np.repeat(np.arange(len(begins)), in_line)
    place = np.arange(len(words)) - line_word[line_of_word]
    hashes = np.add.reduceat(low * powers[place], line_word[some]) if len(some) else np.zeros(0, dtype=U64)
    lines = pa.StructArray.from_arrays(
        [
            pa.array(at[some].astype(np.int32)),
            pa.array(signed(mixed(hashes + in_line[some].astype(U64)))),
            pa.array(in_line[some].astype(np.int32)),
        ],
        ["at", "hash", "words"],
    )
    offsets = pa.array(np.concatenate([[0], np.cumsum(line_count)]).astype(np.int32))
    return {
        "n_words": pa.array(per_text.astype(np.int64)),
        "word_chars": pa.array(sums(inside, texts.offsets)),
        "n_symbols": pa.array(sums(SYMBOL[texts.data], texts.offsets)),
        "n_dup_lines": pa.array(line_count - distinct),
        "n_repeat_words": pa.array(sums(covered[: len(words)], words.first)),
        "lines": pa.ListArray.from_arrays(offsets, lines),
    }


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """Rows (row, doc_id, host, digest, statistics..., lines), one per row of `docs`, stored once."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = block_statistics(batch.column("text"))
            own = [batch.column(c) for c in ("doc_id", "host", "digest")]
            yield pa.RecordBatch.from_arrays([*own, *found.values()], ["doc_id", "host", "digest", *found])

    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"),
        text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"),
    )
    return stored(own.mapInArrow(run, _ROW).withColumn("row", F.monotonically_increasing_id()), "statistics")


def frequent_lines(rows: DataFrame, min_docs: int, share: float | None = None) -> DataFrame:
    """Rows (host, hash, docs) of lines in more than `min_docs` distinct documents of a host.

    With `share` also those in more than that share of the host's distinct documents, and in more than FEW of them.
    """
    seen = rows.select("host", "digest", F.explode("lines.hash").alias("hash")).distinct()
    counted = seen.groupBy("host", "hash").agg(F.count("*").alias("docs"))
    if share is None:
        return counted.where(F.col("docs") > min_docs)
    size = rows.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("size"))
    size = size.select(F.col("host").alias("_h"), "size")
    above = counted.join(size, counted["host"].eqNullSafe(size["_h"]))
    above = above.where((F.col("docs") > min_docs) | (F.col("docs") > FEW) & (F.col("docs") > F.lit(share) * F.col("size")))
    return above.select("host", "hash", "docs")


def judged(
    docs: DataFrame, host: str = "source", min_docs: int = 50, min_left: float = 0.3, min_words: int = 50, max_repeat: float = 0.5,
    share: float | None = None,
) -> DataFrame:
    """Rows (row, doc_id, host, digest, statistics, base_failed, removed_words, removed, kept) per row of `docs`.

    `removed` lists the numbers (from 0) of lines that go because more than `min_docs` distinct documents of the host have
    them, whatever the size of the host; with `share` also lines in more than that share of the host's distinct documents, if
    these are more than FEW. base_failed: fewer than `min_words` words, or more than `max_repeat` of the words in three-word
    windows that the text repeats. kept: not base_failed, and if lines were removed, at least `min_left` of the words are left.

    Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows are judged each, alike, and
    count as one document; ties and null doc_ids don't matter. Other columns aren't looked at. No rows give no rows.
    """
    rows = statistics(docs, host)
    above = frequent_lines(rows, min_docs, share).select(F.col("host").alias("_h"), F.col("hash").alias("_l"))
    lines = rows.select("row", "host", F.explode("lines").alias("line"))
    hits = lines.join(above, lines["host"].eqNullSafe(above["_h"]) & (F.col("line.hash") == F.col("_l")))
    hits = hits.groupBy("row").agg(F.sum("line.words").alias("removed_words"), F.sort_array(F.collect_list("line.at")).alias("removed"))
    hits = hits.withColumnRenamed("row", "_row")
    joined = rows.drop("lines").join(hits, F.col("row") == F.col("_row"), "left").drop("_row")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0))
    depleted = (gone > 0) & (F.col("n_words") - gone < F.lit(min_left) * F.col("n_words"))
    return joined.withColumns(
        {
            "removed_words": gone.cast("bigint"),
            "removed": F.coalesce("removed", F.array().cast("array<int>")),
            "base_failed": failed,
            "kept": ~failed & ~depleted,
        }
    )


def cleaned(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of `docs` that are kept, without the lines that go; all columns stay, n_chars follows the text if present."""
    decided = judged(docs, host, **limits)
    decided = decided.where("kept").groupBy(
        F.col("doc_id").alias("_retrace_d"), F.col("host").alias("_retrace_h"), F.col("digest").alias("_retrace_t")
    ).agg(F.first("removed").alias("_retrace_gone"))
    same = (
        docs["doc_id"].cast("bigint").eqNullSafe(F.col("_retrace_d"))
        & docs[host].cast("string").eqNullSafe(F.col("_retrace_h"))
        & (text_digest(docs["text"]) == F.col("_retrace_t"))
    )
    joined = docs.join(decided, same)
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_retrace_gone", i))
    text = F.when(F.size("_retrace_gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_retrace_gone") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed.otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
