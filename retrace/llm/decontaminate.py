"""Benchmark decontamination by greedy string tiling.

Seeds are Karp-Rabin hashes of `seed` consecutive words. Those of the benchmark meet those of the documents in a join; pairs
of document and item that share enough of them are tiled: again and again the longest match of unmarked words, found by
hashing windows of one length and halving the range of lengths, is marked in both, until none of at least `seed` words is
left. The share of the item's words under tiles is its coverage, whatever the order of the passages in the document.

A bitmap of fixed size over the benchmark's seeds, sent to the tasks, keeps seeds that no item has from leaving the task.
Only the stretches of words around seeds that hit it travel on, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.simhash import text_digest
from retrace.llm.textbytes import ALNUM_WORD, Texts, U64, Words, blocks, lists, rolling, signed

BITMAP_BITS = 24  # 2 MB, whatever the size of the benchmark


def _word_keys(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(Texts(column), ALNUM_WORD, lower=True)
    return words, words.keys()


def benchmark_words(benchmark: DataFrame, seed: int) -> DataFrame:
    """Rows (item_id, words, seeds) of the items with at least `seed` words."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words, found = _word_keys(batch.column("text"))
            first, owner = words.windows(seed)
            seeds = lists(signed(rolling(found, first, seed)), np.bincount(owner, minlength=words.count), pa.int64())
            kept = lists(signed(found), words.per_text, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), kept, seeds], ["item_id", "words", "seeds"])

    own = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = own.mapInArrow(run, "item_id bigint, words array<bigint>, seeds array<bigint>").where(F.size("seeds") > 0)
    return rows.dropDuplicates(["item_id", "words"])


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of all seeds as one byte array of fixed size."""
    slots = items.select(F.explode("seeds").alias("hash"))
    slots = slots.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("slot"))
    # bitmap functions number bits from 1
    parts = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for row in parts.collect():  # 512 rows of 4 KB at most
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _hits(bitmap: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    slot = seeds >> U64(64 - BITMAP_BITS)
    return (bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def seeded_documents(docs: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """Rows (row, doc_id, digest, seeds, words) of the documents with a seed in the bitmap, stored once.

    `words` are the words under hit seeds with a 0 between stretches; `seeds` are the distinct hit seeds.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words, found = _word_keys(batch.column("text"))
            found[found == 0] = 1
            first, owner = words.windows(seed)
            seeds = rolling(found, first, seed)
            hit = np.flatnonzero(_hits(bitmap.value, seeds))
            if not len(hit):
                continue
            rows, seed_rows = np.unique(owner[hit], return_inverse=True)
            pair = np.unique(np.stack([seed_rows.astype(np.int64), signed(seeds[hit])]), axis=1)
            under = np.zeros(len(words) + 1, dtype=bool)
            for i in range(seed):
                under[first[hit] + i] = True
            word_owner = words.owner()
            kept = np.flatnonzero(under[: len(words)])
            of = word_owner[kept]
            gap = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(of) > 0)])  # a stretch begins
            place = np.arange(len(kept)) + np.cumsum(gap)
            stream = np.zeros(len(kept) + int(gap.sum()), dtype=U64)
            stream[place] = found[kept]
            counts = np.bincount(of, minlength=words.count) + np.bincount(of[gap], minlength=words.count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    batch.column("digest").take(pa.array(rows)),
                    lists(pair[1], np.bincount(pair[0], minlength=len(rows)), pa.int64()),
                    lists(signed(stream), counts[rows], pa.int64()),
                ],
                ["doc_id", "digest", "seeds", "words"],
            )

    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"),
        F.col("text").cast("string").alias("text"),
    )
    rows = own.mapInArrow(run, "doc_id bigint, digest bigint, seeds array<bigint>, words array<bigint>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "seeded")


BASE = U64(0xD6E8FEB86659FD93)


def _prefix(words: np.ndarray, power: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=U64), np.cumsum(words * power[: len(words)], dtype=U64)])


def _windows(free: np.ndarray, prefix: np.ndarray, power: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes (modulo 2^64, shifted to one common power) of the windows of `size` free words."""
    if len(free) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[size:] == taken[:-size])
    return starts, (prefix[starts + size] - prefix[starts]) * power[len(power) - 1 - starts]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) in the order in which they are marked; 0 in `doc` never matches.

    Of equally long matches the one that starts first in the item is marked, with its first place in the document.
    """
    free_item, free_doc = np.ones(len(item), dtype=bool), doc != 0
    steps = np.full(max(len(item), len(doc)), BASE, dtype=U64)
    power = np.concatenate([np.ones(1, dtype=U64), np.cumprod(steps, dtype=U64)])
    of_item, of_doc = _prefix(item, power), _prefix(doc, power)

    def common(size: int) -> tuple[int, int] | None:
        a, x = _windows(free_item, of_item, power, size)
        b, y = _windows(free_doc, of_doc, power, size)
        for i in np.flatnonzero(np.isin(x, y)):
            for j in np.flatnonzero(y == x[i]):
                if np.array_equal(item[a[i] : a[i] + size], doc[b[j] : b[j] + size]):
                    return int(a[i]), int(b[j])
        return None

    out = []
    while found := common(least):
        low, high = least, min(len(item), len(doc))
        while low < high:  # a match of n words holds matches of fewer
            middle = (low + high + 1) // 2
            if longer := common(middle):
                low, found = middle, longer
            else:
                high = middle - 1
        out.append((*found, low))
        free_item[found[0] : found[0] + low] = False
        free_doc[found[1] : found[1] + low] = False
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.5) -> DataFrame:
    """Rows (doc_id, digest, item_id, item_words, matched_words, n_tiles, coverage) of pairs of at least that coverage.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Items with fewer than `seed` words are not
    looked for. Null and empty texts match nothing; null ids are reported as null; repeated rows are reported each; items
    that repeat an id with other words count as other items. Empty tables give no rows. Other columns aren't looked at.
    """
    items = stored(benchmark_words(benchmark, seed).withColumn("item", F.monotonically_increasing_id()), "items")
    rows = seeded_documents(docs, items, seed)
    # tiles that reach the coverage hold at least one seed per `seed` words; with repeated seeds in an item that is no bound
    plain = F.size(F.array_distinct("seeds")) == F.size("seeds")
    needed = F.when(plain, F.ceil(F.lit(coverage) * F.size("words") / seed)).otherwise(F.lit(1))
    seeds = items.select("item", needed.alias("needed"), F.explode(F.array_distinct("seeds")).alias("hash"))
    meet = rows.select("row", F.explode("seeds").alias("hash")).join(seeds, "hash")
    meet = meet.groupBy("row", "item").agg(F.count("*").alias("shared"), F.first("needed").alias("needed"))
    pairs = meet.where("shared >= needed").select("row", "item")
    work = pairs.join(rows.select("row", "doc_id", "digest", "words"), "row").join(
        items.select("item", "item_id", F.col("words").alias("item_words")), "item"
    )

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, item in zip(batch.column("words"), batch.column("item_words"), strict=True):
                item = item.values.to_numpy().view(U64)
                marked = tiles(np.where(item == 0, U64(1), item), doc.values.to_numpy().view(U64), seed)
                found.append((len(item), sum(n for _, _, n in marked), len(marked)))
            size, matched, count = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "digest", "item_id")], pa.array(size), pa.array(matched), pa.array(count)],
                ["doc_id", "digest", "item_id", "item_words", "matched_words", "n_tiles"],
            )

    fields = "doc_id bigint, digest bigint, item_id bigint, item_words bigint, matched_words bigint, n_tiles bigint"
    tiled = work.select("doc_id", "digest", "item_id", "words", "item_words").mapInArrow(run, fields)
    share = F.col("matched_words") / F.col("item_words")
    return tiled.withColumn("coverage", share).where(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that cover no item of the benchmark."""
    gone = contaminated(docs, benchmark, seed, coverage)
    gone = gone.select(F.col("doc_id").alias("_retrace_d"), F.col("digest").alias("_retrace_t")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_retrace_d")) & (text_digest(docs["text"]) == F.col("_retrace_t"))
    return docs.join(gone, same, "left_anti")
