"""Importance resampling: draw the documents that look most like a target set, with seeded Gumbel noise.

Features are the runs of one to three words, hashed by CRC-32 into a fixed number of buckets. A bucket's gain is the scaled
log ratio of its smoothed shares in the target and in the documents; the gains are one small array, and a document's weight
is the sum of gains over its features. Adding Gumbel noise and taking the best scores draws without replacement in
proportion to exp(weight).

The cutoff is not found by sorting all scores: a quantile sketch gives a bracket of scores around it, exact counts outside
the bracket validate it or widen it, and only the rows inside are sorted to find the last one drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.simhash import text_digest
from retrace.llm.textbytes import ALNUM_WORD, Texts, Words, blocks, sums

BUCKETS = 10_000
RUNS = 3
#: rank error of the sketch is one part in this many
ACCURACY = 10_000
#: longer words are checksummed one by one
LONG = 64
_FULL = np.uint32(0xFFFFFFFF)
#: CRC-32 register after one more byte, indexed by the register's low byte xor that byte; from checksums of single bytes
_STEP = (np.array([zlib.crc32(bytes([b ^ 255])) for b in range(256)], dtype=np.uint32) ^ _FULL ^ np.uint32(0x00FFFFFF))


def extended(register: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of one span each."""
    order = np.argsort(-lengths, kind="stable")
    state, at, size = register[order], starts[order], lengths[order]
    long = int(np.searchsorted(-size, -LONG, side="left"))
    for i in range(long):
        span = data[at[i] : at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(span, int(state[i] ^ _FULL)) ^ int(_FULL)
    for k in range(int(size[long]) if long < len(size) else 0):
        stop = int(np.searchsorted(-size, -k, side="left"))  # spans of more than k bytes
        part = state[long:stop]
        state[long:stop] = _STEP[(part ^ data[at[long:stop] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def run_buckets(words: Words, buckets: int, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the bucket of every run, and the bounds of each text in them."""
    state = np.full(len(words), _FULL, dtype=np.uint32)
    first = np.arange(len(words))
    for size in range(1, runs + 1):
        starts, _ = words.windows(size)
        kept = np.searchsorted(first, starts)  # runs that have room for one word more
        state = state[kept]
        if size > 1:
            state = _STEP[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        first, last = starts, starts + size - 1
        state = extended(state, words.data, words.starts[last], words.lengths[last])
        bounds = np.concatenate([[0], np.cumsum(np.maximum(words.per_text - size + 1, 0))])
        yield ((state ^ _FULL) % np.uint32(buckets)).astype(np.int64), bounds


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Features per bucket over all texts; every task sends one row per bucket at most."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, dtype=np.int64)
        for batch in blocks(batches):
            for bucket, _ in run_buckets(Words(Texts(batch.column("text")), ALNUM_WORD, lower=True), buckets, runs):
                seen += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, dtype=np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    more = float(len(own))
    ratio = ((target + 1.0) * (own.sum() + more)) / ((own + 1.0) * (target.sum() + more))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and doc_id alone; a null doc_id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighted(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = 42) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, digest) for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = Words(Texts(batch.column("text")), ALNUM_WORD, lower=True)
            n, weight = np.zeros(words.count, dtype=np.int64), np.zeros(words.count, dtype=np.int64)
            for bucket, bounds in run_buckets(words, len(shared.value), runs):
                n += np.diff(bounds)
                weight += sums(shared.value[bucket], bounds)
            kept = [batch.column("doc_id"), batch.column("digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(x.astype(np.int64)) for x in (words.per_text, n, weight)]], ["doc_id", "digest", "n_words", "n_features", "weight"]
            )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_digest(F.col("text")).alias("digest"))
    found = own.mapInArrow(run, "doc_id bigint, digest bigint, n_words bigint, n_features bigint, weight bigint")
    return found.withColumn("score", F.col("weight") + noise(seed))


#: falling score, then rising id; `digest` and `row` decide between rows that share both
ORDER = ["falling", "doc_id", "digest", "row"]


def ranked(rows: DataFrame, label: str) -> DataFrame:
    """`rows` with `rank` 1, 2, ... in ORDER: sorted ranges, each numbered behind the sizes of those before it."""
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select(F.col("part").alias("_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = dealt.join(sizes, part == F.col("_part"))
    return placed.withColumn("rank", F.col("ahead") + F.col("at") - F.col("first") + 1).drop("at", "_part", "first", "ahead")


def bracket(scores: DataFrame, total: int, drawn: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """Scores (low, high) between which the `drawn`-th highest of `total` lies, and how many are above `high`.

    None stands for an open end. The sketch's bracket has twice its error on either side; while exact counts show the place
    outside, it is made eight times wider.
    """
    middle, reach = 1 - drawn / total, 2 / accuracy
    while True:
        wanted = [middle - reach, middle + reach]
        within = [min(max(x, 0.0), 1.0) for x in wanted]
        low, high = scores.agg(F.percentile_approx("score", F.array(*[F.lit(x) for x in within]), accuracy).alias("q")).first()["q"]
        low, high = (low if wanted[0] > 0 else None), (high if wanted[1] < 1 else None)
        above = F.count_if(F.col("score") > F.lit(high)) if high is not None else F.lit(0)
        reached = F.count_if(F.col("score") >= F.lit(low)) if low is not None else F.count("*")
        found = scores.agg(above.alias("above"), reached.alias("reached")).first()
        if found["above"] < drawn <= found["reached"]:
            return low, high, found["above"]
        reach *= 8


def last_drawn(candidates: DataFrame, total: int, drawn: int, accuracy: int = ACCURACY):
    """The row at place `drawn` in ORDER; only the rows of the bracket are sorted."""
    low, high, above = bracket(candidates, total, drawn, accuracy)
    inside = candidates.where((F.lit(low is None) | (F.col("score") >= F.lit(low or 0))) & (F.lit(high is None) | (F.col("score") <= F.lit(high or 0))))
    return ranked(inside.select(*ORDER), "importance-bracket").where(F.col("rank") == drawn - above).first()


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, runs: int = RUNS, seed: int = 42, accuracy: int = ACCURACY
) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank), one per row of `docs`; rank is null for what isn't drawn.

    `docs` has (doc_id, text), `target` has (text). Drawn are the best floor(percent N / 100) of the N rows with at least
    `least_words` words. Null and empty texts have no words, weight 0 and are never drawn. Repeated rows are rows each; rows
    that share score and doc_id go by a digest of their text, equal ones in either order. A null doc_id comes before others
    and has the noise of an empty name. An empty target gives every bucket its smoothed share; an empty table of documents
    gives an empty result. Other columns of both tables aren't looked at.
    """
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    scores = weighted(docs, gain, runs, seed).withColumn("row", F.monotonically_increasing_id())
    scores = stored(scores.withColumn("falling", -F.col("score")), "importance-scores")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    candidates = scores.where(fit)
    total = candidates.count()
    drawn = percent * total // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if drawn == 0:
        return scores.select(*columns, none)
    last = last_drawn(candidates, total, drawn, accuracy)
    in_order = F.struct(*ORDER) <= F.struct(*[F.lit(last[c]).cast("bigint").alias(c) for c in ORDER])
    best = ranked(candidates.where(in_order), "importance-drawn")
    return best.select(*columns, F.col("rank").cast("bigint")).unionByName(scores.where(~fit | ~in_order).select(*columns, none))
