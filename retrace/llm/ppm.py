"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts: for a context of up to `order` bytes, how often each byte followed it in the training
texts. A byte is predicted in the longest context; where it was never seen there, the model pays an escape (distinct
followers against all occurrences, method C) and goes on with the context one byte shorter, from which the followers that the
longer one has already ruled out are excluded. Below order 0 all remaining byte values are equally likely.

Texts are modelled as their lower-case words, one space between them and a line feed at the end.

Work is laid out so that no task needs the whole model. Texts are stored in chunks of bounded size. Every chunk sends in the
distinct words and byte grams it holds with their training counts; counts are summed by key; the trie is cut by its first two
edges, the two bytes before the predicted one, and each subtrie turns its grams into log probabilities; each chunk gets back
the values of its own words and grams and is scored with those. Only the two lowest orders, at most 65,536 counts, go
to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.textbytes import PLAIN_WORD, Texts, U64, Words, blocks, keys, loads, signed, sums

CHUNK_BYTES = 48 << 20
END = 0  # key of the end token
_FEED = 0x0A


def _mask(size: int) -> U64:
    return U64((1 << (8 * size)) - 1)


def chunked(docs: DataFrame, train: Column) -> DataFrame:
    """Rows (doc_id, train, chunk, body), stored once: lower-case words with single spaces, in chunks of a task's rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        for batch in blocks(batches):
            words = Words(Texts(batch.column("text")), PLAIN_WORD, lower=True)
            bounds = np.concatenate([words.starts, [len(words.data)]])[words.first]
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), words.count, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(words.data.tobytes())]
            ).cast(pa.large_string())
            if held and held + len(words.data) > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += len(words.data)
            names = ["doc_id", "train", "chunk", "body"]
            chunks = pa.array(np.full(words.count, chunk, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), chunks, body.cast(pa.string())], names)

    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"),
        F.col("text").cast("string").alias("text"),
    )
    return stored(own.mapInArrow(run, "doc_id bigint, train boolean, chunk bigint, body string"), "chunks")


class Body:
    """Byte grams and words of a block of bodies, each with a space after its last word or, without words, empty."""

    def __init__(self, column: pa.Array, order: int):
        texts = Texts(column)
        # the space after the last word gives way to the line feed
        drop = np.zeros(len(texts.data), dtype=bool)
        ends = texts.offsets[1:] - 1
        drop[ends[np.diff(texts.offsets) > 1] - 1] = True
        self.offsets = np.concatenate([[0], np.cumsum(np.diff(texts.offsets) - sums(drop, texts.offsets))])
        data = texts.data[~drop]
        self.lengths = np.diff(self.offsets)
        padded = np.concatenate([np.full(order, _FEED, dtype=np.uint8), data])
        found = (loads(padded)[: len(data)] << U64(8 * (7 - order))).byteswap() & _mask(order + 1)
        feeds = U64(int.from_bytes(bytes([_FEED]) * (order + 1), "little"))
        for i in range(order):  # before its start a text has line feeds, not the text before it
            at = (self.offsets[:-1] + i)[self.lengths > i]
            found[at] = (found[at] & _mask(i + 1)) | (feeds & ~_mask(i + 1))
        self.grams = found
        inside = PLAIN_WORD[data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        starts, stops = edge[0::2], edge[1::2]
        self.first = np.searchsorted(starts, self.offsets)
        self.words = keys(data, starts, stops - starts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(np.concatenate([k for k, _ in parts]))
    return distinct, np.bincount(codes, weights=np.concatenate([n for _, n in parts]), minlength=len(distinct))


def features(chunks: DataFrame, order: int) -> DataFrame:
    """Rows (chunk, gram, key, n): the distinct words and grams of each chunk and how often training texts have them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, words, grams = None, [], []

        def flushed() -> Iterator[pa.RecordBatch]:
            for gram, parts in ((False, words), (True, grams)):
                if parts:
                    key, n = _merged(parts)
                    columns = [np.full(len(key), current), np.full(len(key), gram), signed(key), n.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["chunk", "gram", "key", "n"])
            words.clear()
            grams.clear()

        for whole in batches:
            of = whole.column("chunk").to_numpy()
            edges = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)) if len(of) else []
            for a, b in zip(edges, [*edges[1:], len(of)], strict=True):
                if current != of[a]:
                    yield from flushed()
                    current = int(of[a])
                for batch in blocks([whole.slice(a, b - a)], "body"):
                    body = Body(batch.column("body"), order)
                    train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
                    words.append(_merged([(body.words, np.repeat(train, np.diff(body.first))), (np.array([END], dtype=U64), np.array([train.sum()]))]))
                    grams.append(_merged([(body.grams, np.repeat(train, body.lengths))]))
                    for parts in (words, grams):
                        if len(parts) >= 8:
                            parts[:] = [_merged(parts)]
        yield from flushed()

    return chunks.select("train", "chunk", "body").mapInArrow(run, "chunk bigint, gram boolean, key bigint, n bigint")


def _followers(gram: np.ndarray, n: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per context of distinct grams: context, occurrences, distinct followers, and their occurrences one order below."""
    context, inverse = np.unique(gram >> U64(8), return_inverse=True)
    seen = n > 0
    return (
        context,
        np.bincount(inverse, weights=n, minlength=len(context)),
        np.bincount(inverse, weights=seen, minlength=len(context)),
        np.bincount(inverse, weights=np.where(seen, shorter, 0.0), minlength=len(context)),
    )


def subtrie(grams: np.ndarray, counts: np.ndarray, order: int, lowest: np.ndarray) -> np.ndarray:
    """log10 probability of the lowest byte of each gram after its other `order` (2 or more) bytes.

    All grams share their second and third byte. `lowest[a, b]` is how often byte b followed byte a in training.
    """
    levels = {}
    for k in range(order, 1, -1):
        gram, inverse = np.unique(grams & _mask(k + 1), return_inverse=True)
        levels[k] = (gram, inverse, np.bincount(inverse, weights=counts, minlength=len(gram)))
    single = lowest.sum(axis=0)
    result, open_ = np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
    excluded, ruled_out = np.zeros(len(grams)), np.zeros(len(grams))  # occurrences and followers excluded at this order
    symbol = (grams & U64(0xFF)).astype(np.int64)
    before = (grams >> U64(8) & U64(0xFF)).astype(np.int64)
    for k in range(order, -1, -1):
        if k > 1:
            gram, inverse, n = levels[k]
            if k > 2:
                down, _, fewer = levels[k - 1]
                shorter = fewer[np.searchsorted(down, gram & _mask(k))]
            else:
                shorter = lowest[(gram >> U64(8) & U64(0xFF)).astype(np.int64), (gram & U64(0xFF)).astype(np.int64)]
            context, total, kinds, below = _followers(gram, n, shorter)
            at = np.searchsorted(context, grams >> U64(8) & _mask(k))
            own, total, kinds, below = n[inverse], total[at], kinds[at], below[at]
        elif k == 1:
            seen = lowest > 0
            own, total, kinds = lowest[before, symbol], lowest.sum(axis=1)[before], seen.sum(axis=1)[before]
            below = (seen * single).sum(axis=1)[before]
        else:
            own, total, kinds = single[symbol], np.full(len(grams), single.sum()), np.full(len(grams), (single > 0).sum())
            below = total
        rest, left = total - excluded, kinds - ruled_out
        hit = open_ & (own > 0)
        result[hit] += np.log10(own[hit] / (rest[hit] + left[hit]))
        escape = open_ & ~hit & (left > 0)
        result[escape] += np.log10(left[escape] / (rest[escape] + left[escape]))
        open_ &= ~hit
        excluded, ruled_out = below, kinds
    result[open_] -= np.log10(256 - ruled_out[open_])
    return result


def _lowest(top: DataFrame) -> np.ndarray:
    """Counts of byte pairs, at most 65,536 rows."""
    out = np.zeros((256, 256))
    pair = F.col("key").bitwiseAND(0xFFFF)
    for row in top.where("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect():
        out[row["pair"] >> 8, row["pair"] & 0xFF] = row["n"]
    return out


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """Rows (key, value) with the log10 probability of every distinct gram of `grams` (chunk, key, n)."""
    top = stored(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    lowest = grams.sparkSession.sparkContext.broadcast(_lowest(top))

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy().view(U64)
        found = subtrie(key, table.column("n").to_numpy().astype(np.float64), order, lowest.value)
        return pa.table({"key": table.column("key"), "value": pa.array(found)})

    root = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)
    return top.withColumn("root", root).groupBy("root").applyInArrow(run, "key bigint, value double")


def scored(docs: DataFrame, train: Column | None = None, order: int = 4) -> DataFrame:
    """Rows (doc_id, train, n_tokens, n_known, train_tokens, base_score, score), one per row of `docs`.

    `train` tells which rows the model learns from (all by default; null counts as true). n_tokens: words and one end;
    n_known: those that training texts have; base_score: the sum of log10((c + 1) / (N + V + 1)) over tokens, c being the
    token's count, N all and V the distinct training tokens; score: the model's log10 probability of the text.

    Null and empty texts are the end alone. Repeated rows are learnt from and scored each; null doc_ids are kept. Without
    training rows every byte is equally likely. An empty table gives an empty result. Other columns aren't looked at.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    chunks = chunked(docs, F.lit(True) if train is None else train)
    found = features(chunks, order)
    by_key = Window.partitionBy("key")
    words = found.where("not gram").select(
        "chunk", F.lit(False).alias("gram"), "key", F.sum("n").over(by_key).cast("double").alias("value"),
        (F.col("chunk") == F.min("chunk").over(by_key)).alias("first"), "n",
    )
    grams = found.where("gram").select("chunk", "key", "n")
    known = probabilities(grams, order)
    grams = grams.select("chunk", "key").join(known, "key").select(
        "chunk", F.lit(True).alias("gram"), "key", "value", F.lit(False).alias("first"), F.lit(0).cast("bigint").alias("n")
    )
    answers = words.union(grams)

    def lookup(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key = table.column("key").to_numpy().view(U64)
        order_ = np.argsort(key)
        return key[order_], table.column("value").to_numpy()[order_]

    def values(seen: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        codes, distinct = pd.factorize(seen)
        return known[1][np.searchsorted(known[0], distinct)][codes] if len(distinct) else np.zeros(0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gram = right.column("gram").to_numpy()
        word_part, gram_part = right.filter(pa.array(~gram)), right.filter(pa.array(gram))
        word_counts, gram_values = lookup(word_part), lookup(gram_part)
        first = word_part.column("first").to_numpy() & (word_part.column("value").to_numpy() > 0)
        parts = [int(first.sum()), int(word_part.column("n").to_numpy().sum())]
        out = []
        for batch in blocks(left.to_batches(), "body"):
            body = Body(batch.column("body"), order)
            counts = values(body.words, word_counts)
            end = values(np.array([END], dtype=U64), word_counts)[0]
            n_words = np.diff(body.first)
            logs = np.concatenate([[0.0], np.cumsum(np.log10(counts + 1))])
            out.append(
                pa.table(
                    {
                        "doc_id": batch.column("doc_id"),
                        "train": batch.column("train"),
                        "n_tokens": pa.array(n_words + 1),
                        "n_known": pa.array(sums(counts > 0, body.first) + int(end > 0)),
                        "logs": pa.array(logs[body.first[1:]] - logs[body.first[:-1]] + np.log10(end + 1)),
                        "score": pa.array(np.add.reduceat(values(body.grams, gram_values), body.offsets[:-1])),
                        "v": pa.array(np.array([parts[0]] + [0] * (len(n_words) - 1), dtype=np.int64)),
                        "n": pa.array(np.array([parts[1]] + [0] * (len(n_words) - 1), dtype=np.int64)),
                    }
                )
            )
            parts = [0, 0]
        return pa.concat_tables(out)

    fields = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, logs double, score double, v bigint, n bigint"
    rows = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, fields)
    rows = stored(rows, "scores")
    total = rows.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("kinds") + 1)
    return rows.crossJoin(F.broadcast(total)).select(
        "doc_id", "train", "n_tokens", "n_known", F.col("train_tokens").cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
