"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Statistics of every text are computed in blocks with numpy. The trees are fitted on a bounded, hashed sample of the labelled
rows: features are cut into at most `bins` quantile bins, and each level of a tree is chosen from sums of gradients per node
and bin. A fitted model is three flat arrays (feature and threshold per node, value per leaf of complete binary trees), through
which a block of documents is led level by level, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.llm.textbytes import PLAIN_WORD, Texts, U64, blocks, mixed, rolling, sums

SAMPLE = 20_000
NAMES = [
    "log_words", "log_bytes", "word_bytes", "longest_word", "distinct_words", "commonest_word", "repeated_windows",
    "repeated_lines", "line_words", "short_words", "long_words", "same_as_before", "letters", "capitals", "digits", "high_bytes",
    "stops", "commas", "marks", "symbols", "bars", "other_ascii", "blanks", "capital_words", "stop_words", "symbol_words",
    "byte_entropy",
]


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_CAPITAL, _SMALL, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
_STOP, _COMMA, _MARK, _SYMBOL, _BAR = _class(b".!?"), _class(b",;:"), _class(b"'\"()-"), _class(b"#*$%&<>@^~=+_/\\{}[]"), _class(b"|")
_ASCII_OTHER = ~(_CAPITAL | _SMALL | _DIGIT | _STOP | _COMMA | _MARK | _SYMBOL | _BAR | ~PLAIN_WORD)
_ASCII_OTHER[128:] = False


def _largest(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct values, the count of the commonest, and the values that occur more than once."""
    numbers, distinct = pd.factorize(codes)
    counts = np.bincount(numbers, minlength=len(distinct))
    first = np.full(len(distinct), -1)
    first[numbers[::-1]] = owner[::-1]
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, first, counts)
    repeated = np.bincount(owner[counts[numbers] > 1], minlength=n)
    return np.bincount(first, minlength=n), top, repeated


def block_features(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text, finite for every text; a text without words has zeros where shares are taken."""
    texts = Texts(column)
    words, n = texts.words(PLAIN_WORD), texts.count
    owner, per_text, key = words.owner(), words.per_text, words.keys()
    size = np.diff(texts.offsets) - 1
    own = mixed(owner.astype(U64))
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    distinct, top, _ = _largest(key ^ own, owner, n)
    first, of = words.windows(3)
    _, _, repeated = _largest(rolling(key, first, 3) ^ mixed(of.astype(U64)), of, n)

    ends = np.flatnonzero(texts.data == 0x0A)
    bounds = np.searchsorted(words.starts, np.concatenate([[0], ends + 1]))
    some = np.flatnonzero(np.diff(bounds) > 0)
    line_owner = np.searchsorted(texts.offsets, ends[some], side="right") - 1
    line_hash = np.add.reduceat(key * (np.arange(len(key)) - np.repeat(bounds[:-1], np.diff(bounds)) + 1).astype(U64), bounds[some]) if len(some) else np.zeros(0, dtype=U64)
    lines, _, repeated_lines = _largest(line_hash ^ mixed(line_owner.astype(U64)), line_owner, n)
    all_lines = np.bincount(line_owner, minlength=n)

    def per(kind: np.ndarray) -> np.ndarray:
        return share(sums(kind[texts.data], texts.offsets), size)

    head = texts.data[words.starts] if len(words) else np.zeros(0, dtype=np.uint8)
    tail = texts.data[words.starts + words.lengths - 1] if len(words) else head
    count = lambda flags: share(sums(flags, words.first), per_text)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, owner, words.lengths)
    which = np.repeat(np.arange(n), np.diff(texts.offsets)) * 64 + (texts.data >> 2)
    seen = np.bincount(which, minlength=n * 64).reshape(n, 64).astype(float)
    part = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(axis=1)
    return np.stack(
        [
            np.log1p(per_text), np.log1p(size), share(sums(words.lengths, words.first), per_text), np.log1p(longest),
            share(distinct, per_text), share(top, per_text), share(repeated, per_text), share(repeated_lines, all_lines),
            share(per_text, all_lines), count(words.lengths <= 3), count(words.lengths >= 12), count(same),
            per(_CAPITAL | _SMALL), per(_CAPITAL), per(_DIGIT), per(np.arange(256) >= 128), per(_STOP), per(_COMMA), per(_MARK),
            per(_SYMBOL), per(_BAR), per(_ASCII_OTHER), per(~PLAIN_WORD), count(_CAPITAL[head]), count(_STOP[tail]),
            count(_SYMBOL[tail] | _BAR[tail]), entropy,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 (feature <= threshold) and 2i + 2."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2^depth)
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Boost logistic loss. Without rows, or with one class only, no tree is grown and the score is the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, 2**depth)), start)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) for c in x.T]
    binned = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]  # bin b: at most edges[b]
    margin = np.full(len(y), start)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            n, before = 2**level, 2**level - 1
            best = np.full(n, 1e-9)
            for f, (b, e) in enumerate(zip(binned, edges, strict=True)):
                place = (node - before) * bins + b
                g = np.bincount(place, gradient, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                h = np.bincount(place, weight, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(e)]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(axis=1)
                top = gain[np.arange(n), cut]
                better = top > best
                best[better] = top[better]
                feature[before : before + n][better] = f
                threshold[before : before + n][better] = e[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, minlength=inner + 1), np.bincount(leaf, weight, minlength=inner + 1)
        value = -rate * g / (h + ridge)
        margin += value[leaf]
        for kept, new in zip(out, (feature, threshold, value), strict=True):
            kept.append(new)
    return Trees(*[np.array(o) for o in out], start)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, sample: int) -> pd.DataFrame:
    """Features and label of at most `sample` labelled training rows, those with the least hashes of doc_id and text."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(train).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(sample)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = block_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    return texts.select("text", "label").mapInArrow(run, "x array<double>, label int").toPandas()


def scored(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, score, predicted), one per row of `docs`, texts being all that a score looks at.

    `train` is a condition on doc_id that says which labels may be learnt from. The model is fitted on at most `sample` of
    them. A document labelled more than once has its largest label; null labels and ids are left out. Null and empty texts are
    scored like any others; repeated rows are scored each; null doc_ids are kept. Without labels every score is one half.
    An empty table gives an empty result.
    """
    rows = labelled_sample(docs, labels, train, sample)
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    model = docs.sparkSession.sparkContext.broadcast(fit(x, rows["label"].to_numpy().astype(float)))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            score = model.value.scores(block_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
