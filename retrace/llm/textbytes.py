"""Texts of an Arrow batch as one byte array, and the words and keys in it, all with numpy.

Every text is followed by one line feed, so words and lines never reach into the next text and no text is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 2000
U64 = np.uint64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)

#: words [^\x20\x09-\x0D]+
PLAIN_WORD = np.ones(256, dtype=bool)
PLAIN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are lower case
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about BLOCK_BYTES of text and BLOCK_ROWS rows (one long text may exceed it)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + BLOCK_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """Bytes of a block of texts. `offsets[i]:offsets[i + 1]` is text i with its line feed; null counts as empty."""

    def __init__(self, column: pa.Array):
        empty, feed = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        ended = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), empty), empty, feed)
        offsets = np.frombuffer(ended.buffers()[1], dtype=np.int64, count=len(ended) + 1, offset=8 * ended.offset)
        raw = np.frombuffer(ended.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = raw
        self.count = len(column)

    def words(self, kind: np.ndarray = PLAIN_WORD) -> "Words":
        return Words(self, kind)


class Words:
    """Words of a block: `starts` and `lengths` in bytes of `data`, `first[i]:first[i + 1]` are those of text i.

    `data` holds the lower-case words with one space after each, nothing else, if `lower`; otherwise the texts' own bytes.
    """

    def __init__(self, texts: Texts, kind: np.ndarray, lower: bool = False):
        inside = kind[texts.data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        self.lengths = ends - starts
        self.first = np.searchsorted(starts, texts.offsets)
        self.count = texts.count
        self.raw_starts = starts
        if lower:
            keep = inside.copy()
            keep[ends] = True
            self.data = np.where(inside, LOWER[texts.data], np.uint8(0x20))[keep]
            self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        else:
            self.data, self.starts = texts.data, starts

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(self.count), self.per_text)

    def keys(self) -> np.ndarray:
        return keys(self.data, self.starts, self.lengths)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that start a window of `size` words of one text, and the texts they are of."""
        counts = np.maximum(self.per_text - size + 1, 0)
        owner = np.repeat(np.arange(self.count), counts)
        before = np.cumsum(counts) - counts
        return np.arange(len(owner)) - np.repeat(before - self.first[:-1], counts), owner


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _C1
    x = (x ^ (x >> U64(29))) * _C2
    return x ^ (x >> U64(32))


def loads(data: np.ndarray) -> np.ndarray:
    """View of eight bytes from every position, little-endian."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))


def keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit keys of byte spans."""
    eight = loads(data)
    out = lengths.astype(U64) * _C2
    out = mixed(out ^ (eight[starts] & _MASKS[np.minimum(lengths, 8)]))
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        part = eight[starts[more] + at] & _MASKS[np.minimum(lengths[more] - at, 8)]
        out[more] = mixed((out[more] * _C1) ^ part)
        at += 8
        more = more[lengths[more] > at]
    return out


def rolling(word_keys: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2^64 of the `size` words from each of `starts`, mixed once more."""
    out = np.zeros(len(starts), dtype=U64)
    for i in range(size):
        out = out * _C2 + word_keys[starts + i]
    return mixed(out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `values[first[i]:first[i + 1]]` for every i, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column with `counts[i]` of `values` in row i."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
