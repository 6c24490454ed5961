"""Approximate nearest neighbours by largest inner product, with a permutation index.

A fixed number of pivots is drawn from the vectors. Every vector is represented by its nearest pivots in order of nearness;
one coordinate more makes all vectors equally long, so nearness to pivots and the largest inner product agree. A shard of
some thousand vectors is posted in one inverted file per pivot: for each vector, how many places its list goes on from that
pivot. Two lists with l pivots each have the footrule distance l (l + 1) - 2 s, s being the sum over shared pivots of the
smaller of both entries, so a query adds up the files of its own pivots. Vectors are visited in order of that distance and
reranked by the inner product itself.

How many are visited has no fixed limit: a shard's first FIRST are, then always AGAIN more, until they bring no vector into
the query's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrace.llm.scratch import stored

PIVOTS = 256
#: rows from which pivots are chosen, those with the least hashes of vec_id: the documented bound of what the driver sees
SAMPLE = 2048
#: a vector this close (cosine) to a pivot doesn't become another one
ALIKE = 0.8
PLACES = 96
SHARD = 4096
#: tasks a query's best are merged from
PARTS = 1024
QUERY_BLOCK = 8192
FIRST, AGAIN = 320, 64


def usable(table: DataFrame) -> DataFrame:
    """Rows (vec_id, v, norm) of the vectors that take part, `v` as bytes of the table's own number type, one row per vec_id.

    Left out are null ids, vectors that are null, empty or zero or hold a null or non-finite number, and those whose length
    isn't the table's commonest (of equally common ones the smallest). Of rows with one vec_id the vector with the least
    bytes stays.
    """
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            good = known & np.isfinite(values)
            bad = np.diff(np.concatenate([[0], np.cumsum(~good)])[bounds])
            largest = np.zeros(len(size))
            np.maximum.at(largest, np.repeat(np.arange(len(size)), size), np.where(good, np.abs(values), 0))
            kept = np.flatnonzero((bad == 0) & (largest > 0))
            parts = np.repeat(largest, size)
            squares = np.square(np.divide(values, parts, out=np.zeros_like(values), where=good & (parts > 0)))
            norm = largest * np.sqrt(np.diff(np.concatenate([[0], np.cumsum(squares)])[bounds]))
            raw = values.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(kept)), pa.array(size[kept]),
                    pa.array([raw[bounds[i] : bounds[i + 1]].tobytes() for i in kept], type=pa.binary()), pa.array(norm[kept]),
                ],
                ["vec_id", "size", "v", "norm"],
            )

    element = "float" if kind == "<f4" else "double"
    own = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    rows = own.where("vec_id is not null").mapInArrow(run, "vec_id bigint, size bigint, v binary, norm double")
    rows = stored(rows, "vectors-read")
    size = rows.groupBy("size").count().orderBy(F.col("count").desc(), "size").limit(1)
    rows = rows.join(F.broadcast(size.select("size")), "size", "left_semi")  # one row
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("r")).select("vec_id", "r.v", "r.norm")


class Pivots:
    """Pivots, and the order in which vectors see them. `longest` is the largest norm of all vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, limit: int):
        self.longest = longest
        level = self.levelled(vectors)
        chosen: list[int] = []
        nearest = np.full(len(level), -1.0)
        for i in range(len(level)):
            if nearest[i] < ALIKE:
                chosen.append(i)
                nearest = np.maximum(nearest, level @ level[i])
            if len(chosen) == limit:
                break
        self.points = level[chosen]
        self.places = min(PLACES, len(chosen))

    def levelled(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors: scaled by the largest norm, with one coordinate for what is missing to it."""
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(1 - np.square(scaled).sum(axis=1), 0))
        return np.column_stack([scaled, rest])

    def seen_from(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """The nearest pivots of every vector, nearest first; a query's length does not matter, so its last coordinate is 0."""
        near = (vectors / self.longest) @ self.points[:, :-1].T if query else self.levelled(vectors) @ self.points.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.places]


class Shard:
    """Vectors posted in inverted files: row p of `files` has, for every vector, places left in its list from pivot p on."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: Pivots):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        near = pivots.seen_from(self.vectors, query=False)
        self.files = np.zeros((len(pivots.points), len(ids)), dtype=np.uint8)
        self.files[near, np.arange(len(ids))[:, None]] = np.arange(pivots.places, 0, -1, dtype=np.uint8)

    def by_footrule(self, near: np.ndarray) -> np.ndarray:
        """Numbers of the vectors by rising footrule distance from a list of pivots."""
        left = np.arange(len(near), 0, -1, dtype=np.uint8)
        shared = np.minimum(self.files[near], left[:, None])
        if len(near) % 2 == 0:  # two entries fit one byte
            shared = shared[::2] + shared[1::2]
        total = shared.sum(axis=0, dtype=np.uint16)
        return np.argsort(np.uint16(65535) - total, kind="stable")


class Search:
    """Best `k` vectors so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: Pivots, k: int):
        self.ids, self.vectors, self.pivots, self.k = ids, vectors, pivots, k
        self.near = pivots.seen_from(vectors, query=True)
        self.best = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in ids]

    def visit(self, shard: Shard) -> None:
        for i, own in enumerate(self.ids):
            order = shard.by_footrule(self.near[i])
            at, stop = 0, FIRST
            while at < len(order) and self._rerank(i, own, shard, order[at:stop]):
                at, stop = stop, stop + AGAIN

    def _rerank(self, i: int, own: int, shard: Shard, rows: np.ndarray) -> bool:
        """Whether one of the rows is among the best now. Every row's products are summed alike, so equal vectors tie."""
        scores, ids = self.best[i]
        score = (shard.vectors[rows] * self.vectors[i]).sum(axis=1)
        fit = shard.ids[rows] != own
        if len(scores) == self.k:
            fit &= score >= scores[-1]
        if not fit.any():
            return False
        score, found = score[fit], shard.ids[rows[fit]]
        all_scores, all_ids = np.concatenate([scores, score]), np.concatenate([ids, found])
        kept = np.lexsort((all_ids, -all_scores))[: self.k]
        self.best[i] = (all_scores[kept], all_ids[kept])
        return bool((kept >= len(scores)).any())

    def rows(self) -> pa.RecordBatch:
        n = np.array([len(s) for s, _ in self.best], dtype=np.int64)
        join = lambda j, kind: np.concatenate([b[j] for b in self.best]).astype(kind) if len(self.best) else np.zeros(0, dtype=kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(join(1, np.int64)), pa.array(join(0, np.float64))], ["query_id", "vec_id", "score"]
        )


def neighbours(table: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the `k` vectors found with the largest inner product, for every query.

    `table` has (vec_id, embedding); `is_query` is a condition on vec_id. Candidates are all vectors but the query's own. Equal
    scores go to the smaller vec_id; with fewer than `k` candidates all are returned, with none the query has no row.
    See `usable` for vectors that take no part and repeated ids. Products beyond the range of doubles are not ranked rightly.
    An empty table gives an empty result. Other columns aren't looked at.

    Queries and shards meet in units: a part of the shards and a block of queries, streamed through one task shard by shard.
    """
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    vectors = stored(usable(table), "vectors").withColumn("wanted", F.coalesce(is_query, F.lit(False)))
    size = vectors.agg(F.count("*").alias("n"), F.count_if("wanted").alias("queries"), F.max("norm").alias("longest")).first()
    spread = F.xxhash64("vec_id")
    sample = vectors.select("v", spread.alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    seen = np.array([np.frombuffer(r["v"], dtype=kind) for r in sample], dtype=np.float64) if sample else np.zeros((0, 1))
    model = table.sparkSession.sparkContext.broadcast(Pivots(seen, size["longest"] or 1.0, pivots))
    shards = max(-(-size["n"] // SHARD), 1)
    parts, query_blocks = min(shards, PARTS), max(-(-size["queries"] // QUERY_BLOCK), 1)

    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    shard = F.pmod(spread, F.lit(shards))
    posted = vectors.select((shard % parts).alias("part"), steps(query_blocks).alias("query_block"), shard.alias("shard"), "vec_id", "v")
    asked = vectors.where("wanted").select(
        steps(parts).alias("part"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).alias("query_block"),
        F.lit(-1).cast("bigint").alias("shard"), "vec_id", "v",
    )
    # a unit's queries come first, then its shards one after the other
    units = asked.unionByName(posted).repartition("part", "query_block")
    units = units.sortWithinPartitions("part", "query_block", "shard", "vec_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        unit, search = None, None
        for (part, query_block, number), ids, raw in _runs(batches):
            matrix = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
            if number < 0:
                if search is not None:
                    yield search.rows()
                unit, search = (part, query_block), Search(ids, matrix, model.value, k)
            elif unit == (part, query_block):
                search.visit(Shard(ids, matrix, model.value))
        if search is not None:
            yield search.rows()

    found = units.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batches) -> Iterator[tuple[tuple[int, int, int], np.ndarray, list[bytes]]]:
    """Runs of rows with one (part, query_block, shard), put together across batches."""
    key, ids, raw = None, [], []
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("part", "query_block", "shard")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        own, values = batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            new = tuple(int(x) for x in keys[a])
            if new != key and key is not None:
                yield key, np.concatenate(ids), raw
                ids, raw = [], []
            key = new
            ids.append(own[a:b])
            raw += values[a:b]
    if key is not None:
        yield key, np.concatenate(ids), raw
