"""SimHash near-duplicates by segment bit counts.

A fingerprint is mapped to the bit counts of its 2-bit segments, a point with 32 coordinates per 64 bits. The Manhattan
distance of two points never exceeds the Hamming distance of the fingerprints, so fingerprints within `radius` bits lie
within `radius` of each other. The coordinates are dealt to eight groups. A distance of at most 4 touches at most four
groups, so close points agree in four whole groups: in one of the 70 grids over four groups they lie in the same cell.
Fingerprints that share a cell are compared exactly.

Distinct fingerprints are compared, not documents. A crowded cell is cut into blocks of hashed members and every pair of
blocks is a task's unit of work. Whatever its size, a unit returns a forest that connects what is linked, not the linked pairs.

Near copies by Jaccard similarity are proposed by such grids, over two fingerprints of a set of shingles, with more groups in a
cell the more sets there are, so that chance meetings don't grow with their square: points that share a cell and whose sketches cannot tell their sets apart belong to one proposed group. Fingerprints of sets that are just similar
enough often share no cell, so groups that the grids left apart are looked up once more by the least hashes of their sets. The
sets of each proposed group are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.llm.components import components
from retrace.llm.scratch import stored
from retrace.llm.textbytes import PLAIN_WORD, Texts, U64, Words, blocks, lists, mixed, signed
from retrace.llm.xxh import xxh64

GROUPS = 8
BLOCK = 2048
SMALL = 48
LEAST = 24
#: fingerprints of a set of shingles whose grids propose near copies
LANES = 2
#: random others that a set may meet in its cells
CHANCE = 0.25
#: shingles in a block of a proposed group
ROOM = 1 << 20
_ODD = 0x5555555555555555
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _majorities(hashes: np.ndarray, owner: np.ndarray, count: int, shingles: np.ndarray) -> np.ndarray:
    """64-bit value per text whose bits are set in more than half of its hashes."""
    lanes = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((count, 64), dtype=np.uint8)
    for lane in range(8):
        seen = np.bincount(owner * 256 + lanes[:, lane], minlength=count * 256).reshape(count, 256)
        bits[:, lane * 8 : lane * 8 + 8] = 2 * (seen @ _BITS) > shingles[:, None]
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(U64)


def _shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of every shingle of lower-case words, the text it is of, and the number of shingles of every text."""
    found = Words(Texts(column), PLAIN_WORD, lower=True)
    per_text = found.per_text
    size = np.minimum(per_text, words)
    shingles = np.where(per_text == 0, 0, per_text - size + 1)
    owner = np.repeat(np.arange(found.count), shingles)
    before = np.cumsum(shingles) - shingles
    first = np.arange(len(owner)) - np.repeat(before - found.first[:-1], shingles)
    last = first + size[owner] - 1
    hashes = xxh64(found.data, found.starts[first], found.starts[last] + found.lengths[last] - found.starts[first])
    return hashes, owner, shingles


def block_fingerprints(column: pa.Array, words: int, lanes: int) -> list[np.ndarray]:
    """`lanes` 64-bit fingerprints of every text; the first is of XXH64 itself, the others of values mixed from it."""
    hashes, owner, shingles = _shingles(column, words)
    out = []
    for lane in range(lanes):
        out.append(_majorities(hashes, owner, len(shingles), shingles))
        hashes = mixed(hashes + U64(lane + 1))
    return out


def text_digest(text: Column) -> Column:
    """64-bit digest of a text; null and empty texts have the same."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """Rows (doc_id, digest, fp0, ...) for every row of `docs`: fingerprints over shingles of lower-case words.

    Null and empty texts, and texts without a word, have fingerprint zero; fewer than `words` words count as one shingle.
    """
    names = [f"fp{i}" for i in range(lanes)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = block_fingerprints(batch.column("text"), words, lanes)
            kept = [batch.column("doc_id"), batch.column("digest")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(signed(x)) for x in found]], ["doc_id", "digest", *names])

    fields = ", ".join(f"{n} bigint" for n in names)
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), text_digest(F.col("text")).alias("digest")
    )
    return own.mapInArrow(run, f"doc_id bigint, digest bigint, {fields}")


def _masks(kept: int, grids: int | None) -> list[int]:
    """Bit masks of the grids over `kept` of the groups: all choices of groups, or `grids` of them, evenly spread."""
    chosen = list(combinations(range(GROUPS), kept))
    if grids is not None:
        chosen = [chosen[i * len(chosen) // grids] for i in range(grids)]
    return [sum(3 << (2 * s) for s in range(32) if s % GROUPS in groups) for groups in chosen]


def _literal(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def _counts(fp: str) -> Column:
    """Bit counts of the 32 segments, two bits each."""
    odd, shifted = F.lit(_ODD).cast("bigint"), F.shiftrightunsigned(fp, 1)
    two = F.col(fp).bitwiseAND(shifted).bitwiseAND(odd)
    one = F.col(fp).bitwiseXOR(shifted).bitwiseAND(odd)
    return F.shiftleft(two, 1).bitwiseOR(one)


def cells(points: DataFrame, lanes: int, kept: int, grids: int | None) -> DataFrame:
    """One row per point and grid: the cell's key beside the columns of the point."""
    keys = [
        F.xxhash64(F.lit(lane * 1000 + i), _counts(f"fp{lane}").bitwiseAND(_literal(mask)))
        for lane in range(lanes)
        for i, mask in enumerate(_masks(kept, grids))
    ]
    return points.select("*", F.explode(F.array(*keys)).alias("cell"))


#: whether points of two arrays belong together
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64) <= radius


def _forest(points: np.ndarray, near: Near) -> tuple[list, list]:
    """Pairs of row numbers that connect whatever chains of links connect."""
    left, a, b = np.arange(len(points)), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for i in range(0, len(front), 64):
                away = np.flatnonzero(~hit)
                hit[away] = near(points[front[i : i + 64], None], points[None, left[away]]).any(axis=0)
            front = left[hit]
            a += [np.full(len(front), root)]
            b += [front]
            left = left[~hit]
    return a, b


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number that each of `n` rows reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_groups(group: np.ndarray, points: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of a forest that connects what links connect, in rows sorted by group; b is a tree's first row."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    empty = np.zeros(0, dtype=np.int64)
    met, a, b = [empty], [empty], [empty]
    room = np.repeat(np.where(sizes <= SMALL, starts + sizes, 0), sizes)
    rows, step = np.arange(len(group)), 1
    while len(rows := rows[rows + step < room[rows]]):  # small groups side by side, rows at a distance of `step`
        hit = rows[near(points[rows], points[rows + step])]
        met.append(np.stack([hit, hit + step], axis=1).ravel())
        step += 1
    pairs = np.concatenate(met).reshape(-1, 2)
    label = _settled(len(group), pairs[:, 0], pairs[:, 1])
    a.append(np.flatnonzero(label != np.arange(len(group))))
    b.append(label[a[-1]])
    for i in np.flatnonzero(sizes > SMALL):
        x, y = _forest(points[starts[i] : starts[i] + sizes[i]], near)
        a += [starts[i] + v for v in y]
        b += [starts[i] + v for v in x]
    return np.concatenate(a), np.concatenate(b)


def _units(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Rows (unit, node, columns...) sorted by unit: groups whole, or every pair of the `parts` blocks of a crowded one."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.when(F.col("parts") == 1, F.col(group)).otherwise(
        F.xxhash64(group, F.least("part", "other"), F.greatest("part", "other"))
    )
    return dealt.select(unit.alias("unit"), "node", *columns).repartition("unit").sortWithinPartitions("unit")


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy().view(U64) for n in names], axis=1)


def _edges(dealt: DataFrame, link: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Distinct edges (a, b) between the nodes of the row numbers that `link` returns for tables of whole units."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept_rows: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            node = table.column("node").to_numpy()
            a, b = link(table)
            edge = np.unique(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])]), axis=1)
            edge = edge[:, edge[0] != edge[1]]
            return pa.RecordBatch.from_arrays([pa.array(edge[0]), pa.array(edge[1])], ["a", "b"])

        for batch in batches:  # the last unit of a batch may go on in the next one
            unit = batch.column("unit").to_numpy(zero_copy_only=False)
            if not len(unit):
                continue
            cut = int(np.flatnonzero(unit == unit[-1])[0])
            if cut:
                yield pairs(pa.Table.from_batches([*kept_rows, batch.slice(0, cut)]))
                kept_rows = []
            elif kept_rows and kept_rows[-1].column("unit")[-1].as_py() != int(unit[0]):
                yield pairs(pa.Table.from_batches(kept_rows))
                kept_rows = []
            kept_rows.append(batch.slice(cut))
        if kept_rows:
            yield pairs(pa.Table.from_batches(kept_rows))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def links(points: DataFrame, lanes: int = 1, radius: int = 4, kept: int = 4, grids: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes of `points` (node, fp0, ...) whose fingerprints are within `radius` bits.

    With one lane, radius 4, kept 4 and all grids, no link between different fingerprints is lost: the edges connect
    exactly what chains of links connect. With more lanes the radius holds for all bits together and `grids` cells per lane
    propose candidates: a higher `kept` gives finer cells for larger corpora, a lower one finds more.
    """
    rows = cells(points, lanes, kept, grids)
    counted = rows.groupBy("cell").agg(F.count("*").alias("n"))
    if grids is None:  # coarser cells are nearly always shared
        counted = counted.where("n > 1")
    counted = counted.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    fps = [f"fp{i}" for i in range(lanes)]
    # Spark sizes a table by the one before an explode and by compressed files: neither side is broadcast
    dealt = _units(rows.join(counted.hint("merge"), "cell"), "cell", fps)
    return _edges(dealt, lambda table: link_groups(table.column("unit").to_numpy(), _columns(table, fps), partial(_near, radius=radius)))


def near_groups(
    docs: DataFrame, words: int = 4, lanes: int = 1, radius: int = 4, kept: int = 4, grids: int | None = None
) -> DataFrame:
    """Rows (doc_id, digest, node, fp0, ..., component_id) for every row of `docs`.

    component_id is the smallest doc_id reached over links, the row's own among them. Repeated rows, ties and texts
    without words (fingerprint zero) are linked like any others; null doc_ids are never a component_id unless a whole
    group has none. Other columns of `docs` are not looked at. An empty table gives an empty result.
    """
    names = [f"fp{i}" for i in range(lanes)]
    node = F.col("fp0") if lanes == 1 else F.xxhash64(*names)
    rows = stored(fingerprints(docs, words, lanes).withColumn("node", node), "fingerprints")
    points = rows.groupBy("node", *names).agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select("node", *names), lanes, radius, kept, grids))
    member = points.select("node", "least").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("node", "root").join(groups.hint("merge"), "root").select("node", "component_id")
    return rows.join(named.hint("merge"), "node")


def digits(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _distinct(hashes: np.ndarray, owner: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in rising order text by text, the texts they are of, and their number; zero stands for no shingle."""
    none = np.flatnonzero(shingles == 0)
    hashes, owner = np.append(hashes, np.zeros(len(none), dtype=U64)), np.append(owner, none)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new], np.bincount(owner[new], minlength=len(shingles))


def _parities(hashes: np.ndarray, owner: np.ndarray, count: int) -> list[np.ndarray]:
    """256 bits per text, in four values: whether an odd number of its shingles fall into each of 256 classes."""
    odd = np.bincount(owner * 256 + (mixed(hashes) & U64(255)).astype(np.int64), minlength=count * 256) & 1
    return list(np.packbits(odd.astype(np.uint8).reshape(count, 256), axis=1).view(">u8").astype(U64).T)


_SKETCH = ["n", *[f"odd{i}" for i in range(4)], *[f"fp{i}" for i in range(4)]]


def shingle_sets(docs: DataFrame, words: int, similarity: float, least: int | None = LEAST) -> DataFrame:
    """Rows (doc_id, digest, node, least hashes, n, odd..., fp...) for every row of `docs`, by its set of shingles.

    Two sets within `similarity` s have a common shingle among their floor((1 - s) n) + 1 least ones. The `least` least ones
    are enough for larger sets: a pair has none in common with a probability below (1 - s) ** least. None takes them all.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, owner, n = _distinct(*_shingles(batch.column("text"), words))
            starts = np.cumsum(n) - n
            node = mixed(np.add.reduceat(mixed(hashes + U64(1)), starts) + n.astype(U64)) if len(n) else hashes
            first = np.floor((1 - similarity) * n + 1e-9).astype(np.int64) + 1
            first = np.minimum(first, n if least is None else least)
            lowest = hashes[np.arange(len(hashes)) - starts[owner] < first[owner]]
            sketch, lane = [n.astype(np.int64), *map(signed, _parities(hashes, owner, len(n)))], hashes
            for i in range(4):
                sketch.append(signed(_majorities(lane, owner, len(n), n)))
                lane = mixed(lane + U64(i + 1))
            kept = [batch.column("doc_id"), batch.column("digest"), pa.array(signed(node)), lists(signed(lowest), first, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sketch)], ["doc_id", "digest", "node", "least", *_SKETCH])

    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_digest(F.col("text")).alias("digest")
    )
    numbers = ", ".join(f"{n} bigint" for n in _SKETCH)
    return own.mapInArrow(run, f"doc_id bigint, digest bigint, node bigint, least array<bigint>, {numbers}")


def _maybe(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """False only for sketches whose sets are below `similarity`.

    Parities differ in no more bits than the sets in shingles. Sets too large for that are told apart by the majorities, whose
    bits differ by chance: seven standard deviations beyond the expected number are allowed.
    """
    a, b = left[..., 0].astype(np.float64), right[..., 0].astype(np.float64)
    apart = np.bitwise_count(left[..., 1:5] ^ right[..., 1:5]).sum(axis=-1, dtype=np.int64)
    turned = np.bitwise_count(left[..., 5:] ^ right[..., 5:]).sum(axis=-1, dtype=np.int64)
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    radius = 256 * p + 7 * np.sqrt(256 * p * (1 - p))
    fits = (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * (a + b) + 1e-6)
    return fits & ((a + b < 800) | (turned <= radius))


def fineness(points: int) -> int:
    """Groups that a cell keeps so that of `points` random fingerprints each meets at most CHANCE others in all its cells.

    Two random segments have equal bit counts with a probability of 3/8. With a fixed number of groups chance meetings would grow
    with the square of the points. At least half of the groups are kept.
    """
    for kept in range(GROUPS // 2, GROUPS):
        if LANES * comb(GROUPS, kept) * (3 / 8) ** (32 // GROUPS * kept) * points <= CHANCE:
            return kept
    return GROUPS


def grid_candidates(points: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of forests that connect what pairs of points with a common grid cell and fitting sketches connect.

    `points` has one row (node, sketch) per set. The more points, the finer the cells; what shares none is left to
    `rest_candidates`.
    """
    kept = fineness(points.count())
    spread = points.select("node", F.array(*[_counts(f"fp{i}") for i in range(LANES)]).alias("counts"))
    spread = spread.repartition(int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    masks = F.array(*[_literal(mask) for mask in _masks(kept, None)])
    lane = spread.select("node", F.posexplode("counts").alias("lane", "counts"))
    grid = lane.select("node", "lane", "counts", F.explode(masks).alias("mask"))
    cell = grid.select("node", F.xxhash64("lane", "mask", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"))
    shared = cell.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    return _fitting(cell.join(shared.hint("merge"), "cell"), points, _SKETCH, partial(_maybe, similarity=similarity))


def rest_candidates(rows: DataFrame, points: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between sets that the grids left apart: forests over common least hashes and fitting sketches.

    `joined` has the node (node, root) on which the grids hung a node. Cells all of whose nodes hang on one are left out, and of
    cells with the same members one is enough.
    """
    cell = rows.select("node", "least").join(joined.hint("merge"), "node", "left")
    cell = cell.select("node", F.explode("least").alias("cell"), F.coalesce("root", "node").alias("root"))
    shared = cell.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell")
    # every node once, whatever the number of its documents
    member = stored(cell.join(shared, "cell").distinct(), "cells")
    alike = member.groupBy("cell").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    )
    kept = alike.groupBy("n", "x", "y").agg(F.min("cell").alias("cell"))
    kept = kept.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))

    def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left[..., -1] == right[..., -1]) | _maybe(left[..., :-1], right[..., :-1], similarity)

    return _fitting(member.join(kept, "cell"), points, [*_SKETCH, "root"], near)


def _fitting(member: DataFrame, points: DataFrame, columns: list[str], near: Near) -> DataFrame:
    """Edges of the forests in each cell of `member` (node, cell, parts, ...), by the sketches of its points."""
    dealt = _units(member.join(points.hint("merge"), "node"), "cell", columns)
    return _edges(dealt, lambda table: link_groups(table.column("unit").to_numpy(), _columns(table, columns), near))


def proposed_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, root) of all sets in a group of several: what the grids join, joined further by what they left apart."""
    points = stored(rows.select("node", *_SKETCH).distinct(), "points")
    edges = stored(grid_candidates(points, similarity), "joined")
    joined = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    maybe = stored(components(edges.union(rest_candidates(rows, points, joined, similarity))), "maybe")
    return maybe.union(maybe.select(F.col("root").alias("node"), "root").distinct())


def similar_forest(group: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of a forest that connects what pairs with a Jaccard similarity of `similarity` or more connect.

    Rows are sorted by group; row i has the next `sizes[i]` of `hashes`, all distinct.
    """
    ends = np.cumsum(sizes)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        base = ends[lo] - sizes[lo]
        codes, values = pd.factorize(hashes[base : ends[hi - 1]])
        begin, length = ends[lo:hi] - sizes[lo:hi] - base, sizes[lo:hi]
        mark = np.zeros(len(values), dtype=bool)
        left, rest = np.arange(hi - lo), codes  # rows without a place in a tree yet, and their shingles
        while len(left):
            root, trunk = left[0], [left[0]]
            rest, left = rest[length[root] :], left[1:]
            while trunk and len(left):
                one = trunk.pop()
                own = codes[begin[one] : begin[one] + length[one]]
                mark[own] = True
                count = length[left]
                common = np.add.reduceat(mark[rest], np.cumsum(count) - count, dtype=np.int64)
                mark[own] = False
                hit = common >= similarity * (count + length[one] - common) - 1e-6
                if hit.any():
                    found = left[hit]
                    a.append(lo + found)
                    b.append(np.full(len(found), lo + root))
                    trunk += found.tolist()
                    rest, left = rest[np.repeat(~hit, count)], left[~hit]
    return np.concatenate(a), np.concatenate(b)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, least: int | None = LEAST) -> DataFrame:
    """Rows (doc_id, digest, node, component_id) for every row of `docs`.

    Texts are linked when the Jaccard similarity of their sets of shingles of lower-case words is `similarity` or more, and
    texts without a word with each other. Fingerprints, least hashes and sketches only propose groups; in each of them the sets
    themselves are compared. `least` bounds the hashes by which a text looks for others beside its grid cells, see
    `shingle_sets`; None makes the search sure.
    component_id, odd rows and empty tables are as in `near_groups`.
    """
    rows = stored(shingle_sets(docs, words, similarity, least), "sets")
    maybe = proposed_groups(rows, similarity)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")
    points = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(own).alias("own"))
    chosen = points.join(maybe, "node").select("node", "root", "own.doc_id", "own.digest", "own.n")
    chosen = stored(chosen, "proposed")
    parts = chosen.groupBy("root").agg(F.ceil(F.sum("n") / ROOM).cast("int").alias("parts"))
    chosen = chosen.join(parts, "root").select(F.col("doc_id").alias("_d"), F.col("digest").alias("_t"), "node", "root", "parts")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_t")))

    def sets(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, _, n = _distinct(*_shingles(batch.column("text"), words))
            kept = [batch.column(c) for c in ("node", "root", "parts")]
            yield pa.RecordBatch.from_arrays([*kept, lists(signed(hashes), n, pa.int64())], ["node", "root", "parts", "hashes"])

    def link(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = table.column("hashes").combine_chunks()
        sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return similar_forest(table.column("unit").to_numpy(), sizes, held.flatten().to_numpy(), similarity)

    found = texts.select("node", "root", "parts", "text").mapInArrow(sets, "node bigint, root bigint, parts int, hashes array<bigint>")
    roots = components(_edges(_units(found, "root", ["hashes"]), link))
    member = points.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.select("node", "root").join(groups, "root").select("node", "component_id")
    return rows.select("doc_id", "digest", "node").join(named, "node")


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, least: int | None = LEAST) -> DataFrame:
    """The rows of `docs` without those that have a near copy with a smaller doc_id in their group.

    Groups are those of `similar_groups`. One document of each group stays, that of the smallest doc_id, with all its columns;
    if its row is repeated, so it stays. A doc_id that repeats with other texts is judged text by text. Rows without doc_id
    stay only where no document with an id is near.
    """
    groups = similar_groups(docs, words, similarity, least)
    gone = groups.where("not doc_id <=> component_id").select(F.col("doc_id").alias("_retrace_gone"), F.col("digest").alias("_retrace_text"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("_retrace_gone")) & (text_digest(docs["text"]) == F.col("_retrace_text"))
    return docs.join(gone.distinct(), same, "left_anti")
