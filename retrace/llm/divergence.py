"""Source divergence audit: how far the sources of a language lie apart in the words they use.

Groups (lang, source) and terms form one count matrix per language. Cells are whole numbers: a group's share of a term with
two added to every count, in billionths, and all values after it are sums of whole-number quotients, so any order of
summation gives the same result.

The matrix is priced by a K-squared quadtree. Its columns are dealt by hashed term into tiles of bounded size and its rows
into bands, so a unit of work is one tile and a pair of bands. A unit holds the nonzero cells as the levels of a K-squared
tree (K = 2): every node that isn't all zero has four child bits, and the number of set bits before a child is the child's
place on the next level. Pairs of groups descend together: a step goes on while one of the two row halves has a nonzero cell
in the column half. Where both are all zero nothing is visited; the columns left out that way all cost the same for a pair
of groups, so one product per pair prices them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.textbytes import LOWER, Texts, U64, Words, blocks, mixed

#: terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

BAND = 256
TILE_CELLS = 1 << 16
#: pairs of nodes looked at together, which bounds memory
STRIDE = 1 << 19
BILLION = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) for the terms of each block of texts: occurrences, and documents that have it.

    Terms are found by 64-bit keys of (document, term) and of (group, term); equal ones are added up by Spark afterwards.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = Words(Texts(batch.column("text")), LETTERS, lower=True)
            owner, key = words.owner(), words.keys()
            group, _ = pd.factorize(batch.column("group").to_numpy())
            _, first, per_doc = np.unique(key ^ mixed(owner.astype(U64) + U64(1)), return_index=True, return_counts=True)
            of = group[owner[first]]
            number, _ = pd.factorize(key[first] ^ mixed(of.astype(U64) + U64(1)))
            n, docs_with = np.bincount(number, per_doc).astype(np.int64), np.bincount(number)
            at = np.empty(len(n), dtype=np.int64)
            at[number[::-1]] = np.arange(len(number))[::-1]
            word = first[at]
            ends = np.cumsum(words.lengths[word])
            put = np.repeat(words.starts[word] - (ends - words.lengths[word]), words.lengths[word]) + np.arange(ends[-1] if len(ends) else 0)
            offsets = np.concatenate([[0], ends]).astype(np.int64)
            term = pa.LargeStringArray.from_buffers(len(word), pa.py_buffer(offsets), pa.py_buffer(words.data[put]))
            rows = pa.array(owner[word])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(rows), batch.column("source").take(rows), term.cast(pa.string()), pa.array(n), pa.array(docs_with.astype(np.int64))],
                ["lang", "source", "term", "n", "docs"],
            )

    own = named(docs).withColumn("group", F.xxhash64("lang", "source"))
    found = own.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_cells(counts: DataFrame, least_docs: int) -> DataFrame:
    """Cells of terms in at least `least_docs` documents of their language, with the language's count and a mark on one cell
    of every term."""
    whole = Window.partitionBy("lang", "term")
    cells = counts.withColumns(
        {
            "in_docs": F.sum("docs").over(whole),
            "lang_n": F.sum("n").over(whole),
            "leads": F.row_number().over(whole.orderBy("source")) == 1,
        }
    )
    return cells.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "leads")


def groups_of(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows (lang, source, total, lang_total, terms, cells, sources, row) for every occurring group, those without terms too.

    `row` numbers the sources of a language from 0; a language's report has sources times sources rows anyway.
    """
    sums = cells.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum(F.col("leads").cast("bigint")).alias("led"), F.count("*").alias("filled")
    )
    occurring = named(docs).select("lang", "source").distinct()
    whole, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    return occurring.join(sums, ["lang", "source"], "left").select(
        "lang", "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(whole), F.lit(0)).alias("lang_total"),
        F.coalesce(F.sum("led").over(whole), F.lit(0)).alias("terms"),
        F.coalesce(F.sum("filled").over(whole), F.lit(0)).alias("cells"),
        F.count("*").over(whole).alias("sources"),
        (F.row_number().over(order) - 1).cast("bigint").alias("row"),
    )


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); decimals, as the product outgrows 64 bits. Without terms it is never used."""
    whole = f"CAST(greatest({total} + 2 * {terms}, 1) AS DECIMAL(20, 0))"
    return F.expr(f"1 + (CAST({BILLION} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(19, 0))) DIV {whole}")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


class Quadtree:
    """Levels of a K-squared tree (K = 2) over a square of 2^depth rows and columns.

    `bits[l]` has four child flags for each node of level l (0 is the root), `child[l]` the places of those children on level
    l + 1. The nodes of the last level are the cells, in the order of `cell`.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, depth: int):
        code = np.zeros(len(row), dtype=np.int64)
        for bit in range(depth):
            code |= ((row >> bit) & 1) << (2 * bit + 1) | ((column >> bit) & 1) << (2 * bit)
        self.cell = np.argsort(code, kind="stable")
        self.depth, self.bits, self.child = depth, [], []
        codes = code[self.cell]
        nodes = [codes]
        for _ in range(depth):
            codes = np.unique(codes >> 2)
            nodes.append(codes)
        nodes.reverse()
        for above, below in zip(nodes, nodes[1:]):
            bits = np.zeros((len(above), 4), dtype=bool)
            bits[np.searchsorted(above, below >> 2), below & 3] = True
            self.bits.append(bits)
            self.child.append((np.cumsum(bits.ravel()) - 1).reshape(-1, 4))

    def down(self, level: int, node: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """Child nodes on the next level, -1 where the quadrant is all zero."""
        at = np.maximum(node, 0)
        there = (node >= 0) & self.bits[level][at, quarter]
        return np.where(there, self.child[level][at, quarter], -1)


def joint_leaves(tree: Quadtree, groups: np.ndarray, size: int, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows a < b with the cells they have in a column where either has one: (a, b, cell of a or -1, cell of b or -1).

    `groups` are the rows in use. With `across`, a is of the first `size` rows and b of the next `size`. Frontiers above
    STRIDE are halved first.
    """
    if not len(tree.cell):
        return
    used = [np.isin(np.arange(1 << level), groups >> (tree.depth - level)) for level in range(tree.depth + 1)]
    zero = np.zeros(1, dtype=np.int64)
    pending = [(0, zero, zero, zero, zero)]
    band_level = tree.depth - (size - 1).bit_length()
    while pending:
        level, a, b, na, nb = pending.pop()
        if len(a) > STRIDE:
            half = len(a) // 2
            pending += [(level, *[x[:half] for x in (a, b, na, nb)]), (level, *[x[half:] for x in (a, b, na, nb)])]
            continue
        if across and level == band_level:
            keep = a < b
            a, b, na, nb = a[keep], b[keep], na[keep], nb[keep]
        if level == tree.depth:
            keep = a < b
            yield tuple(x[keep] for x in (a, b, na, nb))
            continue
        out = []
        for i, j, k in np.ndindex(2, 2, 2):  # row half of a, row half of b, column half
            keep = (a < b) | (i <= j)
            x, y = tree.down(level, na[keep], np.full(keep.sum(), 2 * i + k)), tree.down(level, nb[keep], np.full(keep.sum(), 2 * j + k))
            below_a, below_b = 2 * a[keep] + i, 2 * b[keep] + j
            some = ((x >= 0) | (y >= 0)) & used[level + 1][below_a] & used[level + 1][below_b]
            out.append((below_a[some], below_b[some], x[some], y[some]))
        pending.append((level + 1, *[np.concatenate(c) for c in zip(*out)]))


def tile_prices(part: pd.DataFrame, size: int) -> pd.DataFrame:
    """Rows (lang, a, b, visited, value): columns visited for two groups of a unit, and what these cost.

    `part` has the cells of a tile (row, term, p) and, with a null term, every group of the two bands with its share `p` of a
    term it doesn't have.
    """
    low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
    room = 1 << (size - 1).bit_length()  # where the second band's rows begin: half of a quadrant
    local = (part["row"] - low * size).where(part["row"] // size == low, part["row"] - high * size + room).to_numpy(dtype=np.int64)
    filled = part["term"].notna().to_numpy()
    p = part["p"].to_numpy(dtype=np.int64)
    base = np.ones(2 * room, dtype=np.int64)
    base[local[~filled]] = p[~filled]
    row, p = local[filled], p[filled]
    column, _ = pd.factorize(part["term"].to_numpy()[filled])
    # columns of many groups first: what is left is mostly empty and stays unvisited
    weight = np.bincount(column, minlength=1)
    place = np.empty(len(weight), dtype=np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    depth = max(int(2 * room - 1).bit_length(), int(len(weight) - 1).bit_length(), 1)
    tree = Quadtree(row, place[column] if len(row) else column, depth)
    p = p[tree.cell]
    visited, value = (np.zeros((2 * room, 2 * room), dtype=np.int64) for _ in range(2))
    for a, b, x, y in joint_leaves(tree, local[~filled], room, low != high):
        one, other = np.where(x >= 0, p[x], base[a]), np.where(y >= 0, p[y], base[b])
        np.add.at(visited, (a, b), 1)
        np.add.at(value, (a, b), (one - other) ** 2 // (one + other))
    a, b = np.nonzero(visited)
    rows = lambda r: np.where(r < room, r + low * size, r - room + high * size)
    return pd.DataFrame({"lang": part["lang"].iloc[0], "a": rows(a), "b": rows(b), "visited": visited[a, b], "value": value[a, b]})


def pair_values(cells: DataFrame, groups: DataFrame, band: int = BAND, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Rows (lang, source, item, value) for every ordered pair of different sources of a language."""
    tiles, bands = F.ceil(F.col("cells") / tile_cells), F.ceil(F.col("sources") / band)
    own = groups.select("*", F.floor(F.col("row") / band).alias("band"), bands.alias("bands"), tiles.alias("tiles"))
    own = own.withColumn("base", share("0", "total", "terms"))
    with_terms = own.where("terms > 0")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bands") - 1)).alias("other")
    # a term's tile comes from its hash, so a tile has about `tile_cells` cells and never parts a column
    filled = cells.join(with_terms, ["lang", "source"]).select(
        "lang", "row", "band", F.expr("pmod(xxhash64(term), tiles)").alias("tile"), "term", share("n", "total", "terms").alias("p"), other
    )
    blank = with_terms.select(
        "lang", "row", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"),
        F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "bands",
    ).select("lang", "row", "band", "tile", "term", "p", other)
    units = filled.unionByName(blank).select(
        "lang", "tile", F.least("band", "other").alias("low"), F.greatest("band", "other").alias("high"), "row", "term", "p"
    )
    priced = units.groupBy("lang", "tile", "low", "high").applyInPandas(
        lambda part: tile_prices(part, band), "lang string, a bigint, b bigint, visited bigint, value bigint"
    )
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("visited").alias("visited"), F.sum("value").alias("value"))
    # all pairs are the result; a language's pairs are dealt by the band of their second group
    first = own.select("lang", "source", "row", "base", "terms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bands") - 1)).alias("band"))
    second = own.select("lang", "band", F.col("source").alias("item"), F.col("row").alias("item_row"), F.col("base").alias("item_base"))
    pairs = first.join(second, ["lang", "band"]).where("row <> item_row")
    pairs = pairs.withColumns({"a": F.least("row", "item_row"), "b": F.greatest("row", "item_row")})
    unvisited = F.col("terms") - F.coalesce("visited", F.lit(0))
    return pairs.join(priced, ["lang", "a", "b"], "left").select(
        "lang", "source", "item", (F.coalesce("value", F.lit(0)) + unvisited * distance("base", "item_base")).alias("value")
    )


def term_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) for the terms that a group has more often than its language."""
    cells = cells.join(groups, ["lang", "source"])
    cells = cells.withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")})
    return cells.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, band: int = BAND, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): per group its distance from the other sources, and its own terms.

    Part `pair` has every other source of the language, part `term` the `top_terms` terms whose share in the group exceeds
    that in the language by most. Ranks go by falling value, then by item in UTF-8 order. Null lang, source and text count as
    empty strings, which are a language and a source like others. A group whose texts have no kept term is compared by shares
    without counts and has no terms; a language without kept terms has distance 0 everywhere, one with a single source no
    pairs. Repeated rows are documents each. An empty table gives an empty result. Other columns aren't looked at.
    """
    cells = stored(kept_cells(term_counts(docs), least_docs), "term-cells")
    groups = stored(groups_of(docs, cells), "term-groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(by_value).alias("rank")
    pairs = pair_values(cells, groups, band, tile_cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = term_values(cells, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))
