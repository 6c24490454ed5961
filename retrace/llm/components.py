"""Connected components of an edge table by alternating star contraction.

Nothing is collected but one row count and one checksum a round; edges stay tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrace.llm.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges run from larger to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node with a smaller one in reach, root being the smallest node reached.

    `edges` has two BIGINT columns a and b; loops and repeated edges do no harm. No edges give no rows. Chains of n
    nodes take about log n rounds; a graph that has not settled after `max_rounds` raises an error, never half a result.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = stored(current, "edges"), None
    for _ in range(max_rounds):
        rows, digest = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if before == (rows, digest):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (rows, digest)
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
