"""Line dictionary: distinct lines, distinct texts, postings and runs of consecutive text ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrace.functions.text import grams, text_key
from retrace.session import materialise

NEWLINE = "\n"
BLOCK = 1 << 20  # text ids per block when building or expanding runs


@dataclass(frozen=True)
class Dictionary:
    """`lines(line_id, key, text)`, `texts(text_id, key, line_ids)`, `frames` with `text_id`, `runs(line_id, first_text, last_text)`.

    `grams(gram, line_id, bucket)`, the trigram table, is there once the dictionary has been stored.
    """

    lines: DataFrame
    texts: DataFrame
    frames: DataFrame
    runs: DataFrame
    grams: DataFrame | None = None


def dense_ids(df: DataFrame, order: list[str], name: str, start: int | Column = 1) -> DataFrame:
    """Consecutive ids in global order.

    The sort is range-partitioned; each row then only needs the number of rows in earlier partitions.
    The sorted rows are checkpointed because both the counts and the ids must see one layout.
    """
    placed = materialise(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per partition of the sort
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    first = F.lit(start) if isinstance(start, int) else start
    joined = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, (F.col("_off") + F.col("_pos") + first).cast("bigint")).drop(
        "_part", "_pos", "_p", "_off"
    )


def split_lines(text: Column) -> Column:
    """Lines of a text; blank and trailing blank lines count."""
    return F.split(text, NEWLINE, -1)


def first_lines(frames: DataFrame, rank: list[str]) -> DataFrame:
    """Distinct lines with the place of their first appearance; repeated lines combine before the shuffle."""
    lines = frames.where(F.col("text") != "").select(*rank, F.posexplode(split_lines("text")).alias("pos", "line"))
    return lines.groupBy("line").agg(F.min(F.struct(*rank, "pos")).alias("first"), F.count(F.lit(1)).alias("uses"))


RANK = ["ts", "device", "base"]


def number_lines(frames: DataFrame, rank: list[str] = RANK) -> DataFrame:
    """Distinct lines, numbered by first appearance."""
    seen = first_lines(frames, rank).select(F.col("line").alias("text"), "first")
    return dense_ids(seen, ["first"], "line_id").select("line_id", text_key("text").alias("key"), "text")


def number_texts(frames: DataFrame, rank: list[str] = RANK) -> DataFrame:
    """Distinct non-empty texts, numbered by first appearance."""
    distinct = frames.where(F.col("text") != "").groupBy("text").agg(F.min(F.struct(*rank)).alias("first"))
    return dense_ids(distinct, ["first"], "text_id").select("text_id", "text")


def build(frames: DataFrame, rank: list[str] = RANK) -> Dictionary:
    """Number lines and texts by first appearance. Frames without text get a NULL text_id."""
    lines, texts = number_lines(frames, rank), number_texts(frames, rank)
    listed = with_line_ids(texts, lines)
    return Dictionary(lines, listed, point_frames(frames, texts), line_runs(postings(listed)))


def with_line_ids(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace each distinct text by the ids of its lines.

    A line that most texts share is skewed on the line side; the adaptive skew join splits it. A text is one
    input row, so collecting its ids back stays as large as that row.
    """
    words = texts.select("text_id", F.posexplode(split_lines("text")).alias("pos", "line"))
    ids = lines.select("line_id", F.col("text").alias("line"))
    per_text = (
        words.join(ids, "line")
        .groupBy("text_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line_id"))).alias("items"))
        .select("text_id", F.col("items.line_id").alias("line_ids"))
    )
    keyed = texts.select("text_id", text_key("text").alias("key"))
    return keyed.join(per_text, "text_id").select("text_id", "key", "line_ids")


def point_frames(frames: DataFrame, texts: DataFrame) -> DataFrame:
    """Frames carry text_id instead of text. The join ships the full SHA-256 digest instead of the text."""
    digest = F.sha2("text", 256)
    ids = texts.select("text_id", digest.alias("_digest"))
    left = frames.withColumn("_digest", F.when(F.col("text") != "", digest))
    return left.join(ids, "_digest", "left").drop("_digest", "text")


def postings(texts: DataFrame) -> DataFrame:
    """(line_id, text_id) pairs, one per distinct line of a text."""
    return texts.select("text_id", F.explode(F.array_distinct("line_ids")).alias("line_id"))


def line_runs(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ranges of consecutive text ids per line.

    Runs are built inside blocks of text ids, so a line found in nearly every text spreads over many tasks;
    afterwards only runs touching a block border (two per line and block at most) are joined together.
    """
    placed = pairs.withColumn("_block", F.floor(F.col("text_id") / F.lit(block)).cast("bigint"))
    w = Window.partitionBy("line_id", "_block").orderBy("text_id")
    inside = (
        placed.withColumn("_grp", F.col("text_id") - F.row_number().over(w))
        .groupBy("line_id", "_block", "_grp")
        .agg(F.min("text_id").alias("first_text"), F.max("text_id").alias("last_text"))
    )
    at_border = (F.col("first_text") == F.col("_block") * block) | (
        F.col("last_text") == (F.col("_block") + 1) * block - 1
    )
    final = inside.where(~at_border).select("line_id", "first_text", "last_text")
    chain = Window.partitionBy("line_id").orderBy("first_text")
    touching = inside.where(at_border).select("line_id", "first_text", "last_text")
    starts = F.coalesce(F.lag("last_text").over(chain) + 1 != F.col("first_text"), F.lit(True))
    merged = (
        touching.withColumn("_start", starts)
        .withColumn("_run", F.sum(F.col("_start").cast("bigint")).over(chain))
        .groupBy("line_id", "_run")
        .agg(F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"))
        .select("line_id", "first_text", "last_text")
    )
    return final.unionByName(merged)


def expand_runs(runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Text ids covered by runs; long runs are cut at block borders before they are unfolded."""
    cut = runs.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("first_text") / block), F.floor(F.col("last_text") / block))),
    )
    lo = F.greatest(F.col("first_text"), (F.col("_block") * block).cast("bigint"))
    hi = F.least(F.col("last_text"), ((F.col("_block") + 1) * block - 1).cast("bigint"))
    return cut.select("line_id", F.explode(F.sequence(lo, hi)).alias("text_id"))


def reassemble(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Text of each text id: its lines in order, joined by newlines."""
    words = texts.select("text_id", F.posexplode("line_ids").alias("pos", "line_id"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return (
        words.join(lines.select("line_id", "text"), "line_id")
        .groupBy("text_id")
        .agg(F.array_join(ordered["text"], NEWLINE).alias("text"))
    )


def shots(dictionary: Dictionary) -> DataFrame:
    """Frames with their text put back; frames without text show the empty string."""
    texts = reassemble(dictionary.texts, dictionary.lines)
    joined = dictionary.frames.join(texts, "text_id", "left")
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def compression(frames: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(metric, value) rows: frames, characters, distinct lines and texts, postings and runs."""
    rows, chars = F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))
    listed = F.size(F.array_distinct("line_ids"))
    tables = [
        frames.agg(rows.alias("frames"), chars.alias("raw_chars")),
        dictionary.lines.agg(rows.alias("distinct_lines"), chars.alias("line_chars")),
        dictionary.texts.agg(rows.alias("distinct_texts"), F.coalesce(F.sum(listed), F.lit(0)).alias("postings")),
        dictionary.runs.agg(rows.alias("runs")),
    ]
    out = None
    for row in tables:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in row.columns])
        part = row.select(F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    return out


# -- stored form --------------------------------------------------------------------------------


GRAM_BUCKETS = 256


def gram_bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BUCKETS)).cast("int")


def trigrams(lines: DataFrame) -> DataFrame:
    """(gram, line_id, bucket) of every dictionary line of three characters or more, case folded."""
    found = lines.where(F.length("text") >= 3).select(F.explode(grams(F.lower("text"), 3)).alias("gram"), "line_id")
    return found.withColumn("bucket", gram_bucket(F.col("gram")))


def save(dictionary: Dictionary, folder: str) -> None:
    """Store all tables. Runs are sorted by line and trigrams lie in folders by hash, so a search opens what it needs."""
    dictionary.lines.write.mode("overwrite").parquet(f"{folder}/lines")
    dictionary.texts.write.mode("overwrite").parquet(f"{folder}/texts")
    dictionary.frames.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/frames")
    stored = dictionary.lines.sparkSession.read
    pairs = postings(stored.parquet(f"{folder}/texts"))
    line_runs(pairs).repartitionByRange("line_id").sortWithinPartitions("line_id").write.mode("overwrite").parquet(f"{folder}/runs")
    table = trigrams(stored.parquet(f"{folder}/lines")).repartition("bucket").sortWithinPartitions("bucket", "gram")
    table.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams")


def load(spark: SparkSession, folder: str) -> Dictionary:
    return Dictionary(*[spark.read.parquet(f"{folder}/{name}") for name in ("lines", "texts", "frames", "runs", "grams")])


def extend(store: Dictionary, fresh: DataFrame, rank: list[str] = RANK) -> Dictionary:
    """Rows to append for new frames: unseen lines and texts get the next ids, old ids never move.

    Single writer per store. Returns only the additions, but all `runs`, since old ones may grow; `frames` holds the new
    frames with their text_id.
    """
    known = store.lines.select("key", "text")
    seen = first_lines(fresh, rank).select(F.col("line").alias("text"), "first")
    seen = seen.withColumn("key", text_key("text"))
    new_lines = seen.join(known, ["key", "text"], "left_anti")
    line_start = store.lines.agg((F.coalesce(F.max("line_id"), F.lit(0)) + 1).alias("n")).first()["n"]
    added_lines = dense_ids(new_lines, ["first"], "line_id", int(line_start)).select("line_id", "key", "text")
    all_lines = store.lines.unionByName(added_lines)

    distinct = fresh.where(F.col("text") != "").groupBy("text").agg(F.min(F.struct(*rank)).alias("first"))
    candidates = distinct.withColumn("key", text_key("text"))
    # a text is known only if its key and its whole line list are known
    numbered = dense_ids(candidates, ["first"], "text_id", 1)
    listed = with_line_ids(numbered.select("text_id", "text"), all_lines).withColumnRenamed("text_id", "_n")
    old = store.texts.select("text_id", "key", "line_ids")
    matched = listed.join(old, ["key", "line_ids"], "left")
    text_start = store.texts.agg((F.coalesce(F.max("text_id"), F.lit(0)) + 1).alias("n")).first()["n"]
    unseen = matched.where(F.col("text_id").isNull()).drop("text_id")
    added_texts = dense_ids(unseen, ["_n"], "text_id", int(text_start))
    known_ids = matched.where(F.col("text_id").isNotNull()).select("_n", "text_id")
    ids = known_ids.unionByName(added_texts.select("_n", "text_id"))
    by_text = numbered.select(F.col("text_id").alias("_n"), "text").join(ids, "_n").select("text_id", "text")
    texts = added_texts.select("text_id", "key", "line_ids")
    return Dictionary(added_lines, texts, point_frames(fresh, by_text), extend_runs(store.runs, postings(texts)))


def extend_runs(runs: DataFrame, added_pairs: DataFrame) -> DataFrame:
    """All runs after new texts: only runs that reach the first new text id can grow."""
    grown = runs.unionByName(line_runs(added_pairs))
    first_new = added_pairs.agg(F.min("text_id").alias("n")).first()["n"]
    if first_new is None:
        return runs
    edge = (F.col("last_text") == first_new - 1) | (F.col("first_text") == first_new)
    merged = grown.where(edge).groupBy("line_id").agg(
        F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text")
    )
    return grown.where(~edge).unionByName(merged)
