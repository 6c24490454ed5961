"""Interleave sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks of `block` documents. A source with weight w releases its k-th block
(k = 1, 2, ...) at slot floor((k - 1) / w) and must have placed it by slot ceil(k / w). One block is placed per slot, of all
released blocks the one with the earliest deadline. At every slot each source is then less than one block away from its
share.

Weights are rounded to whole blocks per cycle, so the schedule repeats after one cycle: only that cycle is scheduled, by one
array fold over its slots, and every block of the table finds its slot by arithmetic and a join with the cycle. The size of
that table depends on `cycle` and on the number of sources, not on the documents.

Only DataFrame functions are used. A source that holds much of the table is numbered range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.simhash import text_digest


def quotas(sizes: DataFrame, weights: DataFrame | None, power: float, cycle: int) -> DataFrame:
    """Rows (source, quota): blocks of each source in a cycle, at least one. `sizes` has (source, n).

    Without `weights` (source, weight) the weight of a source is n to the power `power`. Sources without a positive weight
    in the table get the smallest quota, so that no document is lost.
    """
    if weights is None:
        named = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        given = given.groupBy("_s").agg(F.max("_w").alias("_w"))
        named = sizes.join(given, sizes["source"].eqNullSafe(given["_s"]), "left")
        named = named.withColumn("w", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)))
    total = named.agg(F.sum("w").alias("total"))
    share = F.try_divide(F.col("w"), F.col("total"))
    quota = F.greatest(F.round(F.coalesce(share, F.lit(0.0)) * cycle), F.lit(1.0)).cast("bigint")
    return named.crossJoin(F.broadcast(total)).select("source", "n", quota.alias("quota"))


def _deadline(k: Column, quota: Column, slots: Column) -> Column:
    """ceil(k / w) for w = quota / slots, in whole numbers."""
    return F.floor((k * slots + quota - 1) / quota)


def cycle_schedule(quota: DataFrame) -> DataFrame:
    """Rows (source, turn, slot) of one cycle: `turn` counts the blocks of the source from 0.

    State of the fold: blocks placed so far of each source. A source may be placed at slot t if t is not before the release
    of its next block; the smallest (deadline, position in the order of sources) wins. A cycle has as many slots as blocks.
    """
    listed = quota.agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "quota"))).alias("q"),
        F.sum("quota").alias("slots"),
    )
    slots = F.col("slots")

    def place(state: Column, slot: Column) -> Column:
        def bid(item: Column, i: Column) -> Column:
            done = F.element_at(state.getField("done"), i.cast("int") + 1)
            release = F.floor(done * slots / item.getField("quota"))
            due = _deadline(done + 1, item.getField("quota"), slots)
            open_now = (done < item.getField("quota")) & (release <= slot)
            return F.when(open_now, F.struct(due.alias("due"), i.cast("int").alias("i"), done.alias("turn")))

        best = F.array_min(F.transform(F.col("q"), bid))
        done = F.transform(state.getField("done"), lambda n, i: n + F.when(i == best.getField("i"), 1).otherwise(0))
        pick = F.struct(best.getField("i").alias("i"), best.getField("turn").alias("turn"), slot.alias("slot"))
        return F.struct(done.alias("done"), F.array_append(state.getField("plan"), pick).alias("plan"))

    start = F.struct(
        F.transform("q", lambda _: F.lit(0).cast("bigint")).alias("done"),
        F.array().cast("array<struct<i:int,turn:bigint,slot:bigint>>").alias("plan"),
    )
    plan = F.aggregate(F.sequence(F.lit(0).cast("bigint"), slots - 1), start, place, lambda s: s.getField("plan"))
    picks = listed.where(slots > 0).select("q", "slots", F.explode(plan).alias("p"))
    item = F.element_at("q", F.col("p.i") + 1)
    return picks.select(
        item.getField("source").alias("source"), item.getField("quota").alias("quota"), "slots", F.col("p.turn").alias("turn"),
        F.col("p.slot").alias("slot"),
    )


def numbered(docs: DataFrame, by_text: bool) -> DataFrame:
    """Rows (source, doc_id[, digest], n) with n = 0, 1, ... along (doc_id, digest) inside each source.

    Rows are dealt to sorted ranges of (source, doc_id, ...), which cut a large source like any other run of rows, and
    stored once; a row's number is its place in its range behind the rows of the source in earlier ranges.
    """
    own = [F.col("source").alias("source"), F.col("doc_id").alias("doc_id")]
    if by_text:
        own.append(text_digest(F.col("text")).alias("digest"))
    order = ["source", "doc_id", *(["digest"] if by_text else [])]
    rows = docs.select(*own).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    counts = rows.groupBy("source", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("source").alias("_s"), F.col("part").alias("_p"), "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead")
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (part == F.col("_p"))
    n = F.col("ahead") + F.col("at") - F.col("first")
    return rows.join(counts, same).select(*order, n.alias("n"))


def placed(
    docs: DataFrame, weights: DataFrame | None = None, block: int = 16, cycle: int = 1000, power: float = 0.5, by_text: bool = False
) -> DataFrame:
    """Rows (doc_id, source[, digest], n, block, slot, release, deadline) for every row of `docs`.

    `n` counts the documents of a source from 0, `block` its blocks from 0; `slot` is the place of the block in the mixture,
    between `release` and `deadline`. When a source has run out its slots stay empty and the others go on in their order.
    A null source is a source of its own. Repeated rows are rows like any others; ties of doc_id go by text if `by_text`,
    else their rows are alike. An empty table gives an empty result. Texts are not looked at unless `by_text`.
    """
    rows = numbered(docs, by_text)
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    plan = cycle_schedule(quotas(sizes, weights, power, cycle))
    plan = stored(plan.withColumnRenamed("source", "_source"), "schedule")  # one row per slot of the cycle
    number = F.floor(F.col("n") / block)
    rows = rows.withColumn("block", number)
    per_cycle = plan.select(F.col("_source").alias("_q"), "quota", "slots").distinct()
    # both tables have at most `cycle` plus one row per source, whatever the number of documents
    rows = rows.join(F.broadcast(per_cycle), F.col("source").eqNullSafe(F.col("_q"))).drop("_q")
    rows = rows.withColumn("_turn", F.col("block") % F.col("quota"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_turn") == F.col("turn"))
    rows = rows.join(F.broadcast(plan.select("_source", "turn", F.col("slot").alias("_slot"))), same)
    k, quota, slots = F.col("block"), F.col("quota"), F.col("slots")
    return rows.select(
        "doc_id", "source", *(["digest"] if by_text else []), "n", "block",
        (F.floor(k / quota) * slots + F.col("_slot")).alias("slot"),
        F.floor(k * slots / quota).alias("release"), _deadline(k + 1, quota, slots).alias("deadline"),
    )


def interleaved(docs: DataFrame, weights: DataFrame | None = None, block: int = 16, cycle: int = 1000, power: float = 0.5) -> DataFrame:
    """All rows and columns of `docs` in the order of the mixture: by slot, then by place in the block.

    The rows of a partition, and the partitions by number, follow that order, so files written from it do too. Rows that
    repeat (source, doc_id, text) stand together at the place of the first of them.
    """
    places = placed(docs, weights, block, cycle, power, by_text=True)
    places = places.groupBy(F.col("source").alias("_retrace_s"), F.col("doc_id").alias("_retrace_d"), F.col("digest").alias("_retrace_t")).agg(
        F.min(F.struct("slot", "n")).alias("_retrace_place")
    )
    same = (
        docs["source"].eqNullSafe(F.col("_retrace_s")) & docs["doc_id"].eqNullSafe(F.col("_retrace_d")) & (text_digest(docs["text"]) == F.col("_retrace_t"))
    )
    joined = docs.join(places, same).drop("_retrace_s", "_retrace_d", "_retrace_t")
    return joined.repartitionByRange("_retrace_place").sortWithinPartitions("_retrace_place").drop("_retrace_place")
