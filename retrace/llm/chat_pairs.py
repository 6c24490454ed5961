"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The prompt is the longest common prefix of turns (same role and text); it is rendered once. What follows in each
conversation is its completion. A completion's mask lists character spans that are trained on: the text and end mark of
assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns) with the turns as an array in order of (turn, role, text); nulls first, repeats kept.

    One conversation is one training example and one row.
    """
    item = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), item.alias("item")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.getField("role"), F.lit(MIDDLE), turn.getField("text"), F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of assistant turns in the rendered completion, from 0, end excluded."""
    ends = F.transform(
        turns, lambda _, i: F.aggregate(F.slice(turns, 1, i + 1), F.lit(0), lambda n, t: n + F.char_length(_rendered(t)))
    )
    spans = F.zip_with(
        turns,
        ends,
        lambda t, end: F.when(
            t.getField("role") == "assistant",
            F.struct(
                (end - F.char_length(t.getField("text")) - len(CLOSE)).cast("bigint").alias("start"), end.cast("bigint").alias("end")
            ),
        ),
    )
    return F.filter(spans, lambda s: s.isNotNull())


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    `turns` has (conv_id, turn, role, text), `pairs` has (pair_id, chosen_id, rejected_id). Pairs that name a conversation
    without turns give no row; a pair given twice gives two. Null roles and texts count as empty, turns without conv_id
    belong to no conversation. Conversations without a common first turn have an empty prompt; if one is a prefix of the
    other, its completion is empty, and equal ones have two empty completions. Other columns of the tables aren't looked at.
    """
    told = conversations(turns)
    own = pairs.select(*[F.col(c).cast("bigint").alias(c) for c in ("pair_id", "chosen_id", "rejected_id")])
    joined = own.join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id")
    joined = joined.join(told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id")
    same = lambda x, y: (x.getField("role") == y.getField("role")) & (x.getField("text") == y.getField("text"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: ~F.coalesce(same(x, y), F.lit(False))), True)
    prefix = F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int")
    joined = joined.withColumn("prefix", prefix)
    rest = lambda c: F.slice(c, F.col("prefix") + 1, F.size(c) - F.col("prefix"))
    joined = joined.withColumns({"x": rest(F.col("a")), "y": rest(F.col("b"))})
    return joined.select(
        "pair_id", "chosen_id", "rejected_id",
        F.col("prefix").cast("bigint").alias("n_prompt_turns"),
        _text(F.slice("a", F.lit(1), F.col("prefix"))).alias("prompt"),
        _text(F.col("x")).alias("chosen"), _text(F.col("y")).alias("rejected"),
        _mask(F.col("x")).alias("chosen_mask"), _mask(F.col("y")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: conversation 2i is taken as chosen, 2i + 1 as rejected."""
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).where("conv_id is not null and conv_id % 2 = 0").distinct()
    return ids.select(
        F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id"), F.col("conv_id").alias("chosen_id"),
        (F.col("conv_id") + 1).alias("rejected_id"),
    )
