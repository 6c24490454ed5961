"""License scan by diagonal voting.

Rolling hashes of all runs of k words of a document meet those of the templates in a join. A hit at word p of the document and
word q of a template votes for the diagonal p - q. Votes are summed by document, template and diagonal; neighbouring diagonals,
which differ by inserted or missing words, are merged; and the words of each merged span are compared with the template's by
their longest common subsequence.

Templates with fewer than five words have k equal to their length and must be met whole; the others have k = 5. A bitmap of
fixed size keeps hashes that no template has from leaving the task; words travel only for documents with a hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrace.llm.scratch import stored
from retrace.llm.textbytes import ALNUM_WORD, Texts, U64, Words, blocks, lists, rolling, signed

K = 5
BITMAP_BITS = 20

# fixed values: phrases that name a license, and the wording of public license notices
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved."),
]


def templates(spark: SparkSession) -> DataFrame:
    """Rows (template, label, base, text): the phrases are the base, the notices the method's own."""
    named = [(label, True, text) for label, text in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return spark.createDataFrame([(i, *t) for i, t in enumerate(named)], "template int, label string, base boolean, text string")


def _own_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(Texts(column), ALNUM_WORD, lower=True)
    return words, words.keys()


def template_grams(found: DataFrame) -> DataFrame:
    """Rows (template, label, base, k, words, hashes) of templates with a word, stored once; hashes by place."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words, key = _own_words(batch.column("text"))
            size = np.minimum(words.per_text, K)
            hashes = []
            for i, k in enumerate(size):
                starts = np.arange(words.first[i], words.first[i + 1] - k + 1)
                hashes.append(signed(rolling(key, starts, k)) if k else np.zeros(0, dtype=np.int64))
            columns = [
                *[batch.column(c) for c in ("template", "label", "base")],
                pa.array(size.astype(np.int32)),
                lists(signed(key), words.per_text, pa.int64()),
                lists(np.concatenate(hashes), np.array([len(h) for h in hashes]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["template", "label", "base", "k", "words", "hashes"])

    fields = "template int, label string, base boolean, k int, words array<bigint>, hashes array<bigint>"
    return stored(found.select("template", "label", "base", "text").mapInArrow(run, fields).where("k > 0"), "templates")


def _bitmaps(grams: DataFrame) -> dict[int, np.ndarray]:
    """For each k a bit per hash slot; at most K times 128 KB."""
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    slots = grams.select("k", F.explode("hashes").alias("hash")).select("k", slot.cast("int").alias("slot")).distinct()
    out: dict[int, np.ndarray] = {}
    for row in slots.groupBy("k").agg(F.collect_set("slot").alias("slots")).collect():  # at most 2^BITMAP_BITS slots each
        out[row["k"]] = np.zeros(1 << BITMAP_BITS, dtype=bool)
        out[row["k"]][row["slots"]] = True
    return out


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows (row, doc_id, n_words, words, hits), one per row of `docs`, stored once; words only where there are hits."""
    bitmaps = docs.sparkSession.sparkContext.broadcast({k: np.packbits(b) for k, b in _bitmaps(grams).items()})

    def run(batches) -> Iterator[pa.RecordBatch]:
        bits = {k: np.unpackbits(b).astype(bool) for k, b in bitmaps.value.items()}
        for batch in blocks(batches):
            words, key = _own_words(batch.column("text"))
            found = []
            for k, slots in bits.items():
                first, owner = words.windows(k)
                hashes = rolling(key, first, k)
                hit = np.flatnonzero(slots[hashes >> U64(64 - BITMAP_BITS)])
                at = first[hit] - words.first[owner[hit]]
                found.append((owner[hit], at, np.full(len(hit), k), signed(hashes[hit])))
            owner, at, k, hashes = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(4))
            order = np.argsort(owner, kind="stable")
            counts = np.bincount(owner, minlength=words.count) if len(owner) else np.zeros(words.count, dtype=np.int64)
            kept = np.repeat(counts > 0, words.per_text)
            entries = pa.StructArray.from_arrays(
                [pa.array(at[order].astype(np.int32)), pa.array(k[order].astype(np.int32)), pa.array(hashes[order])], ["at", "k", "hash"]
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [
                batch.column("doc_id"),
                pa.array(words.per_text.astype(np.int64)),
                lists(signed(key[kept]), np.where(counts > 0, words.per_text, 0), pa.int64()),
                pa.ListArray.from_arrays(offsets, entries),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "words", "hits"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id bigint, n_words bigint, words array<bigint>, hits array<struct<at:int,k:int,hash:bigint>>"
    return stored(own.mapInArrow(run, fields).withColumn("row", F.monotonically_increasing_id()), "hits")


def common_length(template: np.ndarray, span: np.ndarray) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of one number."""
    places: dict[int, int] = {}
    for i, word in enumerate(template.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    state = full
    for word in span.tolist():
        met = state & places.get(word, 0)
        state = ((state + met) | (state - met)) & full
    return len(template) - state.bit_count()


def spans(rows: DataFrame, grams: DataFrame, slack: int, least: float) -> DataFrame:
    """Rows (row, label, base, at, share): verified spans, `share` being the part of the template's words they hold in order."""
    places = grams.select("template", "base", F.col("k").alias("_k"), F.size("words").alias("length"), F.posexplode("hashes").alias("q", "_hash"))
    seen = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h"))
    votes = seen.join(places, (F.col("h.k") == F.col("_k")) & (F.col("h.hash") == F.col("_hash")))
    votes = votes.groupBy("row", "template", "length", (F.col("h.at") - F.col("q")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("h.at").alias("start"), F.max(F.col("h.at") + F.col("_k")).alias("stop")
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    reach = F.when(F.col("length") < K, 0).otherwise(slack)
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > reach, F.lit(True))
    votes = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(by_diagonal))
    merged = votes.groupBy("row", "template", "length", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    # up to the ends of the template along the outer diagonals, so that words beyond the last hit count as well
    begin = F.greatest(F.least("start", "low"), F.lit(0))
    merged = merged.select("row", "template", begin.alias("begin"), F.greatest("stop", F.col("high") + F.col("length")).alias("end"))
    words = rows.select("row", "words")
    pieces = merged.join(words, "row").select(
        "row", "template", "begin", F.slice("words", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("words")
    )
    pieces = pieces.join(grams.select("template", "label", "base", F.col("words").alias("wanted")), "template")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [
                common_length(a.values.to_numpy(), b.values.to_numpy()) / len(a.values)
                for a, b in zip(batch.column("wanted"), batch.column("words"), strict=True)
            ]
            kept = [batch.column(c) for c in ("row", "label", "base", "begin")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(share, type=pa.float64())], ["row", "label", "base", "at", "share"])

    found = pieces.select("row", "label", "base", "begin", "words", "wanted").mapInArrow(
        run, "row bigint, label string, base boolean, at int, share double"
    )
    return found.where(F.when(F.col("base"), F.col("share") == 1.0).otherwise(F.col("share") >= least))


def scanned(docs: DataFrame, found: DataFrame | None = None, slack: int = 4, least: float = 0.7) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one per row of `docs`.

    `found` holds templates (template, label, base, text). n_base counts the places of base templates, first_word and last_word
    are the least and greatest of them (null without one). labels: those of base templates and of spans that hold at least
    `least` of a template's words in order; both lists are distinct, sorted and joined by commas, empty without a label. score:
    the largest share of a template's words found, 0 without a span.

    Null and empty texts have no words and no labels; null doc_ids are kept; repeated rows are scanned each. Other columns
    aren't looked at. An empty table, or templates without words, give no spans.
    """
    grams = template_grams(templates(docs.sparkSession) if found is None else found)
    rows = hits(docs, grams)
    met = spans(rows, grams, slack, least)
    base = F.when(F.col("base"), F.col("at"))
    summed = met.groupBy(F.col("row").alias("_row")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    joined = rows.select("row", "doc_id", "n_words").join(summed, F.col("row") == F.col("_row"), "left")
    label = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("bigint"),
        F.col("last_word").cast("bigint"), label("base_labels"), label("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
