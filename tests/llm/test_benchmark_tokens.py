import random
import re
import zlib
from collections import Counter

import fixtures
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retrace.llm import decontaminate, token_files
from retrace.llm.scratch import new_path

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tiled(item, doc, least):
    """Greedy string tiling by comparing every pair of places."""
    free, open_, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free[i + n] and open_[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        free[i : i + n], open_[j : j + n] = [False] * n, [False] * n


def test_tiles_are_the_greedy_ones():
    draw = random.Random(2)
    for _ in range(60):
        item = [draw.randrange(1, 5) for _ in range(draw.randrange(0, 25))]
        doc = [draw.randrange(1, 5) for _ in range(draw.randrange(0, 40))]
        doc[10:20] = item[3:13]
        found = decontaminate.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
        assert found == tiled(item, doc, 3)


def test_contaminated_against_brute_force(spark):
    items = [(i, fixtures.prose(300 + i, 30)) for i in range(6)] + [(7, None), (8, ""), (9, "too short"), (0, fixtures.prose(300, 30))]
    words = {i: WORD.findall(fixtures.lowered(t)) for i, t in items}
    rows = []
    for i in range(6):
        w = words[i]
        rows.append((10 + i, " ".join([fixtures.prose(i, 40), *w[15:], "between", *w[:15], fixtures.prose(i + 9, 20)])))  # reordered
        rows.append((20 + i, " ".join([fixtures.prose(i, 40), *w[: 10 + i], fixtures.prose(i + 9, 20)])))  # parts
        rows.append((30 + i, fixtures.prose(900 + i, 100)))
    rows += [(40, None), (41, ""), (10, rows[0][1]), (None, rows[0][1]), (42, items[0][1].upper() + " " + fixtures.prose(1, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for d, t in rows:
        doc = WORD.findall(fixtures.lowered(t))[:400]
        for i, w in words.items():
            matched = tiled(w, doc, 5) if len(w) >= 5 and doc else []
            n = sum(x for _, _, x in matched)
            if w and n >= 0.5 * len(w):
                want[(d, i, len(w), n, len(matched))] += 1
    found = decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "item_words", "matched_words", "n_tiles")
    assert Counter(map(tuple, found.collect())) == want and want
    gone = {d for d, *_ in want}
    left = decontaminate.decontaminated(docs, bench)
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in rows if d not in gone)
    odd = fixtures.odd_documents(spark)
    assert decontaminate.decontaminated(odd, bench.where("false")).count() == odd.count()
    assert decontaminate.contaminated(fixtures.no_documents(spark), bench).collect() == []


def test_encoder_equals_the_library():
    draw = random.Random(1)
    signs = [*"aZé×÷'ß 1.,<|>-\n\t́Ωσ\x1c…日", "st", "'s", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(25))) for _ in range(4000)]
    texts += [r[1] for r in fixtures.odd_rows()]
    encoder = token_files.Encoder(PATH)
    ids, counts = encoder.encode(pa.array(texts, type=pa.string()))
    whole = encoder.whole([t or "" for t in texts])
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(x) for x in whole]


def test_files_round_trip(spark):
    docs, encoder = fixtures.odd_documents(spark), token_files.Encoder(PATH)
    path = new_path(spark, "token-test")
    token_files.write(docs, path, PATH)
    rows = token_files.read(spark, path).orderBy("start").collect()
    texts = Counter((r[0], tuple(encoder.whole([r[1] or ""])[0].tolist() + [1])) for r in fixtures.odd_rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == texts
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    starts = np.cumsum([0] + [r.n_tokens for r in rows])[:-1]
    assert [r.start for r in rows] == starts.tolist() and all(r.n_tokens == len(r.ids) for r in rows)
    sums = {(r.start, r.ids_crc32) for r in token_files.checksums(token_files.read(spark, path)).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in rows}
    empty = new_path(spark, "token-test")
    token_files.write(fixtures.no_documents(spark), empty, PATH)
    assert token_files.checksums(token_files.read(spark, empty)).collect() == []


def test_files_have_the_promised_layout(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("more words "), 20)).alias("text"))
    path = new_path(spark, "token-test")
    token_files.write(docs.coalesce(1), path, PATH, page_rows=500)
    part = next(f for f in spark.read.parquet(f"{path}/tokens").inputFiles()).replace("file://", "")
    group = pq.ParquetFile(part).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["offset"].encodings
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    plan = token_files.read(spark, path).where("doc_id = 77").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,77)" in plan and "ids" not in plan.split("Physical Plan")[1]
