import math
import random
import re
import zlib
from collections import Counter, defaultdict

import fixtures
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from retrace.llm import boosted_trees, license_scan, ppm, substring_dedup
from retrace.llm.textbytes import Texts

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def log_probability(counts, context, symbol):
    """Method C with exclusion, straight from the definition."""
    excluded, out = set(), 0.0
    for k in range(len(context), -1, -1):
        seen = counts.get(context[len(context) - k :])
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        total = sum(left.values()) + len(left)
        if symbol in left:
            return out + math.log10(left[symbol] / total)
        if left:
            out += math.log10(len(left) / total)
        excluded |= set(seen)
    return out - math.log10(256 - len(excluded))


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 4000)
    order, rows = 4, [r for r in fixtures.odd_rows() if r[0] != 10]
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(3)
    train = F.col("doc_id") % 3 != 0
    bodies = [" ".join(PLAIN.findall(fixtures.lowered(r[1]))).encode() for r in rows]
    learns = [r[0] is None or r[0] % 3 != 0 for r in rows]
    tokens, counts = Counter(), defaultdict(Counter)
    for body, learn in zip(bodies, learns, strict=True):
        if learn:
            tokens.update([*body.split(), None])
            text = b"\n" * order + body + b"\n"
            for i in range(order, len(text)):
                for k in range(order + 1):
                    counts[text[i - k : i]][text[i]] += 1
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for row, body, learn in zip(rows, bodies, learns, strict=True):
        words, text = [*body.split(), None], b"\n" * order + body + b"\n"
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words)
        score = sum(log_probability(counts, text[i - order : i], text[i]) for i in range(order, len(text)))
        want.append((row[0] or -1, learn, len(words), sum(tokens[w] > 0 for w in words), n, base, score))
    found = sorted((r.doc_id or -1, r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.scored(docs, train, order).collect())
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    assert ppm.scored(fixtures.no_documents(spark)).collect() == []


def test_probabilities_sum_to_one():
    draw = random.Random(4)
    text = bytes(draw.choice(b"abcd") for _ in range(300))
    counts = Counter(text[i - 3 : i + 1] for i in range(3, len(text)))
    lowest = np.zeros((256, 256))
    for gram, n in counts.items():
        lowest[gram[2], gram[3]] += n
    same = {g: n for g, n in counts.items() if g[1:3] == b"ab"}
    for context in {g[:3] for g in same} | {b"zab"}:
        grams = {bytes([*context, s]): same.get(bytes([*context, s]), 0) for s in range(256)} | same
        keys = np.array([int.from_bytes(g[::-1], "little") for g in grams], dtype=np.uint64)
        found = ppm.subtrie(keys, np.array(list(grams.values()), dtype=float), 3, lowest)
        own = [p for g, p in zip(grams, found, strict=True) if g[:3] == context]
        assert len(own) == 256 and math.isclose(sum(10**p for p in own), 1, rel_tol=1e-9)


def chunk_starts(data, bits=6, least=20, most=512):
    """The chunk rule byte by byte."""
    ends, last = set(), None
    on = lambda i: next((j for j in range(i, len(data)) if data[j] & 0xC0 != 0x80), None)
    for i in range(15, len(data)):
        rolled = sum(int(substring_dedup.GEAR[data[i - j]]) << j for j in range(16)) & 0xFFFF
        if rolled >> (16 - bits) == 0:
            if last is None or i - last > least:
                ends.add(on(i + 1))
            last = i
    starts = sorted({0} | {e for e in ends if e is not None})
    out = set(starts)
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        out |= {on(k) for k in range(a + most, b, most)} - {None}
    return sorted(out)


def test_chunks_follow_the_rule_and_resist_shifts():
    texts = [r[1] for r in fixtures.odd_rows() if r[0] != 10] + ["ü" * 2000]
    block = Texts(pa.array(texts, type=pa.string()))
    found = substring_dedup.chunk_starts(block, 6, 20, 512)
    for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True):
        assert [int(x - a) for x in found[(found >= a) & (found < b)]] == chunk_starts(block.data[a:b].tolist())
    text = fixtures.prose(60, 3000)
    shifted = text[:50] + "inserted words " + text[50:]
    cut = lambda t: {t.encode()[a:b] for s in [chunk_starts(t.encode())] for a, b in zip(s, [*s[1:], None], strict=True)}
    assert len(cut(text) - cut(shifted)) <= 3


def test_repeats_are_found_and_cut(spark):
    passage = fixtures.prose(70, 60)
    rows = [(i, f"{fixtures.prose(600 + i, 50)} {passage} {fixtures.prose(700 + i, 50)}" if i % 2 else fixtures.prose(800 + i, 150)) for i in range(20)]
    rows += [(30, None), (31, ""), (None, fixtures.prose(71, 50)), (2, fixtures.prose(72, 200)), (32, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeats(docs).collect()
    assert {r.doc_id for r in found} == {*range(3, 20, 2), 32}
    assert all(r.first_doc_id == (4 if r.doc_id == 32 else 1) for r in found)
    texts = dict(rows)
    for r in found:
        part = texts[r.doc_id].encode()[r.start : r.start + r["size"]]
        assert part in texts[r.first_doc_id].encode() and len(part) >= 100
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect() if r.doc_id not in (2, None)}
    for r in found:
        assert len(cut[r.doc_id].encode()) == len(texts[r.doc_id].encode()) - sum(x["size"] for x in found if x.doc_id == r.doc_id)
    assert all(cut[i] == texts[i] for i in (0, 1, 4, 30, 31))
    odd = fixtures.odd_documents(spark)
    assert substring_dedup.without_repeats(odd).columns == odd.columns and substring_dedup.without_repeats(odd).count() == odd.count()
    assert substring_dedup.repeats(fixtures.no_documents(spark)).collect() == []


def test_license_phrases_and_notices(spark):
    notice = license_scan.NOTICES[0][1]
    words = notice.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 25 != 7)  # words missing here and there
    rows = [(100, f"{fixtures.prose(1, 30)} {changed} {fixtures.prose(2, 30)}"), (101, " ".join(words[: len(words) // 3])), (102, "mit license MIT-License apache LICENSE")]
    rows += [(r[0], r[1]) for r in fixtures.odd_rows()]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    want = Counter()
    for d, t in rows:
        w = ALNUM.findall(fixtures.lowered(t))
        places = [(i, label) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want[(d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    by_id = {r.doc_id: r for r in found}
    assert by_id[100].labels == "mit" and by_id[100].base_labels == "" and 0.7 <= by_id[100].score < 1
    assert by_id[101].labels == "" and by_id[102].n_base == 3 and by_id[102].labels == "apache,mit"
    assert license_scan.scanned(fixtures.no_documents(spark)).collect() == []


def test_common_subsequence_length():
    draw = random.Random(6)
    for _ in range(50):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert license_scan.common_length(np.array(a), np.array(b)) == table[-1][-1]


def test_trees_follow_their_arrays_and_learn():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = boosted_trees.fit(x[:2000], y[:2000], trees=20, depth=3)
    for row in x[:50]:
        margin = model.start
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        assert math.isclose(margin, model.margins(row[None])[0], rel_tol=1e-9, abs_tol=1e-9)
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert boosted_trees.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_is_learnt_from_texts(spark):
    rows = [(i, fixtures.prose(i, 80) if i % 3 else "| ".join(fixtures.prose(i, 80).split(" "))) for i in range(400)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, None, None), (None, 1, 0), (2, 1, 0)]
    docs = spark.createDataFrame(rows + [(None, None), (7, None), (8, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    found = boosted_trees.scored(docs, known, train).collect()
    assert len(found) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id not in (7, 8) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    odd = boosted_trees.scored(fixtures.odd_documents(spark), known.where("false"), train).collect()
    assert len(odd) == len(fixtures.odd_rows()) and {r.score for r in odd} == {0.5}
    assert boosted_trees.scored(fixtures.no_documents(spark), known, train).collect() == []
