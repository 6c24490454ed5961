"""Source divergence, importance resampling and the permutation index against brute force, odd inputs included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import lowered, no_documents, odd_documents, odd_rows, prose
from retrace.llm import divergence, importance, permutation_index

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audited(rows, least, top):
    """The audit over (text, lang, source), cell by cell."""
    rows = [[x or "" for x in r] for r in rows]
    found = [Counter(LETTERS.findall(lowered(r[0]))) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(r[2], c) for r, c in zip(rows, found) if r[1] == lang]
        docs = Counter(t for _, c in own for t in c)
        kept = [t for t, n in docs.items() if n >= least]
        total = lambda cs: sum((Counter({t: c[t] for t in kept if t in c}) for c in cs), Counter())
        counts = {s: total([c for x, c in own if x == s]) for s in {s for s, _ in own}}

        def share(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total([c for _, c in own]))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            for part, got in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(got, 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least,band,cells", [(1, 256, 1 << 16), (2, 2, 16), (3, 1, 1 << 16), (99, 256, 64)])
def test_audit_of_odd_documents(spark, least, band, cells):
    got = rows_of(divergence.audit(odd_documents(spark), least, 10, band, cells))
    assert got == audited([(r[1], r[2], r[3]) for r in odd_rows()], least, 10)


def test_audit_over_bands_and_tiles(spark):
    draw = random.Random(3)
    names = [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = [(" ".join(draw.choices(names[: 20 + 8 * s], k=30)), draw.choice(["x", "y"]), f"s{s}") for s in range(11) for _ in range(4)]
    rows += [(None, "x", "blank"), ("123 456", "z", "digits"), ("Été ÉTÉ été", "z", "é")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for band, cells in ((4, 32), (3, 500)):
        assert rows_of(divergence.audit(docs, 2, 10, band, cells)) == audited(rows, 2, 10)


def test_quadtree_skips_only_what_is_empty():
    draw = np.random.default_rng(1)
    filled = draw.random((6, 40)) < 0.1
    row, column = np.nonzero(filled)
    tree = divergence.Quadtree(row, column, 6)
    seen = {}
    for a, b, x, y in divergence.joint_leaves(tree, np.arange(6), 8, False):
        for i, j, m, n in zip(a, b, x, y):
            at = {column[tree.cell[c]] for c in (m, n) if c >= 0}
            assert len(at) == 1
            seen.setdefault((i, j), []).append(((m >= 0), (n >= 0), at.pop()))
    for i, j in combinations(range(6), 2):
        want = [(filled[i, c], filled[j, c], c) for c in range(40) if filled[i, c] or filled[j, c]]
        assert sorted(seen.get((i, j), [])) == sorted(want)


def drawn(rows, target, percent, least=20):
    feats = lambda ws: [" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)]
    words = lambda t: WORD.findall(lowered(t))
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [[bucket(f) for f in feats(words(t))] for _, t in rows]
    s, t = Counter(b for bs in own for b in bs), Counter(bucket(f) for x in target for f in feats(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000.0) / ((s[b] + 1) * (big_t + 10000.0)))) for b in range(10_000)]
    out = []
    for (i, text), bs in zip(rows, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((i, len(words(text)), len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    places = {}
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        places.setdefault(r, []).append(k)
    return sorted([(*r, places[r].pop(0) if places.get(r) else None) for r in out], key=repr)


def test_draw_from_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    target = [rows[0][1], None, "", "x" * 300 + " an be " + "é" * 90]
    docs = odd_documents(spark).union(spark.createDataFrame([(20, "w" * 500 + " " + prose(11, 30), *[None] * 9)], odd_documents(spark).schema))
    rows += [(20, "w" * 500 + " " + prose(11, 30))]
    bench = spark.createDataFrame([(1, t, 5) for t in target], "item_id long, text string, score long")
    for percent in (0, 5, 50, 100):
        got = sorted([tuple(r) for r in importance.resampled(docs, bench, percent).collect()], key=repr)
        assert got == drawn(rows, target, percent)
    none = spark.createDataFrame([], bench.schema)
    assert sorted([tuple(r) for r in importance.resampled(docs, none, 50).collect()], key=repr) == drawn(rows, [], 50)
    assert importance.resampled(no_documents(spark), bench).collect() == []


@pytest.mark.parametrize("accuracy", [2, 20, 10_000])
def test_bracket_holds_the_cutoff(spark, accuracy):
    """Few and many ties; a coarse sketch has to be widened."""
    draw = random.Random(accuracy)
    values = [draw.randrange(40) if i % 3 else 7 for i in range(3000)]
    rows = [(i, -v, v, i % 5, i) for i, v in enumerate(values)]
    scores = spark.createDataFrame(rows, "doc_id long, falling long, score long, digest long, row long")
    order = sorted(range(3000), key=lambda i: (-values[i], i))
    for place in (1, 700, 1500, 3000):
        low, high, above = importance.bracket(scores, 3000, place, accuracy)
        assert above < place and (high is None or above == sum(v > high for v in values))
        assert (low is None) or sum(v >= low for v in values) >= place
        assert importance.last_drawn(scores, 3000, place, accuracy)["doc_id"] == order[place - 1]


def nearest(rows, queries, k):
    out = []
    for q, v in queries:
        found = sorted([(-(np.array(x, dtype=float) * np.array(v, dtype=float)).sum(), i) for i, x in rows if i != q])[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, score double, norm int, part string"


def test_index_leaves_out_unusable_vectors(spark):
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, -3.0]), (3, [1.0, 2.0, 0.5]), (4, [1.0, 2.0, 0.5]), (6, [-5.0, 0.0, 0.25]), (8, [1e-3, 0.0, 0.0])]
    bad = [(10, None), (12, []), (14, [0.0, 0.0, 0.0]), (16, [1.0, None, 2.0]), (18, [float("nan"), 1.0, 1.0]), (20, [1.0, float("inf"), 0.0]),
           (22, [1.0, 2.0]), (24, [1.0] * 4), (None, [9.0, 9.0, 9.0])]
    rows = [(i, v, 1.0, 2, "x") for i, v in good + bad + [good[0], good[1]]]
    table = spark.createDataFrame(rows, VECTORS)
    for k in (2, 20):
        found = permutation_index.neighbours(table, F.col("vec_id") % 2 == 0, k)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in found.collect()) == nearest(good, [g for g in good if g[0] % 2 == 0], k)
    assert permutation_index.neighbours(table.limit(0), F.col("vec_id") > 0).collect() == []
    assert permutation_index.neighbours(table.where("vec_id = 2"), F.col("vec_id") > 0).collect() == []
    assert permutation_index.neighbours(table, F.lit(None).cast("boolean")).collect() == []


def test_recall_with_copies_and_lengths(spark, monkeypatch):
    """Vectors of different lengths, a third of them near copies of one; several shards, query blocks and merged parts."""
    for name, value in (("SHARD", 1500), ("QUERY_BLOCK", 60), ("PARTS", 2)):
        monkeypatch.setattr(permutation_index, name, value)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(6000, 32)) * draw.uniform(0.5, 2, size=(6000, 1))
    x[::3] = x[0] + 0.05 * draw.normal(size=(2000, 32))
    x[300:330:3] = x[300]
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = permutation_index.neighbours(table, F.col("vec_id") % 20 == 0).toPandas()
    hits, wide = 0, x.astype(float)
    for q in range(0, 6000, 20):
        own = got[got["query_id"] == q].sort_values("rank")
        score = (wide * wide[q]).sum(axis=1)
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].tolist() == [score[i] for i in own["vec_id"]]
        assert list(zip(-own["score"], own["vec_id"])) == sorted(zip(-own["score"], own["vec_id"])) and q not in set(own["vec_id"])
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(6000), -score))[:20]) & set(own["vec_id"]))
    assert hits / (300 * 20) >= 0.9
