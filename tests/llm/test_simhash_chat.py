import random
from collections import Counter

import fixtures
import numpy as np
import pandas as pd
import pytest
import xxhash

from retrace.llm import chat_pairs, simhash
from retrace.llm.components import components
from retrace.llm.xxh import xxh64


def test_xxh64_is_the_published_hash():
    draw = random.Random(3)
    parts = [bytes(draw.randrange(256) for _ in range(n)) for n in [*range(0, 100), 1000, 4097]]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    found = xxh64(data, np.cumsum(lengths) - lengths, lengths)
    assert [int(x) for x in found] == [xxhash.xxh64_intdigest(p, seed=42) for p in parts]


def fingerprint(text):
    words = fixtures.lowered(text).split(" ") if text else []
    words = [w for part in words for w in part.replace("\t", "\n").split("\n") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """Smallest id reached, per row, over fingerprints within the radius."""
    prints = [f for _, f in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[top(i)] = top(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc)
    return [min((d for d in groups[top(i)] if d is not None), default=None) for i in range(len(rows))]


def test_groups_of_odd_documents(spark):
    rows = [(r[0], fingerprint(r[1])) for r in fixtures.odd_rows()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows), strict=True))
    found = simhash.near_groups(fixtures.odd_documents(spark)).select("doc_id", simhash.digits("fp0").alias("f"), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want
    assert simhash.near_groups(fixtures.no_documents(spark)).collect() == []


def test_links_lose_nothing_in_crowds(spark, monkeypatch):
    draw = random.Random(5)
    points = {draw.getrandbits(64) for _ in range(300)}
    for center in [draw.getrandbits(64) for _ in range(3)]:  # crowds around one point, past the size of small groups
        points |= {center ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5))) for _ in range(150)}
    points |= {1 << 63, (1 << 63) | 1, 0, (1 << 64) - 1}
    points = sorted(points)
    monkeypatch.setattr(simhash, "BLOCK", 40)  # several blocks in a cell
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    table = spark.createDataFrame([(s, s) for s in signed], "node long, fp0 long")
    roots = {r.node: r.root for r in components(simhash.links(table)).collect()}
    found = {}
    for s in signed:
        found.setdefault(roots.get(s, s), set()).add(s)
    want = brute_components([(i, p) for i, p in enumerate(points)])
    groups = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(s)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_cells_and_documents_are_never_broadcast(spark):
    points = spark.range(5000).selectExpr("xxhash64(id) AS node", "xxhash64(id) AS fp0")
    for found in (simhash.links(points), simhash.near_groups(fixtures.odd_documents(spark))):
        plan = found._jdf.queryExecution()
        assert "BroadcastExchange" not in plan.executedPlan().toString()
        found.collect()
        assert "BroadcastExchange" not in plan.executedPlan().toString()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (5, 5), (1002, 1000)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(spark):
    base = fixtures.prose(50, 300).replace("\n", " ").split(" ")
    rows = [(i, fixtures.prose(500 + i, 200), "s") for i in range(30)]
    for i in range(12):
        words = list(base)
        words[20 * i + 3] = f"changed{i}"
        rows.append((100 + i, " ".join(words), "s"))
    rows += [(90, rows[3][1], "s"), (3, rows[3][1], "s"), (None, rows[5][1], "s"), (None, fixtures.prose(77, 150), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _retrace string")
    kept = Counter(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == Counter([*range(30), 3, 100, None])
    odd = fixtures.odd_documents(spark)
    assert simhash.deduplicated(odd).columns == odd.columns
    assert simhash.deduplicated(fixtures.no_documents(spark)).collect() == []


def brute_similar(texts, similarity=0.8, words=5):
    """Number of the first text reached, per text, over Jaccard similarities of sets of word shingles."""
    sets = []
    for text in texts:
        found = fixtures.lowered(text).split()
        sets.append({" ".join(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else {None})
    first = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 1 - len(x ^ sets[j]) / len(x | sets[j]) >= similarity - 1e-9 and first[i] != first[j]:
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    return first


def test_pairs_around_the_similarity_are_found_and_no_others(spark, monkeypatch):
    draw, texts = random.Random(11), []
    for i in range(240):  # pairs of two, similar by 0.6 to 1, of all lengths
        n = draw.choice([3, 6, 12, 40, 90, 200, 500, 1200])
        words = [f"w{draw.randrange(5000)}" for _ in range(n)]
        other, tail = list(words), int(n * draw.uniform(0, 0.3))
        if i % 3:
            other = other[: n - tail] + [f"v{draw.randrange(5000)}" for _ in range(draw.choice([0, tail]))]
        else:
            for at in draw.sample(range(n), tail // 10):
                other[at] = f"x{at}"
        texts += [" ".join(words), " ".join(other)]
    base = [f"b{j}" for j in range(150)]
    texts += [" ".join([*base[:k], *[f"c{k}.{j}" for j in range(150 - k)]]) for k in range(60, 150)]  # a templated crowd
    texts += ["spam " * 50, "spam " * 51, "", " \n", "spam spam"]
    want = brute_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for least in (simhash.LEAST, None):
        found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, least=least).collect()}
        assert [found[i] for i in range(len(texts))] == want
        monkeypatch.setattr(simhash, "BLOCK", 20)  # several blocks in cells and groups
        monkeypatch.setattr(simhash, "ROOM", 2000)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(want)


def test_fingerprint_grids_propose_and_least_hashes_look_up_the_rest(spark, monkeypatch):
    draw, texts = random.Random(17), []
    for i in range(120):  # pairs of two, similar by about 0.8 to 0.98
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in range(1 + i % 6):
            other[at * 50 + 20] = f"x{i}.{at}"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = simhash.shingle_sets(docs, 5, 0.8).localCheckpoint()
    points = rows.select("node", *simhash._SKETCH).distinct()
    place = {r.node: r.doc_id for r in rows.collect()}
    edges = {tuple(sorted((place[r.a], place[r.b]))) for r in simhash.grid_candidates(points, 0.8).collect()}
    prints, want = {r.node: (r.fp0, r.fp1) for r in points.collect()}, set()
    for a in prints:
        for b in prints:
            lanes = zip(prints[a], prints[b], strict=True)
            if place[b] == place[a] + 1 and place[a] % 2 == 0 and any(len(equal_groups(x, y)) >= 4 for x, y in lanes):
                want.add((place[a], place[b]))
    assert edges == want and 40 < len(edges) < 120
    joined = simhash.grid_candidates(points, 0.8).toDF("node", "root")
    found = {tuple(sorted((place[r.a], place[r.b]))) for r in simhash.rest_candidates(rows, points, joined, 0.8).collect()}
    assert not found & edges
    assert found | edges >= {(i, i + 1) for i in range(0, 240, 2) if brute_similar(texts[i : i + 2]) == [0, 0]}
    monkeypatch.setattr(simhash, "rest_candidates", lambda *_: spark.createDataFrame([], "a long, b long"))
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert {i for i, c in groups.items() if i != c} <= {b for _, b in edges}


def test_chance_meetings_in_grids_do_not_grow_with_the_square(spark):
    assert [simhash.fineness(n) for n in (0, 240, 40_000, 200_000, 10**7, 10**12)] == [4, 4, 5, 5, 6, 8]
    met = {}
    for n in (8_000, 40_000):  # random fingerprints, no near ones
        draw = np.random.default_rng(n)
        prints = [simhash.signed(draw.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(8)]
        columns = dict(zip(simhash._SKETCH, [np.full(n, 300), *prints], strict=True)) | {"node": np.arange(n)}
        points = spark.createDataFrame(pd.DataFrame(columns)[["node", *simhash._SKETCH]]).localCheckpoint()
        seen = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(simhash, "_fitting", lambda member, *_: seen.append(member.count()))
            simhash.grid_candidates(points, 0.8)
        met[n] = seen[0]
    assert met[40_000] <= 2 * simhash.CHANCE * 40_000 and met[8_000] <= 2 * simhash.CHANCE * 8_000


def equal_groups(x, y):
    """Groups of coordinates, of eight, in which two fingerprints have equal bit counts of their 2-bit segments."""
    differs = {s % 8 for s in range(32) if bin(x >> 2 * s & 3).count("1") != bin(y >> 2 * s & 3).count("1")}
    return set(range(8)) - differs


def test_preference_pairs(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "other"),
        (3, 0, "user", "hi"), (4, 0, None, None), (4, 1, "assistant", ""), (None, 0, "user", "lost"),
        (5, 0, "user", "hi"), (6, None, "user", "hi"), (6, 0, "user", "hi"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = [(10, 1, 2), (11, 1, 3), (12, 3, 5), (13, 2, 4), (14, 1, 99), (15, 6, 3), (10, 1, 2)]
    found = chat_pairs.preference_pairs(table, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long"))
    got = {r.pair_id: r for r in found.collect()}
    assert Counter(r.pair_id for r in found.collect()) == Counter([10, 10, 11, 12, 13, 15])
    one = got[10]
    assert one.n_prompt_turns == 2 and one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert one.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n" and one.rejected == "<|user|>\nother<|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["yes<|end|>\n"] and one.rejected_mask == []
    assert got[11].rejected == "" and got[12].chosen == "" == got[12].rejected and got[12].n_prompt_turns == 1
    assert got[13].prompt == "" and [tuple(s) for s in got[13].rejected_mask] == [(len("<||>\n<|end|>\n<|assistant|>\n"), len(got[13].rejected))]
    assert got[15].n_prompt_turns == 1 and got[15].chosen == "<|user|>\nhi<|end|>\n"
    empty = spark.createDataFrame([], table.schema)
    assert chat_pairs.preference_pairs(empty, chat_pairs.neighbour_pairs(empty)).collect() == []
