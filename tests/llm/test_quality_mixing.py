import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import fixtures
from pyspark.sql import functions as F

from retrace.llm import mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_and_verdict(spark):
    docs = fixtures.odd_documents(spark)
    found = quality_rules.judged(docs).collect()
    got = sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found)
    want = []
    for row in fixtures.odd_rows():
        s = statistics(row[1])
        want.append(repr((row[0], *s, s[0] < 50 or 2 * s[4] > s[0])))
    assert got == sorted(want)
    assert all(not r.kept for r in found if r.base_failed)
    assert quality_rules.judged(fixtures.no_documents(spark)).collect() == []


def test_frequent_lines_go_and_copies_count_once(spark):
    banner, rows = "Click here to\tread  MORE", []
    for i in range(40):  # a banner in different documents
        rows.append((i, f"{fixtures.prose(100 + i, 80)}\n{banner.lower() if i % 2 else banner}\nlast {i}", "h"))
    copy = fixtures.prose(999, 90) + "\na line of the copied text only"
    rows += [(100 + i, copy, "h") for i in range(60)]
    rows += [(200, "\n".join([banner] * 30) + "\nfive other words stand here", "h"), (201, fixtures.prose(7, 70) + f"\n{banner}", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = {"min_docs": 20, "share": 0.1}
    found = {r.doc_id: r for r in quality_rules.judged(docs, **limits).collect()}
    assert all(found[i].removed_words == 5 and found[i].kept for i in range(40))
    assert all(found[i].removed_words == 0 and found[i].kept for i in range(100, 160))
    assert not found[200].kept and found[201].removed_words == 0
    texts = {r.doc_id: r.text for r in quality_rules.cleaned(docs, **limits).collect()}
    assert set(texts) == set(range(40)) | set(range(100, 160)) | {201}
    assert texts[3] == rows[3][1].replace("\n" + banner.lower(), "") and texts[101] == copy


def test_documents_that_share_most_of_their_text_count_each(spark):
    draw, block = random.Random(4), [fixtures.prose(300 + i, 12).replace("\n", " ") for i in range(15)]
    rows = [(i, "\n".join([*block, " ".join(f"u{draw.randrange(10**6)}" for _ in range(30))]), "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.removed_words, r.kept) for r in quality_rules.judged(docs).collect()} == {(180, False)}
    assert all(r.removed_words == 0 and r.kept for r in quality_rules.judged(docs.where("doc_id < 50")).collect())


def test_verdict_of_a_line_does_not_weaken_with_its_host(spark):
    rows = [(i, fixtures.prose(1000 + i, 12).replace("\n", " ") + ("\nread more here" if i < 60 else ""), "h") for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for part in (docs.where("doc_id < 100"), docs):
        found = {r.doc_id: r.removed_words for r in quality_rules.judged(part).collect()}
        assert {found[i] for i in range(60)} == {3} and {found[i] for i in found if i >= 60} == {0}


def test_cleaned_keeps_columns_and_repeated_rows(spark):
    docs = fixtures.odd_documents(spark)
    out = quality_rules.cleaned(docs)
    assert out.columns == docs.columns
    kept = Counter(repr((r.doc_id, r.text)) for r in out.collect())
    judged = [statistics(r[1]) for r in fixtures.odd_rows()]
    want = Counter(repr((r[0], r[1])) for r, s in zip(fixtures.odd_rows(), judged, strict=True) if s[0] >= 50 and 2 * s[4] <= s[0])
    assert kept == want


def earliest_deadline_first(quota):
    """Slot of every block of a cycle by the definition, one slot after the other."""
    names, slots = sorted(quota), sum(quota.values())
    done, plan = dict.fromkeys(names, 0), {}
    for slot in range(slots):
        free = []
        for i, s in enumerate(names):
            w = Fraction(quota[s], slots)
            if done[s] < quota[s] and Fraction(done[s]) // w <= slot:
                free.append((-(-Fraction(done[s] + 1) // w), i, s))
        _, _, s = min(free)
        plan[s, done[s]] = slot
        done[s] += 1
    return plan, slots


def test_slots_follow_release_and_deadline(spark):
    rows = [(i, "a" if i % 3 else f"s{i % 7}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("a", 5.0), ("s0", 2.5), ("s1", 1.0), ("s1", 1.0)], "source string, weight double")
    found = mixing.placed(docs, weights, block=10, cycle=60).collect()
    assert len(found) == 2000
    sizes = Counter(s for _, s in rows)
    given = {"a": 5.0, "s0": 2.5, "s1": 1.0}
    total = sum(given.values())
    quota = {s: max(int(given.get(s, 0) / total * 60 + 0.5), 1) for s in sizes}
    plan, slots = earliest_deadline_first(quota)
    order = defaultdict(list)
    for d, s in sorted(rows):
        order[s].append(d)
    for r in found:
        n = order[r.source].index(r.doc_id)
        k = n // 10
        assert (r.n, r.block) == (n, k)
        assert r.slot == k // quota[r.source] * slots + plan[r.source, k % quota[r.source]]
        assert r.release <= r.slot < r.deadline
    # less than a block from the target share while no source has run out
    placed = defaultdict(set)
    for r in found:
        placed[r.source].add(r.slot)
    first_end = min(max(p) for p in placed.values())
    for slot in range(first_end):
        for s, p in placed.items():
            assert abs(sum(x <= slot for x in p) - Fraction(quota[s], slots) * (slot + 1)) < 1


def test_mixture_keeps_all_rows_in_order(spark):
    docs = fixtures.odd_documents(spark)
    out = mixing.interleaved(docs, block=2, cycle=10)
    assert out.columns == docs.columns
    assert Counter(map(repr, out.collect())) == Counter(map(repr, docs.collect()))
    assert mixing.interleaved(fixtures.no_documents(spark)).collect() == []
    assert mixing.placed(fixtures.no_documents(spark)).collect() == []
    big = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit("t").alias("text"))
    slots = {r.doc_id: (r.slot, r.n) for r in mixing.placed(big, block=5).collect()}
    got = [slots[r.doc_id] for r in mixing.interleaved(big, block=5).collect()]
    assert got == sorted(got)
