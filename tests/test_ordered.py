import random

import pytest
from pyspark.sql import functions as F

from helpers import FORCED
from retrace.operators import folds
from retrace.operators.folds import NearDuplicate, gram_set
from retrace.operators.ordered import Ordered


@pytest.fixture(scope="module")
def events(spark):
    random.seed(5)
    rows, t = [], 0
    for i in range(3000):
        t += random.choice([1, 1, 2, 5, 40])
        rows.append((0 if random.random() < 0.5 else i % 7, t, i, random.choice("aab"), random.random()))
    df = spark.createDataFrame(rows, "k int, s long, id long, v string, x double")
    return df.withColumn("ts", F.timestamp_seconds("s")).withColumn("day", F.lit("2024-01-01")).withColumn("base", F.lpad(F.col("s").cast("string"), 8, "0"))


def results(o):
    o = o.lag(p="v", pid="id").lead(n="v").running_sum(c=F.col("id")).row_number("rn")
    return o.last_known(known=F.when(F.col("x") > 0.9, F.col("x"))).islands("isl", F.col("v")).gaps("ses", "ts", 30).done()


@pytest.mark.parametrize("keys", [["k"], []])
def test_slices_equal_plain_windows(events, keys):
    plain = Ordered.of(events, keys, ["ts", "id"], by="ts")
    cut = Ordered.of(events, keys, ["ts", "id"], by="ts", **FORCED)
    assert not plain.sliced and cut.sliced
    a, b = results(plain), results(cut)
    assert a.count() == 3000
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (1, 300), (1, 601)], "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.s: r.g for r in Ordered.of(df, ["k"], ["ts"]).gaps("g", "ts", 300).done().collect()}
    assert got == {0: 1, 300: 1, 601: 2}


def test_thin_equals_loop_in_slices(events):
    few = events.where("id < 400")
    want, last = set(), {}
    for r in few.orderBy("ts", "id").collect():
        if r.k not in last or r.s - last[r.k] >= 25:
            want.add(r.id)
            last[r.k] = r.s
    for layout in ({}, {"slice_rows": 25}):
        got = folds.thin(few, 25, ["k"], ["id"], **layout).where("kept")
        assert {r.id for r in got.collect()} == want


def naive_collapse(texts, thr):
    out, ref = [], None
    for i, text in enumerate(texts):
        g = gram_set(text)
        near = False
        if ref is not None:
            r = gram_set(texts[ref])
            near = (1.0 if not g and not r else 0.0 if not g or not r else len(g & r) / len(g | r)) >= thr
        if not near:
            ref = i
        out.append((i, not near, ref))
    return out


@pytest.mark.parametrize("layout", [{}, {"slice_rows": 15}])
def test_near_duplicates_equal_loop(spark, layout):
    random.seed(3)
    text, texts = "the quick brown fox jumps", []
    for _ in range(150):
        if random.random() < 0.6:
            text += random.choice([" a", "b", " over", "z"])
        elif random.random() < 0.1:
            text = random.choice(["", "x", "lazy dogs sleep all day long"])
        texts.append(text)
    rows = [("d", "2024-01-01", f"{i:09d}", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "device string, day string, base string, s long, text string").withColumn("ts", F.timestamp_seconds("s"))
    got = folds.near_duplicates(df, [0.9, 0.5], **layout)
    for thr in (0.9, 0.5):
        mine = sorted((int(r.base), r.kept, int(r.ref_base)) for r in got.where(F.col("thr") == thr).collect())
        assert mine == naive_collapse(texts, thr)


def test_growing_text_is_kept_eventually():
    fold = NearDuplicate([0.9], 1.0)
    kept = [fold.step(i, str(i), "abcdefghijklmnopqrstuvwxyz0123456789"[: 20 + i])[0][0] for i in range(10)]
    assert kept[0] and sum(kept) > 1 and not kept[1]


def test_thinning_a_hot_key_takes_two_passes(spark, monkeypatch):
    """Regular ticks never fall into step again; each row is still read twice and written once."""
    written = []
    plain = folds.materialise
    monkeypatch.setattr(folds, "materialise", lambda df: written.append(plain(df)) or written[-1])
    rows = spark.range(600).select(F.lit("d").alias("device"), F.timestamp_seconds(F.col("id") * 5).alias("ts"), "id")
    want = {r.id for r in folds.thin(rows, 12, ["device"], ["id"]).where("kept").collect()}
    assert want == {i for i in range(0, 600, 3)} and not written
    got = folds.thin(rows, 12, ["device"], ["id"], slice_rows=25)
    assert {r.id for r in got.where("kept").collect()} == want and got.count() == 600
    # one small table: an entry per row of a slice's first twelve seconds
    assert len(written) == 1 and 10 < written[0].count() <= 300 and written[0].selectExpr("max(size(entries))").first()[0] <= 4
