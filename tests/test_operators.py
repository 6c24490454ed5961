import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import FORCED, at, frames, tuples
from retrace.operators import activity, attribution, folds, intervals, layout, reports, retention, triggers


def stamped(spark, rows, ddl):
    """Rows whose first column is seconds of day 1 (2026-01-01)."""
    df = spark.createDataFrame([(float(r[0]), *r[1:]) for r in rows], "s double, " + ddl)
    ts = F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint") + F.unix_micros(F.lit(at("2026-01-01")).cast("timestamp")))
    return df.withColumn("ts", ts).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("base", F.date_format("ts", "HHmmss_SSS")).withColumn("device", F.lit("d"))


def test_as_of_within_and_across_days(spark):
    changes = stamped(spark, [(43200 + 1200, "b"), (43200, "a"), (43200 + 2400, "a2"), (82800, "late")], "pkg string")
    rows = stamped(spark, [(43199.999, 0), (43200, 1), (43500, 2), (44500, 3), (86399.999, 4), (86460, 5)], "id int")
    for layout_ in ({}, FORCED):
        carried = {r.id: r.pkg for r in attribution.as_of(rows, changes, "pkg", **layout_).collect()}
        daily = {r.id: r.pkg for r in attribution.as_of(rows, changes, "pkg", ["device", "day"], **layout_).collect()}
        assert carried == {0: None, 1: "a", 2: "a", 3: "b", 4: "late", 5: "late"}
        assert daily == {**carried, 5: None}


def test_usage_rows(spark):
    frames_ = spark.createDataFrame([("com.a", 100), ("com.b", 100), ("com.b", 100)], "pkg string, bytes bigint")
    log = spark.createDataFrame([("com.a", 1, "old"), ("com.a", 2, "Alpha"), ("com.b", 1, None)], "pkg string, s bigint, label string").withColumn("ts", F.timestamp_seconds("s"))
    excluded = spark.createDataFrame([("com.zero",), ("com.b",)], "pkg string")
    got = attribution.usage(frames_, log, excluded).orderBy(*attribution.usage_order()).collect()
    assert [(r.pkg, r["count"], r.bytes, r.display_name) for r in got] == [("com.b", 2, 200, "com.b"), ("com.a", 1, 100, "Alpha"), ("com.zero", 0, 0, "com.zero")]


def test_app_query(spark):
    rows = spark.createDataFrame([("com.android.chrome", "Chrome"), ("jp.naver.line", "LINE"), ("com.example.bank", None), (None, None)], "pkg string, label string")
    rows = rows.withColumn("display_name", F.coalesce("label", "pkg", F.lit("不明")))
    find = lambda q: {r.display_name for r in attribution.filter_apps(rows, q).collect()}
    assert find("hro") == {"Chrome"} and find("naver") == {"LINE"} and find("com.") == {"Chrome", "com.example.bank"} and find("  chrome  ") == {"Chrome"}
    assert len(find("")) == 4


def test_overlays(spark):
    names = ["com.android.systemui", "com.android.pixeldisplayservice", "ime.one", "ime.two", "launcher"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p for r in df.where(attribution.is_overlay(F.col("p"), ["ime.one"])).collect()} == set(names[:3])


def phone(spark, sizes, secured=None):
    rows = [("d", i, f"{i:03d}", n, True if secured is None else secured[i]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "device string, s bigint, base string, bytes bigint, secured boolean").withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("sizes, budget, deleted", [([100] * 3, 150, 2), ([100] * 11, 1000, 2), ([95] * 10, 1000, 0)])
def test_retention_watermark(spark, sizes, budget, deleted):
    out = retention.decide(phone(spark, sizes), at("1970-01-01"), budget, 14, 9)
    assert out.where("decision = 'delete'").count() == deleted


def test_retention_equals_loop(spark):
    random.seed(9)
    for case in range(3):
        n = 60
        sizes = [random.randint(1, 200) for _ in range(n)]
        secured = [random.random() < 0.7 for _ in range(n)]
        budget, cutoff = random.randint(500, 5000), random.randint(0, n)
        now = dt.datetime(1970, 1, 1) + dt.timedelta(days=14, seconds=cutoff)
        total = sum(sizes)
        limit = budget // 10 * 9 if total > budget else budget
        want = []
        for i in range(n):
            if not (i < cutoff or total > limit):
                want.append("keep")
            elif secured[i]:
                want.append("delete")
                total -= sizes[i]
            else:
                want.append("blocked")
        stop = want.index("keep") if "keep" in want else n
        want = want[:stop] + ["keep"] * (n - stop)
        for layout_ in ({}, FORCED) if case == 0 else ({},):
            rows = retention.decide(phone(spark, sizes, secured), now, budget, 14, 9, **layout_).orderBy("base").collect()
            assert [r.decision for r in rows] == want


def test_gap_intervals_and_log(spark):
    pts = stamped(spark, [(1, "unlocked"), (2, "sleep"), (3, "locked"), (4, "sleep"), (5, "wake"), (6, "app_stop"), (9, "unlocked")], "state string")
    spans = tuples(intervals.gap_intervals(pts).select("gap", F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("b")), "gap", "a", "b")
    base = int(at("2026-01-01").replace(tzinfo=dt.timezone.utc).timestamp())
    assert spans == [("locked", base + 3, base + 9), ("sleep", base + 2, base + 5)]
    log = intervals.gap_log(pts).orderBy("ts").collect()
    assert [r.state for r in log] == ["sleep", "locked", "wake", "app_stop", "unlocked"]


def test_blackout_log(spark):
    rows = stamped(spark, [(1, False), (2, True), (3, True), (86401, True), (86402, False), (86403, False)], "dark boolean")
    got = intervals.blackout_log(rows, "dark").orderBy("ts").collect()
    assert [(r.day, r.state) for r in got] == [("2026-01-01", "start"), ("2026-01-02", "start"), ("2026-01-02", "end")]


def test_overlap(spark):
    apps = stamped(spark, [(0, "a"), (100, "b")], "pkg string")
    dark = stamped(spark, [(50, "start"), (130, "end")], "state string")
    assert tuples(attribution.overlap_seconds(apps, "pkg", dark), "pkg", "seconds") == [("a", 50.0), ("b", 30.0)]


def test_percentile_rule(spark):
    df = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "v double")
    got = {r.p: r.v for r in reports.order_statistics(df, "v", [0.5, 1.0, 0.0]).collect()}
    assert got == {0.5: 3.0, 1.0: 4.0, 0.0: 1.0}


def test_failure_streaks(spark):
    rows = stamped(spark, [(i, True, i) for i in range(720)], "bad boolean, id int")
    assert intervals.failure_streak(rows, F.col("bad"), ["device"], ["id"]).count() == 72
    mixed = stamped(spark, [(i, i != 3, i) for i in range(10)], "bad boolean, id int")
    out = intervals.failure_streak(mixed, F.col("bad"), ["device"], ["id"], threshold=3)
    assert [r.id for r in out.orderBy("id").collect()] == [2, 6, 9]


def test_long_dwell_and_cooldown(spark):
    rows = stamped(spark, [(i * 100, "app") for i in range(40)], "pkg string").withColumn("session", F.lit(1).cast("bigint"))
    hits = triggers.long_dwells(rows).select(F.hour("ts").alias("h"), F.minute("ts").alias("m"), "detail").orderBy("h", "m").collect()
    assert [(r.h, r.m, r.detail) for r in hits] == [(0, 25, "app に 25 分"), (0, 50, "app に 50 分")]
    cands = stamped(spark, [(0, "a", 1), (0, "b", 4), (1300, "c", 1), (1400, "d", 9)], "kind string, score int").withColumn("session", F.lit(1).cast("bigint"))
    kept = {r.kind: r.kept for r in triggers.cooldown(cands).collect()}
    assert kept == {"a": False, "b": True, "c": True, "d": False}


def test_context_limits(spark):
    rows = stamped(spark, [(i * 100, "app", f"screen {'abcdefghij'[i % 10] * 20}") for i in range(20)], "pkg string, text string")
    kept = stamped(spark, [(1500, "return", 1)], "kind string, session bigint")
    got = triggers.context(kept, rows, back=900, limit=4).orderBy("ts").collect()
    assert [r.base for r in got] == ["002000_000", "002140_000", "002320_000", "002500_000"]
    nested = triggers.export(kept, triggers.context(kept, rows, back=900, limit=2)).first()
    assert [c.t for c in nested.context] == ["00:23", "00:25"]


# -- activities ---------------------------------------------------------------------------------


def acts(spark, events):
    rows = [("d", i, t, kind, pkg, cls, inst) for i, (t, kind, pkg, cls, inst) in enumerate(events)]
    return spark.createDataFrame(rows, "device string, seq bigint, time bigint, type string, pkg string, cls string, instance_id string")


def naive_fronts(events, window):
    from collections import Counter, deque

    resumed, pending, inst, got, want = Counter(), {}, {}, [], []
    for t, kind, pkg, cls, iid in events:
        key, q = (pkg, cls), pending.setdefault((pkg, cls), deque())
        while window is not None and q and t - q[0] > window:
            q.popleft()
        if kind == "RESUMED":
            resumed[key] += 1
            inst[iid] = pkg
        else:
            inst.pop(iid, None)
            if kind == "PAUSED":
                resumed[key] = max(0, resumed[key] - 1)
                q.append(t)
            elif q:
                q.popleft()
            else:
                resumed[key] = max(0, resumed[key] - 1)
        got.append({k[0] for k, n in resumed.items() if n > 0})
        want.append(set(inst.values()))
    return got, want


def test_foreground_evaluation_equals_sets(spark):
    random.seed(2)
    events, t = [], 0
    for _ in range(400):
        t += random.choice([1, 300, 4000, 15000])
        pkg = random.choice("pqr")
        events.append((t, random.choice(["RESUMED", "PAUSED", "STOPPED"]), pkg, random.choice("xy"), pkg + random.choice("123")))
    got = {(r.window_ms, r.pkg): (r.extra, r.missed) for r in activity.evaluate(acts(spark, events), [None, 10_000]).collect()}
    for window in (None, 10_000):
        fronts, truth = naive_fronts(events, window)
        for pkg in "pqr":
            extra = sum(pkg in g and pkg not in w for g, w in zip(fronts, truth))
            missed = sum(pkg in w and pkg not in g for g, w in zip(fronts, truth))
            assert got[(window, pkg)] == (extra, missed)


# -- layout -------------------------------------------------------------------------------------


def boxes(spark, rows):
    full = [("f", *r[:3], r[3] if len(r) > 3 else 160.0, 16.0, r[4] if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(full, "frame_id string, text string, x double, y double, w double, h double, char_x array<double>")


def borders(spark, rows):
    return spark.createDataFrame([("f", *r) for r in rows], "frame_id string, axis string, at double, lo double, hi double")


PANES = [("L1", 10.0, 20.0), ("R1", 210.0, 20.0), ("L2", 10.0, 40.0), ("R2", 210.0, 40.0), ("L3", 10.0, 60.0), ("R3", 210.0, 60.0)]


@pytest.mark.parametrize("rows, lines, want", [
    (PANES, [("v", 200.0, 0.0, 200.0)], "L1\nL2\nL3\n\nR1\nR2\nR3"),
    ([("RIGHT01", 10.0, 20.0, 60.0), ("rest", 80.0, 20.0, 100.0)], [], "RIGHT01 rest"),
    ([("left", 10.0, 90.0, 170.0), ("right", 220.0, 90.0, 170.0)], [("v", 200.0, 0.0, 200.0)], "left\n\nright"),
    ([("left", 10.0, 32.0, 170.0), ("right", 220.0, 32.0, 170.0)], [("v", 200.0, 30.0, 200.0)], "left\n\nright"),
])
def test_reading_order(spark, rows, lines, want):
    out = layout.emit_text(layout.read_layout(boxes(spark, rows), borders(spark, lines))).first()
    assert out.text == want and out.lines == len([x for x in want.split("\n") if x])


def test_cut_at_border(spark):
    chars = "ab cd ef"
    centres = [None if c == " " else 20.0 + i * 45 for i, c in enumerate(chars)]
    wide = boxes(spark, [(chars, 10.0, 90.0, 380.0, centres)])
    cut = layout.cut_boxes(wide, borders(spark, [("v", 199.0, 0.0, 200.0), ("v", 201.0, 0.0, 200.0)]))
    assert tuples(cut, "text", "x", "w") == [("ab cd", 10.0, 190.0), ("ef", 200.0, 190.0)]


def test_stratified_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [("d", f"2024-01-{day:02}", "120000_000", 5) for day in range(1, 20)]
    for placed in (rows, rows[::-1]):
        df = spark.createDataFrame(placed, "device string, day string, base string, lines bigint").coalesce(1)
        assert [r.day for r in reports.stratified_sample(df, 1, 2).orderBy("day").collect()] == ["2024-01-01", "2024-01-02"]


def test_pauses_are_not_gone_through_per_event_and_none_is_kept_without_a_window():
    """An hour's pauses leave from the front; without a window their number is all that is kept."""
    from retrace.operators.activity import ResumedCount, ResumedCounts

    def plain(events, window):
        resumed, pauses = 0, []
        for time, kind in events:
            pauses = [p for p in pauses if window is None or time - p <= window]
            if kind == "RESUMED":
                resumed += 1
            elif kind == "PAUSED":
                resumed, pauses = max(0, resumed - 1), [*pauses, time]
            elif pauses:
                pauses = pauses[1:]
            else:
                resumed = max(0, resumed - 1)
            yield resumed

    events = [(i * 7 % 50 + i * 10, ("RESUMED", "PAUSED", "STOPPED", "PAUSED", "RESUMED")[i * i % 5]) for i in range(400)]
    events.sort()
    windows = [None, 0, 95, 1000]
    expected = list(zip(*[plain(events, w) for w in windows]))
    fold = ResumedCounts(windows)
    found = []
    for at, event in enumerate(events):
        if at % 37 == 0:  # a slice ends, the next one takes over
            state = fold.state()
            fold = ResumedCounts(windows)
            fold.resume(*state)
        found.append(tuple(fold.step(*event)))
    assert found == expected
    endless = ResumedCount(None)
    for i in range(100):
        endless.step(i, "PAUSED")
    assert not endless.state()[1]


def test_worst_packages_fold_the_events_once(spark, monkeypatch):
    """All windows come from one fold, whose rows are not computed again to count layouts."""
    from retrace.operators import activity

    rows = [("d", i, i * 3, ("RESUMED", "PAUSED", "STOPPED")[i * i % 3], f"p{i % 2}", "c", f"i{i % 4}") for i in range(60)]
    events = spark.createDataFrame(rows, "device string, seq bigint, time bigint, type string, pkg string, cls string, instance_id string")
    folds, plain = [], activity.ordered_fold
    monkeypatch.setattr(activity, "ordered_fold", lambda *a: folds.append(1) or plain(*a))
    windows = [None, 5, 20]
    found = activity.evaluate(events, windows)
    assert len(folds) == 1
    got = tuples(found, "window_ms", "pkg", "extra", "missed")
    each = [activity.evaluate(events, [w]) for w in windows]
    assert got == sorted([t for e in each for t in tuples(e, "window_ms", "pkg", "extra", "missed")], key=repr)
    cut = activity.evaluate(events, windows, slice_rows=7)
    assert got == tuples(cut, "window_ms", "pkg", "extra", "missed")


def test_reports_on_folds_fold_once(spark, monkeypatch):
    """Layouts are counted on stored decisions: the fold runs in one job, however often its rows are read."""
    runs = spark.sparkContext.accumulator(0)
    plain = folds.NearDuplicate.step

    class Counting(folds.NearDuplicate):
        def step(self, *values):
            runs.add(1)
            return plain(self, *values)

    monkeypatch.setattr(folds, "NearDuplicate", Counting)
    rows = frames(spark, [("2024-01-01", f"0000{i:02d}_000", "line of text " + "ab" * (i // 3), "ok") for i in range(30)])
    marks = folds.near_duplicates(rows, [0.9, 0.5])
    for table in reports.loss_report(marks):
        table.collect()
    assert runs.value == 30
    reports.kept_sessions(marks, 3).collect()
    assert runs.value == 60


def test_gram_numbers_tell_grams_apart():
    """Numbers of grams say of two texts what their sets of grams say."""
    from retrace.functions.text import gram_ids, gram_set, overlap, shared_ids

    texts = ["", None, "a", "ab", "abc", "abc\x00", "abcd", " a b　c d ", "a\U0001f600", "a\U0001f600b\U0001f600c", "日本語テキスト", "日本語\U0001f600テキスト日本語テ", "aaaaaaaa", "\x00\x00\x00\x00\x00"]
    for a in texts:
        assert len(gram_ids(a)) == len(gram_set(a))
        for b in texts:
            assert shared_ids(gram_ids(a), gram_ids(b)) == overlap(gram_set(a), gram_set(b), 1.0)[1]
