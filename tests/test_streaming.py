import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helpers import tuples
from retrace.sources import tables
from retrace.streaming import machines as M
from retrace.streaming import stateful, windows
from test_queries import FOLDER, SQL, QUERIES, canonical, duck  # noqa: F401


def feed(machine, rows):
    state, out = M.State(), []
    for row in rows:
        out += machine.step(state, row)
        kept, state = state.slots, M.State(json.loads(json.dumps(state)))  # what the state store keeps between batches
        state.slots = kept
    return out + machine.finish(state, rows[-1]["us"]), state


PAY, HOME = "jp.ne.paypay.android.app", "com.google.android.apps.nexuslauncher"


def events(*rows):
    return [{"us": t * 1000, "type": kind, "pkg": pkg, "cls": cls, "sensitive": pkg == PAY} for t, kind, pkg, cls in rows]


def front(*rows, **options):
    out, _ = feed(M.ResumedActivities(every_event=True, **options), events(*rows))
    return [(o["us"] // 1000, bool(o["sensitive"])) for o in out]


def test_cancelled_home_gesture_keeps_payment_app():
    got = front(
        (43280, "RESUMED", HOME, "N"), (44902, "PAUSED", HOME, "N"), (44912, "RESUMED", PAY, "Mini"), (46339, "PAUSED", PAY, "Mini"),
        (46344, "RESUMED", PAY, "Main"), (54734, "RESUMED", HOME, "N"), (57383, "PAUSED", HOME, "N"), (66642, "PAUSED", PAY, "Main"),
        (66645, "RESUMED", "com.android.settings", "S"),
    )
    assert [t for t, s in got if s][-1] < 66642 and dict(got)[66642] is False
    assert all(s for t, s in got if 46344 <= t < 66642)


def last(*rows, **options):
    return front(*rows, **options)[-1][1]


def test_slot_rules():
    assert last((40700, "RESUMED", PAY, "M"), (40817, "PAUSED", PAY, "M"), (40818, "RESUMED", PAY, "M"), (41217, "STOPPED", PAY, "M"))
    assert not last((1000, "RESUMED", PAY, "M"), (3000, "STOPPED", PAY, "M"))
    assert not last((1000, "RESUMED", PAY, "M"), (2000, "PAUSED", PAY, "M"), (3000, "RESUMED", PAY, "M"), (60000, "STOPPED", PAY, "M"))
    assert last((1000, "RESUMED", PAY, "M"), (2000, "RESUMED", "com.twitter.android", "M"))
    assert not last(*[e for e in ((1000, "RESUMED", PAY, "M"), (3000, "PAUSED", PAY, "M")) for _ in range(2)])
    assert not last((1000, "RESUMED", PAY, "M"), (60000, "RESUMED", HOME, "N"), (61000, "PAUSED", PAY, "M"))


def test_throttle_and_streak():
    assert len(feed(M.FailureStreak(10), [{"us": i, "failed": True, "id": i} for i in range(720)])[0]) == 72
    out, _ = feed(M.Throttle(3600), [{"us": int(s * 1e6), "id": s} for s in (0, 60, 3601, 3700)])
    assert [o["id"] for o in out] == [0, 3601]


def test_gap_log_carries_over_days():
    row = lambda us, day, state: {"us": us, "day": day, "state": state, "reason": None}
    out, _ = feed(M.GapLog(), [row(1, "a", "unlocked"), row(2, "a", "sleep"), row(3, "a", "locked"), row(4, "a", "sleep"), row(5, "b", "wake"), row(6, "b", "app_stop")])
    assert [(o["day"], o["state"], o["reason"]) for o in out] == [
        ("a", "sleep", None), ("a", "locked", None), ("b", "locked", "carried over"), ("b", "wake", None), ("b", "app_stop", None)]


def test_blackout_machine():
    row = lambda us, day, dark: {"us": us, "day": day, "dark": dark}
    out, _ = feed(M.BlackoutLog(), [row(1, "a", False), row(2, "a", True), row(3, "a", True), row(4, "b", True), row(5, "b", False)])
    assert [(o["day"], o["state"]) for o in out] == [("a", "start"), ("b", "start"), ("b", "end")]
    assert feed(M.BlackoutLog(), [row(1, "a", False), row(2, "b", False)])[0] == []


def test_forgotten_slots_leave_the_state():
    rows = events((1000, "RESUMED", PAY, "M"), (2000, "PAUSED", PAY, "M"), (9000, "RESUMED", HOME, "N"))
    machine, state = M.ResumedActivities(), M.State()
    for row in rows:
        machine.step(state, row)
    assert set(state.slots.known) == {f"{PAY}/M", f"{HOME}/N"}
    machine.finish(state, 12_000_000)
    assert set(state.slots.known) == {f"{PAY}/M", f"{HOME}/N"}  # a stop may still settle the pause
    machine.finish(state, 12_001_000)
    assert set(state.slots.known) == {f"{HOME}/N"} and state["idle"] == {}


SCHEMA = "device string, s bigint, failed boolean"
WAIT = {"delay_ms": 5_000, "slice_ms": 1_000}


def batches(spark, folder, parts):
    """A stream over `parts`, lists of (device, second, failed), one per micro-batch."""
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.withColumn("ts", F.timestamp_seconds("s")).withColumn("id", F.col("s")).write.parquet(f"{folder}/p{i}")
    schema = spark.read.parquet(f"{folder}/p0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p*")


def streaks(rows, n, before):
    got = feed(M.FailureStreak(n), [{"us": s * 10**6, "failed": f, "id": s} for _, s, f in rows if s < before])[0]
    return {(o["id"], o["streak"]) for o in got}


def test_shuffled_batches_give_the_rows_of_one(spark, tmp_path, monkeypatch):
    """Rows up to five seconds out of order over batches, with chunks in the state store, against all rows in order."""
    monkeypatch.setattr(stateful, "HELD", 7)
    monkeypatch.setattr(stateful, "CHUNK", 2)
    rows = [("d", i, i % 7 != 3) for i in range(60)]
    dealt = sorted(rows, key=lambda r: r[1] + r[1] * 7 % 5)
    written = stateful.drive(stateful.run_machine(batches(spark, tmp_path, [dealt[i : i + 20] for i in (0, 20, 40)]), M.FailureStreak(3), tie="id", **WAIT), "t")
    assert set(tuples(written.rows, "id", "streak")) == streaks(rows, 3, 54) and written.late.count() == 0


class Calls:
    """A state store in memory that counts the messages sent to it."""

    def __init__(self):
        self.known, self.n = {}, 0

    def getValueState(self, name, *schemas):
        return Entries(self, name)

    getMapState = getValueState


class Entries:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self, act, key=()):
        self.store.n += 1
        return act((self.name, *key))

    def exists(self):
        return self._call(self.store.known.__contains__)

    def get(self):
        return self._call(self.store.known.get)

    def update(self, value):
        self._call(lambda at: self.store.known.__setitem__(at, value))

    def containsKey(self, key):
        return self._call(self.store.known.__contains__, key)

    def getValue(self, key):
        return self._call(self.store.known.get, key)

    def updateValue(self, key, value):
        self._call(lambda at: self.store.known.__setitem__(at, value), key)

    def removeKey(self, key):
        self._call(lambda at: self.store.known.pop(at), key)


def test_a_device_costs_two_messages_to_the_state_store_a_batch():
    rows = [("d", i, i % 7 != 3) for i in range(300)]
    for size in (20, 300):  # few waiting rows, and more than stay with the device
        processor, store, found = stateful.MachineProcessor(M.FailureStreak(3), "device", 250_000, 1_000), Calls(), []
        processor.init(store)
        for at in range(0, 300, size):
            batch = [Row(device="d", us=s * 10**6, tie=s, failed=f, id=s) for _, s, f in rows[at : at + size]]
            before = store.n
            found += [(r.id, r.streak) for r in processor.handleInputRows(("d",), iter(batch), None)]
            if (at + size) <= 200:
                assert store.n - before == 2
        batch = [Row(device="d", us=600 * 10**6, tie=600, failed=False, id=600)]
        found += [(r.id, r.streak) for r in processor.handleInputRows(("d",), iter(batch), None)]
        assert set(found) == streaks(rows, 3, 300) and len(found) == len(set(found))
        assert not [at for at in store.known if at[0] == "waiting"]


def test_late_devices_lose_nothing(spark, tmp_path):
    """Four one-file batches, the last device an hour behind: sessions, counts, single deliveries and machine rows."""
    rows = [("a", 4000 + i, True) for i in range(20)], [("b", 4000 + i, True) for i in range(20)], [("a", 8000, True), ("b", 8000, True)], [
        ("late", 400 + i, True) for i in range(5)] + [("late", 3000, True)]
    stream = batches(spark, tmp_path, rows)
    every = [r for part in rows for r in part]
    once = stateful.to_files(windows.once(stream, ["device", "s"]), "t")
    assert sorted(tuples(once, "device", "s")) == sorted((d, s) for d, s, _ in every)
    counts = stateful.add_batches(stream.withColumn("status", F.col("device")), windows.status_counts, ["start", "status"], "t")
    assert counts.agg(F.sum("n")).first()[0] == len(every)
    recent = windows.last_hour(counts, counts.agg(F.max("start")).first()[0])
    assert dict(tuples(recent, "status", "n")) == {"a": 1, "b": 1}
    closed = stateful.drive(windows.sessions(stream, 60, **WAIT), "t")
    assert sorted(tuples(closed.rows, "device", "start", "end", "frames")) == [
        ("a", 4000 * 10**6, 4019 * 10**6, 20), ("b", 4000 * 10**6, 4019 * 10**6, 20), ("late", 400 * 10**6, 404 * 10**6, 5)]
    assert closed.late.count() == 0


def test_rows_behind_their_own_device_are_kept_apart(spark, tmp_path):
    rows = [("d", i, True) for i in range(30)]
    late = [("d", 3, False), ("d", 40, True), ("e", 3, True)]
    written = stateful.drive(stateful.run_machine(batches(spark, tmp_path, [rows, late]), M.FailureStreak(10), tie="id", **WAIT), "t")
    assert set(tuples(written.rows, "device", "id", "streak")) == {("d", 9, 10), ("d", 19, 20), ("d", 29, 30)}
    assert [(r["device"], json.loads(r["late_row"])["us"]) for r in written.late.collect()] == [("d", 3_000_000)]


def test_starts_from_history(spark, tmp_path):
    rows = [("d", i, i % 7 != 3) for i in range(60)]
    stream = batches(spark, tmp_path, [rows[20:40], rows[40:]])
    history = spark.createDataFrame(rows[:20], SCHEMA).withColumn("ts", F.timestamp_seconds("s")).withColumn("id", F.col("s"))
    begun = stateful.bootstrap_state(history, M.FailureStreak(3), tie="id")
    found = stateful.to_files(stateful.run_machine(stream, M.FailureStreak(3), tie="id", initial=begun, **WAIT), "t")
    assert set(tuples(found, "id", "streak")) == {e for e in streaks(rows, 3, 54) if e[0] >= 20}


def test_fresh_and_backlog_share_one_table(spark, tmp_path):
    """Both touch the same days, one of them the same frame; no row is lost and the later reading wins."""
    row = lambda day, base, status, seq: ("d", day, base, status, seq)
    schema = "device string, day string, base string, status string, seq bigint"
    parts = {
        "fresh": [row("2026-01-01", "f1", "ok", 5), row("2026-01-02", "b", "ok", 9), row("2026-01-02", "b", "failed", 3)],
        "backlog": [row("2026-01-01", "b1", "ok", 1), row("2026-01-02", "b2", "empty", 2), row("2026-01-03", "b3", "ok", 3)],
    }
    for name, rows in parts.items():
        for i, r in enumerate(rows if name == "backlog" else [rows]):
            data = r if name == "fresh" else [r]
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / name / f"p{i}"))
    table = str(tmp_path / "table")
    tables.write_frames(spark.createDataFrame([("d", "2026-01-01", "old", "ok"), ("d", "2026-01-09", "far", "ok")], "device string, day string, base string, status string"), table)
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    upsert = lambda batch, number: tables.upsert_table(spark, table, batch, sequence="seq")
    query = windows.ingest(read("fresh"), read("backlog"), upsert, str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    found = {(r.day, r.base, r.status) for r in spark.read.parquet(table).collect()}
    assert {(str(d), b, s) for d, b, s in found} == {
        ("2026-01-01", "old", "ok"), ("2026-01-09", "far", "ok"), ("2026-01-01", "f1", "ok"), ("2026-01-02", "b", "ok"),
        ("2026-01-01", "b1", "ok"), ("2026-01-02", "b2", "empty"), ("2026-01-03", "b3", "ok")}


def test_upsert_reads_touched_days_and_breaks_ties_by_sequence(spark, tmp_path):
    old = spark.createDataFrame([("d", f"2026-01-{i:02}", "x", "ok") for i in range(1, 10)], "device string, day string, base string, status string")
    tables.write_frames(old, str(tmp_path / "t"))
    plan = tables.touched(spark, str(tmp_path / "t"), ["2026-01-03"])._jdf.queryExecution().executedPlan().toString()
    assert "2026-01-03" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    rows = [("d", "2026-01-03", "x", s, n) for s, n in (("new", 2), ("old", 1), ("mid", 1))]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        fresh = spark.createDataFrame(order, "device string, day string, base string, status string, seq bigint")
        out = tables.upsert(old, fresh, sequence="seq")
        assert [r.status for r in out.where("day = '2026-01-03'").collect()] == ["new"] and out.count() == 9 and "seq" not in out.columns
    same = [tables.upsert(old, spark.createDataFrame(o, "device string, day string, base string, status string")).where("day = '2026-01-03'").first().status
            for o in ([r[:4] for r in rows], [r[:4] for r in rows[::-1]])]
    assert same[0] == same[1]


def test_running_stats_stop_at_zero_after_each_deletion():
    row = lambda us, n, size: {"us": us, "n": n, "bytes": size}
    out, _ = feed(M.RunningStats(), [row(1, 1, 10), row(2, -5, -50), row(3, 3, 30)])
    assert out == [{"us": 3, "count": 3, "bytes": 30, "first": 1, "last": 3}]


@pytest.mark.parametrize("name", ["stream_foreground_log", "stream_once", "stream_near_duplicates"])
def test_batches_of_many_files_give_the_rows_of_one(spark, duck, monkeypatch, name):  # noqa: F811
    """No task writes or reads a whole batch, and batches stay apart."""
    from retrace.plans import stream_queries

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 50)
    monkeypatch.setattr(stream_queries, "_arrivals", {})
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert [files for _, files in stream_queries._arrivals.values()] == [4]


def test_batches_have_equally_many_files(spark, tmp_path):
    from retrace.plans.stream_queries import write_files

    for n in (0, 2, 100):
        write_files(spark.range(n), str(tmp_path / str(n)), 5)
        assert len(list((tmp_path / str(n)).glob("*.parquet"))) == 5 and spark.read.parquet(str(tmp_path / str(n))).count() == n
