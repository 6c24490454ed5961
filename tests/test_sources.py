import functools
import json

from pyspark.sql import functions as F

from helpers import tuples
from retrace.operators import reports
from retrace.sources import captures, logs, tables
from retrace.streaming import live


dumps = functools.partial(json.dumps, separators=(",", ":"))


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


FIRST = '{"t":"000009_341","gen":0,"w":1080,"h":2364,"bytes":127131,"lines":2,"ms":1040,"status":"ok","text":"0:00 m\\n投稿者:参 Sudoku"}'
TORN = '{"t":"000009_341","gen":0,"status":"ok","text":"途中'


def test_ocr_log(spark, tmp_path):
    day = tmp_path / "2026-08-19"
    tricky = "line\n\"quote\" \\ tab\t \u0001"
    write(day / "ocr.jsonl", [FIRST, "", dumps({"t": "120000_000", "status": "failed", "err": "x"}), TORN, "[1, 2]",
                              dumps({"status": "ok"}), dumps({"t": "130000_000", "text": "no status"}),
                              dumps({"t": "140000_000", "status": "ok", "text": tricky})])
    write(day / "apps.jsonl", ['{"t":"000000_000","pkg":"a"}'])
    rows, bad = logs.read(spark, str(tmp_path), "ocr")
    entries = {r.base: r for r in logs.ocr_entries(rows).collect()}
    assert set(entries) == {"000009_341", "120000_000", "140000_000"}
    assert entries["140000_000"].text == tricky and entries["120000_000"].bytes == 0
    assert entries["000009_341"].text.startswith("0:00 m\n")
    assert tuples(bad, "line_no", "reason", "line") == [(4, "invalid", TORN), (5, "no t", "[1, 2]"), (6, "no t", dumps({"status": "ok"}))]
    report = logs.ledger_report(bad, first=2, chars=10).first()
    assert report.total == 3 and [(x.line_no, x["head"]) for x in report.shown] == [(4, TORN[:10]), (5, "[1, 2]")]
    stems = logs.attempted_stems(logs.raw_lines(spark, str(tmp_path), "ocr.jsonl"))
    assert {r.base for r in stems.collect()} >= {"000009_341", "140000_000"}
    assert {r.base for r in logs.secured_stems(logs.ocr_entries(rows)).collect()} == {"000009_341", "140000_000"}


def test_last_written_wins(spark, tmp_path):
    line = lambda t, text: dumps({"t": t, "status": "ok", "text": text})
    write(tmp_path / "2026-10-15" / "ocr.jsonl", [line("120000_000", "x"), line("090000_000", "old"), line("090000_000", "new"), '{"t":"130000_000","sta'])
    rows, _ = logs.read(spark, str(tmp_path), "ocr")
    got = logs.last_written(logs.ocr_entries(rows), ["device", "day", "base"]).orderBy("base").collect()
    assert [(r.base, r.text) for r in got] == [("090000_000", "new"), ("120000_000", "x")]


def test_other_logs(spark, tmp_path):
    day = tmp_path / "2026-01-01"
    write(day / "apps.jsonl", ['{"t":"090000_000","pkg":"a","label":"A"}', '{"t":"090001_000"}'])
    write(day / "gaps.jsonl", ['{"t":"090000_000","state":"sleep","reason":"lid"}'])
    write(day / "keys.jsonl", ['{"app":"com.google.Chrome","key":"c","mods":["cmd"],"t":"162303_273"}'])
    write(day / "blackouts.jsonl", ['{"t":"213040_120","state":"start"}'])
    assert tuples(logs.app_entries(logs.read(spark, str(tmp_path), "apps")[0]), "base", "pkg", "label") == [("090000_000", "a", "A")]
    assert tuples(logs.read(spark, str(tmp_path), "gaps")[0], "state", "reason") == [("sleep", "lid")]
    key = logs.read(spark, str(tmp_path), "keys")[0].first()
    assert (key.key, key.mods, key.app, key.ts.microsecond) == ("c", ["cmd"], "com.google.Chrome", 273000)
    assert tuples(logs.read(spark, str(tmp_path), "blackouts")[0], "base", "state") == [("213040_120", "start")]


def test_devices_and_days_come_from_folders(spark, tmp_path):
    for device in ("a", "b"):
        for day in ("2026-01-01", "2026-01-02"):
            write(tmp_path / device / day / "ocr.jsonl", [dumps({"t": "120000_000", "status": "ok", "text": device})])
            (tmp_path / device / day / "090000_000.jpg").write_bytes(b"x")
    rows, _ = logs.read(spark, str(tmp_path), "ocr", device=None)
    assert tuples(rows, "device", "text") == [("a", "a"), ("a", "a"), ("b", "b"), ("b", "b")]
    listed = captures.listing(spark, str(tmp_path), device=None, days=["2026-01-02", "2026-05-05"])
    assert tuples(listed, "device", "base") == [("a", "090000_000"), ("b", "090000_000")]
    assert all("2026-01-02" in f for f in listed.inputFiles())
    assert captures.listing(spark, str(tmp_path), device=None, days=["2026-05-05"]).collect() == []


def test_capture_listing(spark, tmp_path):
    for name, size in (("2026-08-13/162303_273.g2.jpg", 3), ("2026-08-13/162303_273.jpg", 5), ("2026-08-14/090000_000.JPG", 7), ("2026-08-14/note.jpg", 1), ("2026-08-14/x.tmp", 1)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * size)
    listed = captures.listing(spark, str(tmp_path))
    assert listed.count() == 4 and captures.in_day_directories(listed).count() == 3
    assert tuples(captures.one_per_base(captures.in_day_directories(listed)), "day", "base", "gen", "bytes") == [
        ("2026-08-13", "162303_273", 0, 5), ("2026-08-14", "090000_000", 0, 7)]
    newest = reports.latest(captures.in_day_directories(listed), 1).collect()
    assert [r.base for r in newest] == ["090000_000"]
    assert reports.latest(listed, 0).count() == 0 and reports.latest(listed, -1).count() == 0
    stats = reports.archive_stats(listed).first()
    assert (stats["count"], stats.bytes) == (4, 16)


def test_upsert_replaces_whole_rows(spark, tmp_path):
    ddl = "device string, day string, base string, status string, text string, err string"
    path = str(tmp_path / "frames")
    tables.write_frames(spark.createDataFrame([("d", "2026-01-01", "1", "failed", None, "boom"), ("d", "2026-01-02", "2", "ok", "b", None)], ddl), path)
    tables.upsert_table(spark, path, spark.createDataFrame([("d", "2026-01-01", "1", "ok", "a", None)], ddl))
    got = tuples(tables.history(spark, path), "base", "status", "text", "err")
    assert got == [("1", "ok", "a", None), ("2", "ok", "b", None)]
    assert tables.history(spark, path, ["2026-01-02"]).count() == 1


def test_activity_dump(spark, tmp_path):
    row = "  time={} type=ACTIVITY_{} package=p.q class=c instanceId=7"
    (tmp_path / "dump.txt").write_text("\n".join([row.format(5, "PAUSED"), "noise", row.format(1, "RESUMED"), row.format(1, "RESUMED")]))
    got = tuples(logs.activity_dump(spark, str(tmp_path / "dump.txt")), "time", "type", "pkg", "instance_id")
    assert got == [(1, "RESUMED", "p.q", "7"), (5, "PAUSED", "p.q", "7")]


def test_append_log(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "s bigint").select(F.timestamp_seconds("s").alias("ts"), F.lit("000001_000").alias("t"), F.lit("start").alias("state"))
    tables.append_log(rows, str(tmp_path / "log"))
    tables.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_listing_grows_and_newest_reads_few_days(spark, tmp_path):
    def image(day, base):
        path = tmp_path / "root" / "d" / day / f"{base}.jpg"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")

    out = str(tmp_path / "out")
    for number in range(3):
        image(f"2026-08-1{number}", "090000_000")
        image(f"2026-08-1{number}", "100000_000")
        image("2026-08-10", f"11000{number}_000")
        captures.follow(spark, str(tmp_path / "root"), out)
    assert spark.read.parquet(f"{out}/rows").count() == 9
    found = captures.newest(spark, out, 3)
    assert [(r.day, r.base) for r in found.collect()] == [("2026-08-12", "100000_000"), ("2026-08-12", "090000_000"), ("2026-08-11", "100000_000")]
    pruned = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "2026-08-12" in pruned and "2026-08-11" in pruned and "2026-08-10" not in pruned
    assert captures.newest(spark, out, 99).count() == 9 and captures.newest(spark, out, 0).collect() == []


def test_followed_log_reads_new_files_once(spark, tmp_path):
    root, out = tmp_path / "root", str(tmp_path / "out")
    write(root / "a" / "2026-01-01" / "gaps.jsonl", ['{"t":"090000_000","state":"sleep"}', "{torn", "", '{"state":"x"}'])
    first = live.follow(spark, str(root), "gaps", out)
    assert tuples(first.rows, "device", "base", "state") == [("a", "090000_000", "sleep")]
    write(root / "b" / "2026-01-02" / "gaps.jsonl", ['{"t":"100000_000","state":"wake"}'])
    write(root / "b" / "2026-01-02" / "other.jsonl", ['{"t":"100000_000","state":"no"}'])
    second = live.follow(spark, str(root), "gaps", out)
    assert tuples(second.rows, "device", "day", "state") == [("a", "2026-01-01", "sleep"), ("b", "2026-01-02", "wake")]
    assert tuples(second.ledger, "line_no", "reason", "line") == [(2, "invalid", "{torn"), (4, "no t", '{"state":"x"}')]
    assert live.follow(spark, str(root), "gaps", out).rows.count() == 2
