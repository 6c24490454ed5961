"""Streaming queries: each runs its stream over everything available and returns the rows it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from retrace.plans.registry import EVENTS, FRAMES, JITTERED, Tables, query
from retrace.plans.text_queries import near_dup_sql
from retrace.plans.time_queries import BLACKOUT, GAPS, SLOTS, thin_sql
from retrace.session import scratch_path
from retrace.sources import logs, tables
from retrace.streaming import live, machines, stateful, windows


BATCHES = 4
FILE_ROWS = 20_000  # rows of all batches for each file of one
DELAY_MS, SLICE_MS = 7_200_000, 3_600_000
_arrivals: dict[tuple, tuple[str, int]] = {}


def arrivals(t: Tables, name: str, rows):
    """Stream of `rows` in the order of arrival (`_arrival`, in seconds): BATCHES batches of equally many files each."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _arrivals:
        folder = scratch_path(t.spark, f"{name}-arrivals")
        first, last, n = rows.agg(F.min("_arrival"), F.max("_arrival"), F.count("*")).first()
        files = max(1, min(-(-n // FILE_ROWS), int(t.spark.conf.get("spark.sql.shuffle.partitions"))))
        width = ((last or 0) - (first or 0)) / BATCHES or 1
        number = F.least(F.floor((F.col("_arrival") - F.lit(first or 0)) / width), F.lit(BATCHES - 1))
        for i in range(BATCHES):  # one after the other: a stream takes the oldest files first
            write_files(rows.where(number == i).drop("_arrival"), f"{folder}/batch{i}", files)
        _arrivals[key] = folder, files
    folder, files = _arrivals[key]
    return stateful.open_table(t.spark, f"{folder}/*", "*.parquet", rows.drop("_arrival").schema, files)


def write_files(rows, folder: str, files: int) -> None:
    """Exactly `files` files, so that as many for each batch keep batches apart; empty ones stand in for parts without rows."""
    placed = rows.coalesce(1) if files == 1 else rows.repartition(files)
    placed.write.parquet(folder)
    count = lambda: len(rows.sparkSession.read.schema(rows.schema).parquet(folder).inputFiles())
    for _ in range(files - count()):
        rows.limit(0).coalesce(1).write.mode("append").parquet(folder)
    if count() != files:
        raise RuntimeError(f"{folder} holds {count()} files, not {files}")


def event_stream(t: Tables):
    """Events as they arrive: every third device an hour behind the others, single rows up to 50 minutes late, four batches."""
    raw = t.table("events")
    late = (F.col("user_id") % 3 == 0).cast("long") * 3600 + F.col("event_id") % 6 * 600
    rows = arrivals(t, "events", raw.withColumn("_arrival", F.unix_seconds(F.col("ts").cast("timestamp")) + late))
    ts = F.col("ts").cast("timestamp")
    return rows.select(
        F.col("user_id").alias("device"), ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value"
    )


def in_order(rows, machine, tie="event_id"):
    """The machine's rows once each device's horizon has passed."""
    return stateful.run_machine(rows, machine, tie=tie, delay_ms=DELAY_MS, slice_ms=SLICE_MS)


#: events before their device's horizon, two hours before its newest event, in whole hours
HORIZON = EVENTS.replace("FROM events)", """FROM events
  QUALIFY epoch_us(ts) < (epoch_us(max(ts) OVER (PARTITION BY user_id)) - 7200000000) // 3600000000 * 3600000000)""")


@query("stream_foreground_log", f"""WITH {HORIZON}, p AS (SELECT *, lag(event_type) OVER w AS b, lag(day) OVER w AS d FROM ev WHERE event_type <> 'error'
  WINDOW w AS (PARTITION BY device ORDER BY ts, event_id))
SELECT device, epoch_us(ts) AS us, day, event_type AS pkg FROM p WHERE b IS DISTINCT FROM event_type OR d IS DISTINCT FROM day""")
def stream_foreground_log(t: Tables):
    rows = event_stream(t).withColumn("pkg", F.col("event_type")).withColumn("overlay", F.col("event_type") == "error")
    return stateful.to_files(in_order(rows, machines.ForegroundLog()), "foreground")


@query("stream_blackout_log", BLACKOUT.replace(EVENTS, HORIZON) + " SELECT device, epoch_us(ts) AS us, day, state FROM bl WHERE state IS NOT NULL")
def stream_blackout_log(t: Tables):
    rows = event_stream(t).withColumn("dark", F.col("event_type").isin("error", "view"))
    return stateful.to_files(in_order(rows, machines.BlackoutLog()), "blackouts")


@query("stream_gap_log", GAPS.replace(EVENTS, HORIZON) + """, em AS (SELECT device, ts, day, event_id, state, gap, open FROM e WHERE open <> coalesce(b, false)
  UNION ALL SELECT device, ts, day, event_id, state, NULL, NULL FROM g WHERE gap IS NULL),
w AS (SELECT *, lag(day) OVER (PARTITION BY device ORDER BY ts, event_id) AS before,
  last_value(CASE WHEN gap = 'sleep' THEN open END IGNORE NULLS) OVER o AS sleeping, last_value(CASE WHEN gap = 'locked' THEN open END IGNORE NULLS) OVER o AS lock
  FROM em WINDOW o AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT device, epoch_us(ts) AS us, day, state, CAST(NULL AS VARCHAR) AS reason FROM w
UNION ALL SELECT device, epoch_us(ts), day, 'sleep', 'carried over' FROM w WHERE before <> day AND sleeping AND state <> 'sleep'
UNION ALL SELECT device, epoch_us(ts), day, 'locked', 'carried over' FROM w WHERE before <> day AND lock AND state <> 'locked'""")
def stream_gap_log(t: Tables):
    names = {"view": "sleep", "click": "wake", "purchase": "locked", "signup": "unlocked"}
    state = F.lit("app_start")
    for kind, name in names.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    rows = event_stream(t).withColumn("state", state).withColumn("reason", F.lit(None).cast("string"))
    return stateful.to_files(in_order(rows, machines.GapLog()), "gaps")


FRONT = SLOTS.replace(EVENTS, HORIZON) + """,
got AS (SELECT device, seq, array_to_string(list_sort(list_distinct(list(pkg))), ',') AS packages FROM (
   SELECT a.device, a.seq, s.pkg FROM act a JOIN st s ON s.device = a.device AND (s.time, s.seq) <= (a.time, a.seq)
   QUALIFY row_number() OVER (PARTITION BY a.device, a.seq, s.pkg, s.cls ORDER BY s.rn DESC) = 1 AND s.resumed > 0) GROUP BY ALL),
f AS (SELECT ev.device, epoch_us(ev.ts) AS us, event_id, coalesce(packages, '') AS packages FROM ev LEFT JOIN got ON got.device = ev.device AND got.seq = event_id),
c AS (SELECT *, lag(packages) OVER (PARTITION BY device ORDER BY us, event_id) AS b FROM f)
SELECT device, us, packages, CASE WHEN contains(packages, 'p1') THEN 'p1' ELSE '' END AS sensitive FROM c WHERE b IS DISTINCT FROM packages"""


@query("stream_resumed_activities", FRONT)
def stream_resumed_activities(t: Tables):
    amount = F.floor("value").cast("bigint")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "RESUMED").when(F.col("event_type") == "view", "STOPPED").otherwise("PAUSED")
    rows = event_stream(t).select(
        "device", "ts", "event_id", kind.alias("type"), F.concat(F.lit("p"), (amount % 3).cast("string")).alias("pkg"),
        F.concat(F.lit("c"), (amount % 2).cast("string")).alias("cls"), (amount % 3 == 1).alias("sensitive"),
    )
    machine = machines.ResumedActivities(window_ms=36_000_000, every_event=True)
    out = stateful.to_files(in_order(rows, machine), "activities")
    return out.withColumns({c: F.array_join(c, ",") for c in ("packages", "sensitive")})


#: frames before their device's horizon, a minute before its newest frame, in whole minutes
FRAMES_BEFORE = JITTERED.replace("FROM documents))", """FROM documents)
  QUALIFY epoch_us(ts) < (epoch_us(max(ts) OVER (PARTITION BY source)) - 60000000) // 60000000 * 60000000)""")


@query("stream_near_duplicates", near_dup_sql(FRAMES_BEFORE, [0.25], """, k AS (SELECT device, ref, count(*) AS dwell, max(epoch_us(ts)) AS until,
  max(CASE WHEN kept THEN epoch_us(ts) END) AS us, max(CASE WHEN kept THEN base END) AS base FROM dec GROUP BY ALL)
SELECT device, us, base, lag(dwell) OVER w AS dwell_before, lag(until) OVER w AS until_before FROM k WINDOW w AS (PARTITION BY device ORDER BY ref)"""))
def stream_near_duplicates(t: Tables):
    """Kept frames, each with dwell and end of the one before it; frames come in four batches."""
    raw = t.table("documents")
    ts = F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") * 5) * 1_000_000 + F.col("n_chars") * 1000)
    stream = arrivals(t, "documents", raw.withColumn("_arrival", F.unix_seconds(ts) + F.col("doc_id") % 4 * 10))
    rows = stream.select(F.col("source").alias("device"), ts.alias("ts"), F.date_format(ts, "HHmmss_SSS").alias("base"), "text", "doc_id")
    return stateful.to_files(stateful.run_machine(rows, machines.NearDuplicateLog(0.25), tie="doc_id"), "near-duplicates")


@query("stream_failure_streak", f"""WITH {HORIZON}, c AS (SELECT *, CASE WHEN lag(event_type = 'error') OVER w = (event_type = 'error') THEN 0 ELSE 1 END AS c FROM ev WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY device, run ORDER BY ts, event_id) AS streak FROM r)
SELECT device, epoch_us(ts) AS us, event_id AS id, streak FROM n WHERE event_type = 'error' AND streak % 2 = 0""")
def stream_failure_streak(t: Tables):
    rows = event_stream(t).withColumn("failed", F.col("event_type") == "error").withColumn("id", F.col("event_id"))
    return stateful.to_files(in_order(rows, machines.FailureStreak(2)), "streaks")


@query("stream_throttle", thin_sql(HORIZON.replace("FROM events", "FROM events WHERE event_type = 'error'") + ", src AS (SELECT * FROM ev)", "device", "ts, event_id", 172800_000_000,
                                   "SELECT device, epoch_us(keep.ts) AS us, event_id AS id FROM keep JOIN o USING (device, rn)"))
def stream_throttle(t: Tables):
    rows = event_stream(t).where(F.col("event_type") == "error").withColumn("id", F.col("event_id"))
    return stateful.to_files(in_order(rows, machines.Throttle(172800)), "throttle")


@query("stream_running_stats", f"""WITH {HORIZON}, d AS (SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS n FROM ev),
s AS (SELECT *, sum(n) OVER w AS sn, sum(n * CAST(floor(value) AS BIGINT)) OVER w AS sb FROM d WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT device, arg_max(sn, (ts, event_id)) AS n, arg_max(sb, (ts, event_id)) AS b, least(min(sn), 0) AS ln, least(min(sb), 0) AS lb,
  min(CASE WHEN n > 0 THEN epoch_us(ts) END) AS first, max(CASE WHEN n > 0 THEN epoch_us(ts) END) AS last FROM s GROUP BY device)
SELECT device, (n - ln)::BIGINT AS count, (b - lb)::BIGINT AS bytes, first, last FROM l""")
def stream_running_stats(t: Tables):
    """Statistics after the last batch."""
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    changes = event_stream(t).select("device", "ts", "event_id", sign.alias("n"), (sign * F.floor("value").cast("bigint")).alias("bytes"))
    rows = stateful.to_files(in_order(changes, machines.RunningStats()), "stats")
    last = F.max_by(F.struct("count", "bytes", "first", "last"), "us").alias("r")
    return rows.groupBy("device").agg(last).select("device", "r.*")


@query("stream_sessions", f"""WITH {HORIZON}, h AS (SELECT user_id AS device, (epoch_us(max(ts)) - 7200000000) // 3600000000 * 3600000000 AS horizon FROM events GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY device ORDER BY ts)),
g AS (SELECT *, sum(s) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM f),
x AS (SELECT device, session, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS frames FROM g GROUP BY ALL)
SELECT device, start, "end", frames FROM x JOIN h USING (device) WHERE horizon - "end" > 21600000000""")
def stream_sessions(t: Tables):
    """Sessions that each device's own horizon has closed."""
    return stateful.to_files(windows.sessions(event_stream(t), 6 * 3600, DELAY_MS, SLICE_MS), "sessions")


STATUS_COUNTS = "SELECT epoch_us(ts) // 600000000 * 600000000 AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL"


def status_counts(t: Tables):
    rows = event_stream(t).withColumn("status", F.col("event_type"))
    return stateful.add_batches(rows, windows.status_counts, ["start", "status"], "status-counts")


@query("stream_status_counts", STATUS_COUNTS)
def stream_status_counts(t: Tables):
    return status_counts(t)


@query("stream_last_hour", f"WITH c AS ({STATUS_COUNTS}) SELECT status, sum(n)::BIGINT AS n FROM c WHERE start >= (SELECT max(start) FROM c) - 3600000000 GROUP BY ALL")
def stream_last_hour(t: Tables):
    """Counts of the hour before the newest window."""
    counts = status_counts(t)
    return windows.last_hour(counts, counts.agg(F.max("start")).first()[0])


@query("stream_once", "SELECT user_id AS device, event_id FROM events")
def stream_once(t: Tables):
    """Every event comes twice, the second time up to a day later and often in another batch, and passes once."""
    raw = t.table("events")
    copies = raw.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    late = (F.col("user_id") % 3 == 0).cast("long") * 3600 + F.col("copy") * (F.col("event_id") % 24) * 3600
    stream = arrivals(t, "copies", copies.withColumn("_arrival", F.unix_seconds(F.col("ts").cast("timestamp")) + late).drop("copy"))
    rows = stream.select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return stateful.to_files(windows.once(rows, ["device", "event_id"]).select("device", "event_id"), "once")


# -- logs as files --------------------------------------------------------------------------------

#: line kinds: errors are torn, views have no time
LOGGED = f"""WITH {EVENTS}, lg AS (SELECT 'd' || device % 3 AS device, day, ts, base, event_id, event_type, value, event_type NOT IN ('error', 'view') AS good FROM ev)"""


def followed(t: Tables, kind: str, fields: dict):
    """Events written as a log of this kind, in two halves, each followed once: day folders of three devices.

    Errors are torn lines, views lines without a time.
    """
    root, out = scratch_path(t.spark, f"{kind}-log"), scratch_path(t.spark, f"{kind}-followed")
    whole = F.to_json(F.struct(F.col("base").alias("t"), *[c.alias(n) for n, c in fields.items()]))
    no_t = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    line = F.when(F.col("event_type") == "error", F.substring(whole, 1, 12)).when(F.col("event_type") == "view", no_t).otherwise(whole)
    rows = t.events().select(F.concat(F.lit("d"), F.col("device") % 3).alias("device"), "day", "event_id", line.alias("value"))
    for half in (0, 1):
        part = rows.where(F.col("event_id") % 2 == half).drop("event_id").repartition(4, "device", "day")
        part.write.mode("append").partitionBy("device", "day").text(root)
        found = live.follow(t.spark, root, kind, out, file_glob="*.txt")
    return found


@query("live_app_log", LOGGED + """ SELECT device, day, base, epoch_us(ts) // 1000 * 1000 AS ts, event_type AS pkg, CASE WHEN event_id % 3 = 0 THEN 'L' || event_id END AS label
FROM lg WHERE good AND event_type <> 'signup'""")
def live_app_log(t: Tables):
    """Sign-ups lack the package and are no entries."""
    pkg = F.when(F.col("event_type") != "signup", F.col("event_type"))
    label = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("L"), F.col("event_id")))
    return logs.app_entries(followed(t, "apps", {"pkg": pkg, "label": label}).rows).select("device", "day", "base", "ts", "pkg", "label")


@query("live_blackout_log", LOGGED + " SELECT device, day, base, epoch_us(ts) // 1000 * 1000 AS ts, CASE WHEN event_type = 'click' THEN 'start' ELSE 'end' END AS state FROM lg WHERE good")
def live_blackout_log(t: Tables):
    state = F.when(F.col("event_type") == "click", "start").otherwise("end")
    return followed(t, "blackouts", {"state": state}).rows.select("device", "day", "base", "ts", "state")


@query("live_gap_log", LOGGED + " SELECT device, day, base, event_type AS state, CASE WHEN event_id % 5 = 0 THEN 'say \"' || event_id || '\"' || chr(10) END AS reason FROM lg WHERE good")
def live_gap_log(t: Tables):
    """Reasons with quotes and line feeds."""
    reason = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('say "'), F.col("event_id"), F.lit('"\n')))
    return followed(t, "gaps", {"state": F.col("event_type"), "reason": reason}).rows.select("device", "day", "base", "state", "reason")


@query("live_key_log", LOGGED + " SELECT device, day, base, event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'cmd,shift' ELSE '' END AS mods, event_type AS app FROM lg WHERE good")
def live_key_log(t: Tables):
    mods = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("cmd"), F.lit("shift"))).otherwise(F.array().cast("array<string>"))
    rows = followed(t, "keys", {"key": F.col("event_id").cast("string"), "mods": mods, "app": F.col("event_type")}).rows
    return rows.select("device", "day", "base", F.col("key").cast("bigint").alias("key"), F.array_join("mods", ",").alias("mods"), "app")


@query("live_ledger", LOGGED + """ SELECT device, day, CASE WHEN event_type = 'error' THEN 'invalid' ELSE 'no t' END AS reason, count(*) AS n,
  CAST(sum(CASE WHEN event_type = 'error' THEN 12 ELSE length('{"status":"ok","ms":' || event_id || '}') END) AS BIGINT) AS chars FROM lg WHERE NOT good GROUP BY ALL""")
def live_ledger(t: Tables):
    """Bad lines by device and day, whole lines kept."""
    bad = followed(t, "ocr", {"status": F.lit("ok"), "ms": F.col("event_id")}).ledger
    return bad.groupBy("device", "day", "reason").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("sunk_change_log", f"WITH {EVENTS} SELECT 'd' || device % 3 AS device, day, base, event_type AS state FROM ev WHERE event_type IN ('click', 'purchase')")
def sunk_change_log(t: Tables):
    """Change points appended in two goes to day folders, and read back as a log."""
    folder = scratch_path(t.spark, "change-log")
    for kind in ("click", "purchase"):
        rows = t.events().where(F.col("event_type") == kind)
        tables.append_log(rows.select(F.concat(F.lit("d"), F.col("device") % 3).alias("device"), "ts", F.col("base").alias("t"), F.col("event_type").alias("state")), folder)
    lines = logs.raw_lines(t.spark, folder, "*.json")
    return logs.judged(lines, logs.FILES["gaps"][1], None)[0].select("device", "day", "base", "state")


@query("history_days", f"WITH {FRAMES} SELECT device, day, base, status FROM frames WHERE day = '2024-01-01'")
def history_days(t: Tables):
    """Frames of one day from a table partitioned by days."""
    folder = scratch_path(t.spark, "history")
    tables.write_frames(t.frames().select("device", "day", "base", "status"), folder)
    return tables.history(t.spark, folder, ["2024-01-01"]).withColumn("day", F.col("day").cast("string")).select("device", "day", "base", "status")
