"""Queries over archives, usage, quality of frames and of readings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from retrace.functions import captures as C
from retrace.functions import keys as K
from retrace.functions import pixels as P
from retrace.operators import attribution as At
from retrace.operators import dictionary as D
from retrace.operators import layout, reports
from retrace.operators import search as S
from retrace.plans.registry import EVENTS, FRAMES, LINES, SIGNATURES, Tables, query
from retrace.sources import captures as sources
from retrace.session import scratch_path
from retrace.sources import logs, tables

STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'empty' ELSE 'ok' END"
READ = f"""{EVENTS}, rd AS (SELECT *, {STATUS} AS status, CAST(floor(value * 10) AS BIGINT) AS ocr_ms,
  CAST(json_extract(props, '$.k') AS BIGINT) AS lines, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM ev)"""


def readings(t: Tables):
    """Events as read frames: errors failed, views were empty; amount gives time and size, props the lines."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "empty").otherwise("ok")
    return t.events().select(
        "device", "day", "base", "ts", "event_id", "event_type", status.alias("status"),
        F.floor(F.col("value") * 10).cast("bigint").alias("ocr_ms"),
        F.from_json("props", "k BIGINT")["k"].alias("lines"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"),
    )


@query("days", f"WITH {READ} SELECT day, count(*) AS shots FROM rd WHERE status = 'ok' GROUP BY day")
def days(t: Tables):
    return reports.days(readings(t))


@query("day_span", f"""WITH {READ}, d AS (SELECT DISTINCT day FROM rd WHERE status = 'ok')
SELECT count(*) AS days, min(day) AS first_day, count(*) || ' 日分（' || min(day) || '〜）' AS span FROM d""")
def day_span(t: Tables):
    return reports.span(reports.days(readings(t)))


SIZE = """CASE WHEN b < 1000 THEN b || ' bytes' WHEN b < 1000000 THEN printf('%.1f KB', round(b / 1000.0::DOUBLE, 1)) WHEN b < 1000000000 THEN printf('%.1f MB', round(b / 1000000.0::DOUBLE, 1))
  WHEN b < 1000000000000 THEN printf('%.1f GB', round(b / 1000000000.0::DOUBLE, 1)) ELSE printf('%.1f TB', round(b / 1000000000000.0::DOUBLE, 1)) END"""
SPAN = """CASE WHEN s <= 0 THEN '—' WHEN s // 86400 > 0 THEN (s // 86400) || '日と' || (s % 86400 // 3600) || '時間'
  WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || '時間' || (s % 3600 // 60) || '分' ELSE (s % 3600 // 60) || '分' END"""


@query("archive_stats", f"""WITH {READ}, a AS (SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l FROM rd),
x AS (SELECT *, (l - f) // 1000000 AS s FROM a) SELECT n AS count, b AS bytes, f AS first, l AS last, {SIZE} AS size_text, {SPAN} AS duration_text FROM x""")
def archive_stats(t: Tables):
    odd = F.when(F.col("status") != "failed", F.col("ts"))  # failed rows fall back to the file time
    return reports.archive_stats(readings(t).select("bytes", odd.alias("ts"), F.col("ts").alias("modified")))


@query("size_and_duration_texts", f"""WITH {READ}, x AS (SELECT event_id, device, bytes * bytes AS b, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) // 1000000 // 50 AS s, base FROM rd)
SELECT event_id, {SIZE} AS size_text, {SPAN} AS duration_text, substr(base, 1, 2) || ':' || substr(base, 3, 2) || ':' || substr(base, 5, 2) AS clock FROM x""")
def size_and_duration_texts(t: Tables):
    start = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp")
    seconds = F.floor(F.floor((F.unix_micros("ts") - F.unix_micros(start)) / 1_000_000) / 50)
    end = F.timestamp_micros(F.unix_micros(start) + seconds.cast("bigint") * 1_000_000)
    return readings(t).select(
        "event_id", C.format_bytes(F.col("bytes") * F.col("bytes")).alias("size_text"), C.duration_text(start, end).alias("duration_text"),
        C.clock_text(F.col("base")).alias("clock"),
    )


@query("status_report", f"""WITH {READ}, n AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now),
h AS (SELECT status, count(*) AS c FROM rd, n WHERE ts >= now - INTERVAL 1 HOUR GROUP BY status)
SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS frames, epoch_us(max(CASE WHEN status = 'ok' THEN ts END)) AS latest_ok,
  (SELECT string_agg(status || '=' || c, ' ' ORDER BY status) FROM h) AS last_hour FROM rd""")
def status_report(t: Tables):
    out = reports.status_report(readings(t), F.lit(dt.datetime(2024, 1, 15, 12)).cast("timestamp"))
    item = F.transform("last_hour", lambda h: F.concat(h["status"], F.lit("="), h["n"].cast("string")))
    return out.withColumn("last_hour", F.array_join(item, " "))


@query("latest_captures", f"WITH {EVENTS} SELECT device, day, base FROM ev ORDER BY day DESC, base DESC, device DESC LIMIT 50")
def latest_captures(t: Tables):
    return reports.latest(t.events(), 50).select("device", "day", "base")


@query("newest_captures", f"WITH {EVENTS} SELECT device, day, base FROM ev ORDER BY day DESC, base DESC, device DESC LIMIT 50")
def newest_captures(t: Tables):
    """The same from a stored listing that came in two batches: only the newest days are read."""
    folder = scratch_path(t.spark, "listing")
    for half in (0, 1):
        sources.add_to_listing(t.events().where(F.col("event_id") % 2 == half).select("device", "day", "base", "event_id"), folder, half)
    return sources.newest(t.spark, folder, 50).select("device", "day", "base")


@query("backfill_report", f"WITH {READ} SELECT status, count(*) AS n, CAST(sum(ocr_ms) AS DOUBLE) / count(*) AS mean_ms FROM rd GROUP BY status")
def backfill_report(t: Tables):
    return reports.backfill_report(readings(t))


def captures_and_readings(t: Tables):
    captures = t.frames().select("device", "day", "base", "doc_id")
    labels = t.table("labels").select("doc_id", F.when(F.col("quality") == 0, "failed").otherwise("ok").alias("status"))
    return captures, captures.join(labels, "doc_id")


@query("missing_with_retry", f"WITH {FRAMES} SELECT device, day, base, doc_id FROM frames WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)")
def missing_with_retry(t: Tables):
    """Labelled documents are read frames, low quality ones failed reads."""
    captures, read = captures_and_readings(t)
    return reports.missing(captures, read, retry_failed=True)


@query("missing_per_day", f"WITH {FRAMES} SELECT day, count(*) AS remaining FROM frames WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY day")
def missing_per_day(t: Tables):
    captures, read = captures_and_readings(t)
    return reports.missing_per_day(reports.missing(captures, read, retry_failed=False))


@query("secured_frames", f"""WITH {READ} SELECT event_id, status <> 'failed' AS readable, status IN ('ok', 'empty') AS secured,
  ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AS in_range FROM rd""")
def secured_frames(t: Tables):
    rows = readings(t)
    frame = ["device", "day", "base"]
    secured = logs.secured_stems(rows).withColumn("secured", F.lit(True))
    inside = S.in_range(rows.select("event_id", "ts"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6)).select("event_id", F.lit(True).alias("in_range"))
    return rows.join(secured, frame, "left").join(inside, "event_id", "left").select(
        "event_id", (F.col("status") != "failed").alias("readable"),
        F.coalesce("secured", F.lit(False)).alias("secured"), F.coalesce("in_range", F.lit(False)).alias("in_range"),
    )


USAGE = f"""WITH {READ}, fr AS (SELECT CASE WHEN event_type <> 'error' THEN event_type END AS pkg, bytes FROM rd),
lb AS (SELECT event_type AS pkg, max_by(base, {{'ts': ts, 'b': base}}) AS label FROM ev WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1),
ex AS (SELECT n_name AS pkg FROM nation UNION SELECT 'purchase'),
c AS (SELECT pkg, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM fr GROUP BY pkg),
u AS (SELECT coalesce(c.pkg, ex.pkg) AS pkg, coalesce(n, 0) AS n, coalesce(b, 0) AS b, ex.pkg IS NOT NULL AS excluded FROM c FULL JOIN ex ON c.pkg = ex.pkg),
usage AS (SELECT u.pkg, label, n AS count, b AS bytes, excluded, coalesce(label, u.pkg, '不明') AS display_name FROM u LEFT JOIN lb ON u.pkg = lb.pkg)"""


def usage(t: Tables):
    rows = readings(t)
    frames = rows.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("pkg"), "bytes")
    named = rows.where(F.col("event_type").isin("view", "click", "signup"))
    log = named.select(F.col("event_type").alias("pkg"), "ts", F.col("base").alias("label"))
    excluded = t.table("nation").select(F.col("n_name").alias("pkg")).unionByName(frames.where(F.col("pkg") == "purchase").select("pkg").distinct())
    return At.usage(frames, log, excluded)


@query("usage_by_app", USAGE + " SELECT * FROM usage")
def usage_by_app(t: Tables):
    return usage(t)


@query("usage_groups", USAGE + """ SELECT pkg, CASE WHEN excluded AND pkg IS NOT NULL THEN 'excluded' ELSE 'recording' END AS "group", count FROM usage""")
def usage_groups(t: Tables):
    return At.split_groups(usage(t)).select("pkg", "group", "count")


@query("app_filter", USAGE + " SELECT pkg, display_name FROM usage WHERE contains(lower(display_name), 'ati') OR contains(lower(pkg), 'ati')")
def app_filter(t: Tables):
    return At.filter_apps(usage(t), "  ATI ").select("pkg", "display_name")


@query("without_excluded_apps", f"""WITH {FRAMES} SELECT doc_id, device AS pkg FROM frames
WHERE device NOT IN (SELECT 'src' || s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def without_excluded_apps(t: Tables):
    rows = t.frames().select("doc_id", F.col("device").alias("pkg"))
    poor = t.table("supplier").where(F.col("s_acctbal") < 0).select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("pkg"))
    return At.without_excluded(rows, poor)


@query("stored_and_logged", f"""WITH {READ} SELECT 'stored' AS branch, event_id FROM rd WHERE event_type <> 'error' AND bytes > 0
UNION ALL SELECT 'log', event_id FROM rd""")
def stored_and_logged(t: Tables):
    rows = readings(t).withColumn("pkg", F.col("event_type"))
    stored, log = At.stored_frames(rows, F.col("event_type") == "error")
    ids = rows.select("device", "ts", "event_id")
    return stored.select(F.lit("stored").alias("branch"), "event_id").unionByName(
        log.join(ids, ["device", "ts"]).select(F.lit("log").alias("branch"), "event_id")
    )


@query("images_of_unknown_app", f"""WITH {EVENTS}, ch AS (SELECT * FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT e.event_id FROM (SELECT * FROM ev WHERE event_type NOT IN ('signup', 'purchase')) e
ASOF LEFT JOIN ch ON e.device = ch.device AND e.day = ch.day AND e.ts >= ch.ts WHERE ch.event_id IS NULL""")
def images_of_unknown_app(t: Tables):
    from retrace.plans.time_queries import rows_and_changes

    rows, changes = rows_and_changes(t)
    images = At.as_of(rows, changes, "pkg", ["device", "day"], tie=["event_id"])
    return At.images_of_app(images, None).select("event_id")


# -- sources ------------------------------------------------------------------------------------


@query("capture_paths", """SELECT doc_id, day, base, gen, CASE WHEN ok THEN epoch_us(ts) END AS ts FROM (
  SELECT doc_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN ok THEN strftime(ts, '%H%M%S_%g') ELSE 'note' END AS base,
    CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 0 END::BIGINT AS gen, ok, ts
  FROM (SELECT *, TIMESTAMP '2024-01-01' + to_milliseconds(doc_id * 5000 + n_chars) AS ts, source <> 'src7' AS ok FROM documents))""")
def capture_paths(t: Tables):
    """Paths written from documents and parsed back; one source has names outside the convention."""
    suffix = F.when(F.col("lang") == "de", ".g1").when(F.col("lang") == "fr", ".g2").when(F.col("lang") == "es", ".g3").otherwise("")
    ts = F.timestamp_micros((F.lit(1704067200) + F.col("doc_id") * 5) * 1_000_000 + F.col("n_chars") * 1000)
    stem = F.when(F.col("source") == "src7", "note").otherwise(C.stem_of(ts))
    path = F.concat(F.lit("/captures/"), C.day_name(ts), F.lit("/"), stem, suffix, F.lit(".jpg"))
    files = t.table("documents").select("doc_id", path.alias("path"))
    day, base = C.day_of(F.col("path")), C.base_of(F.col("path"))
    return files.select("doc_id", day.alias("day"), base.alias("base"), C.gen_of(F.col("path")).alias("gen"), C.capture_time(day, base).alias("ts"))


@query("tolerant_log", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid' WHEN event_type = 'view' THEN 'no t' ELSE 'row' END AS outcome,
  CASE WHEN event_type NOT IN ('error', 'view') THEN strftime(ts, '%H%M%S_%g') END AS base,
  CASE WHEN event_type NOT IN ('error', 'view') THEN event_type || chr(10) || '"' || props END AS text FROM events""")
def tolerant_log(t: Tables):
    """Events as text-log lines: errors are torn, views lack the time; quotes and newlines survive."""
    ev = t.events()
    text = F.concat("event_type", F.lit('\n"'), "props")
    whole = F.to_json(F.struct(F.col("base").alias("t"), F.lit("ok").alias("status"), text.alias("text")))
    no_t = F.to_json(F.struct(F.lit("ok").alias("status"), text.alias("text")))
    line = F.when(F.col("event_type") == "error", F.substring(whole, 1, 40)).when(F.col("event_type") == "view", no_t).otherwise(whole)
    parsed = logs.parse(ev.select("event_id", line.alias("value")), logs.FILES["ocr"][1])
    outcome = F.when(F.col("reason").isNull(), "row").otherwise(F.substring_index("reason", ":", 1))
    good = F.col("reason").isNull()
    return parsed.select("event_id", outcome.alias("outcome"), F.when(good, F.col("row.t")).alias("base"), F.when(good, F.col("row.text")).alias("text"))


@query("attempted_stems", f"WITH {EVENTS} SELECT DISTINCT day, base FROM ev WHERE event_type <> 'view'")
def attempted_stems(t: Tables):
    """Torn lines still show that their frame was tried."""
    torn = F.concat(F.lit('{"t":"'), "base", F.lit('","gen":0,"text":"half'))
    line = F.when(F.col("event_type") == "view", F.lit('{"status":"ok"}')).otherwise(torn)
    return logs.attempted_stems(t.events().select("day", line.alias("value")))


@query("last_written", f"WITH {EVENTS} SELECT device, event_type, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM ev GROUP BY device, event_type")
def last_written(t: Tables):
    rows = t.events().select("device", "event_type", "event_id", "value")
    return logs.last_written(rows.withColumn("seq", F.col("event_id")), ["device", "event_type"]).drop("seq")


@query("upsert", f"""WITH {FRAMES} SELECT device, day, base, CASE WHEN quality IS NULL THEN status WHEN quality = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN quality IS NULL THEN bytes END AS bytes FROM frames LEFT JOIN labels USING (doc_id)""")
def upsert(t: Tables):
    """A re-read of the labelled frames replaces every column of their rows; each was read twice, the later one counts."""
    stored = t.frames().select("device", "day", "base", "status", "bytes")
    _, fresh = captures_and_readings(t)
    later = fresh.select("device", "day", "base", "status", F.lit(2).alias("seq"))
    earlier = later.withColumns({"status": F.lit("torn"), "seq": F.lit(1)})
    return tables.upsert(stored, later.union(earlier), sequence="seq")


@query("activity_dump", f"""WITH {EVENTS} SELECT DISTINCT device, epoch_us(ts) // 1000000 AS time, CASE event_type WHEN 'click' THEN 'PAUSED' WHEN 'purchase' THEN 'STOPPED' ELSE 'RESUMED' END AS type FROM ev WHERE event_type <> 'error'""")
def activity_dump(t: Tables):
    """Usage-dump lines written from events and parsed back; errors become noise."""
    kind = F.when(F.col("event_type") == "click", "PAUSED").when(F.col("event_type") == "purchase", "STOPPED").otherwise("RESUMED")
    time = F.floor(F.unix_micros("ts") / 1_000_000).cast("string")
    line = F.concat(F.lit("    time="), time, F.lit(" type=ACTIVITY_"), kind, F.lit(" package=p class=c instanceId="), F.col("device").cast("string"))
    noise = F.when(F.col("event_type") == "error", F.lit("  time=12 something else")).otherwise(line)
    rows = logs.parse_dump(t.events().select(noise.alias("value")))
    return rows.select(F.col("instance_id").cast("bigint").alias("device"), F.col("time").cast("bigint").alias("time"), "type")


@query("key_names", """SELECT event_id, CASE CAST(floor(value) AS BIGINT) % 128 WHEN 36 THEN 'return' WHEN 48 THEN 'tab' WHEN 49 THEN 'space' WHEN 51 THEN 'delete' WHEN 53 THEN 'escape' WHEN 76 THEN 'enter'
  WHEN 117 THEN 'forwarddelete' WHEN 123 THEN 'left' WHEN 124 THEN 'right' WHEN 125 THEN 'down' WHEN 126 THEN 'up' WHEN 115 THEN 'home' WHEN 119 THEN 'end' WHEN 116 THEN 'pageup' WHEN 121 THEN 'pagedown'
  WHEN 122 THEN 'f1' WHEN 120 THEN 'f2' WHEN 99 THEN 'f3' WHEN 118 THEN 'f4' WHEN 96 THEN 'f5' WHEN 97 THEN 'f6' WHEN 98 THEN 'f7' WHEN 100 THEN 'f8' WHEN 101 THEN 'f9' WHEN 109 THEN 'f10' WHEN 103 THEN 'f11' WHEN 111 THEN 'f12'
  ELSE CASE WHEN event_type = 'error' THEN 'key' || CAST(floor(value) AS BIGINT) % 128 ELSE substr(event_type, 1, 1) END END AS key,
  array_to_string(list_filter(['cmd', 'opt', 'ctrl', 'shift', 'fn'], lambda m: CAST(floor(value) AS BIGINT) & (CASE m WHEN 'cmd' THEN 16 WHEN 'opt' THEN 8 WHEN 'ctrl' THEN 4 WHEN 'shift' THEN 2 ELSE 128 END) <> 0), '+') AS mods FROM events""")
def key_names(t: Tables):
    code = F.floor("value").cast("bigint") % 128
    chars = F.when(F.col("event_type") == "error", F.lit("\u0003")).otherwise(F.substring("event_type", 1, 1))
    flags = F.floor("value").cast("bigint") * (1 << 16)
    return t.events().select("event_id", K.key_name(code, chars).alias("key"), F.array_join(K.modifiers(flags), "+").alias("mods"))


# -- distributions and quality --------------------------------------------------------------------


@query("percentiles", """WITH d AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
ps(p) AS (VALUES (0.05::DOUBLE), (0.1), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99))
SELECT l_returnflag, p, l_extendedprice FROM d, ps WHERE i = least(n - 1, CAST(floor(n * p) AS BIGINT))""")
def percentiles(t: Tables):
    return reports.order_statistics(t.table("lineitem"), "l_extendedprice", [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99], ["l_returnflag"])


DIFFS = f"""WITH {SIGNATURES}, p AS (SELECT *, lag(sig) OVER (PARTITION BY device, day ORDER BY base) AS b FROM sigs),
df AS (SELECT device, base, sig, CAST(list_sum(list_transform(range(1, len(sig) + 1), lambda i: abs(sig[i] - b[i]))) AS DOUBLE) / len(sig) AS diff FROM p WHERE b IS NOT NULL)"""


@query("adjacent_differences", DIFFS + " SELECT device, base, diff FROM df")
def adjacent_differences(t: Tables):
    return reports.adjacent_differences(t.signatures(), P.mean_abs_diff).select("device", "base", "diff")


LEVELS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 12.0, 14.0, 16.0]


@query("difference_thresholds", DIFFS + f""", t AS (SELECT unnest({LEVELS!r}::DOUBLE[]) AS thr)
SELECT thr, count(*) FILTER (WHERE diff > thr) + 1 AS kept, 100.0::DOUBLE * (count(*) FILTER (WHERE diff > thr) + 1) / count(*) AS pct,
  (count(*) FILTER (WHERE diff > thr) + 1) / 0.5::DOUBLE / 3600 AS hours FROM df, t GROUP BY thr""")
def difference_thresholds(t: Tables):
    return reports.difference_thresholds(reports.adjacent_differences(t.signatures(), P.mean_abs_diff), LEVELS)


@query("signature_brightness", f"""WITH {SIGNATURES} SELECT base, CAST(list_sum(sig) AS DOUBLE) / len(sig) / 255.0::DOUBLE AS mean_lum,
  CAST(len(list_filter(sig, lambda v: v < 120)) AS DOUBLE) / len(sig) AS dark FROM sigs""")
def signature_brightness(t: Tables):
    return t.signatures().select("base", P.mean_luminance(F.col("sig")).alias("mean_lum"), P.dark_fraction(F.col("sig"), 120).alias("dark"))


CUBE = "range(0, 1024)"


BLACK_FRAMES = f"""WITH {SIGNATURES}, px AS (SELECT base, list_transform(range(0, 1024), lambda i: CASE WHEN sig[i // 16 + 1] > 140 THEN 17 ELSE 16 END) AS g FROM sigs),
c AS (SELECT base, cell, max(g[i + 1]) AS m FROM (SELECT base, g, unnest(range(0, 1024)) AS i, (i // 32 // 8) * 4 + (i % 32 // 8) AS cell FROM px) GROUP BY ALL)
SELECT base, CAST(count(*) FILTER (WHERE m <= 16) AS DOUBLE) / count(*) >= 0.85 AS uninformative FROM c GROUP BY base"""


@query("uninformative_frames", BLACK_FRAMES)
def uninformative_frames(t: Tables):
    return drawn(t).select("base", P.uninformative(F.col("px"), F.lit(32), F.lit(32)).alias("uninformative"))


@query("uninformative_frames_bytes", BLACK_FRAMES)
def uninformative_frames_bytes(t: Tables):
    """The same frames with their pixels as bytes."""
    raw = drawn(t).select("base", P.packed(F.col("px"), F.lit(4)).alias("px"))
    return raw.select("base", P.uninformative_bytes(F.col("px"), F.lit(32), F.lit(32)).alias("uninformative"))


@query("adjacent_differences_bytes", DIFFS + " SELECT device, base, diff FROM df")
def adjacent_differences_bytes(t: Tables):
    """Signatures as bytes: what crosses from row to row is a byte a cell."""
    raw = t.signatures().withColumn("sig", P.packed(F.col("sig"), F.lit(1)))
    return reports.adjacent_differences(raw, P.mean_abs_diff_bytes).select("device", "base", "diff")


def drawn(t: Tables):
    """Signatures drawn as 32x32 gray frames: a value above 140 lights sixteen pixels just enough to count."""
    return t.signatures().select("base", drawn_pixels(F.col("sig")).alias("px"))


def drawn_pixels(sig):
    """64 runs of sixteen pixels; values that are missing leave theirs black. No lambda uses another one's variable."""
    values = F.slice(F.concat(F.coalesce(sig, F.array().cast("array<int>")), F.array_repeat(F.lit(0), 64)), 1, 64)
    gray = lambda v: F.when(v > 140, 17).otherwise(16)
    return F.flatten(F.transform(F.transform(values, gray), lambda g: F.array_repeat(g * 65536 + g * 256 + g, 16)))


@query("latency_profile", f"""WITH {READ}, o AS (SELECT ocr_ms, row_number() OVER (ORDER BY ocr_ms) - 1 AS i, count(*) OVER () AS n FROM rd)
SELECT count(*) AS n, round(regr_slope(ocr_ms, lines), 6) AS ms_per_line, round(regr_intercept(ocr_ms, lines), 6) AS base_ms,
  (SELECT max(ocr_ms) FROM o WHERE i = n // 2) AS median_ms, (SELECT max(ocr_ms) FROM o WHERE i = CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) AS p90_ms FROM rd""")
def latency_profile(t: Tables):
    out = reports.latency_profile(readings(t))
    return out.withColumns({c: F.round(c, 6) for c in ("ms_per_line", "base_ms")})


def two_readings(t: Tables):
    """Documents read twice: the second reading loses sentence ends, and its last line."""
    b = F.regexp_replace(F.regexp_replace("text", r"[.,]", ""), r"\n[^\n]*$", "")
    return t.table("documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("text_a"), b.alias("text_b"), F.col("lang").alias("gen"))


TWO = """two AS (SELECT doc_id AS frame_id, text AS text_a, regexp_replace(regexp_replace(text, '[.,]', '', 'g'), '\\n[^\\n]*$', '') AS text_b, lang AS gen FROM documents)"""


@query("character_coverage", f"""WITH {TWO}, c AS (SELECT list_filter(string_split(regexp_replace(text_a, '\\s+', '', 'g'), ''), lambda x: x <> '') AS a,
  list_distinct(list_filter(string_split(regexp_replace(text_b, '\\s+', '', 'g'), ''), lambda x: x <> '')) AS b FROM two)
SELECT CAST(sum(len(list_filter(a, lambda x: list_contains(b, x)))) AS BIGINT) AS kept, CAST(sum(len(a)) AS BIGINT) AS total,
  CAST(sum(len(list_filter(a, lambda x: list_contains(b, x)))) AS DOUBLE) / CAST(sum(len(a)) AS DOUBLE) AS coverage FROM c""")
def character_coverage(t: Tables):
    return reports.character_coverage(two_readings(t))


@query("layout_effect", f"""WITH {TWO} SELECT frame_id, CAST(len(list_filter(string_split(text_a, chr(10)), lambda s: s <> '')) AS BIGINT) AS old_lines,
  CAST(len(list_filter(string_split(text_b, chr(10)), lambda s: s <> '')) AS BIGINT) AS new_lines, CAST(len(string_split(text_b, chr(10) || chr(10))) AS BIGINT) AS regions,
  CASE WHEN gen = 'en' AND frame_id % 3 <> 0 THEN 1 ELSE 0 END AS cut FROM two""")
def layout_effect(t: Tables):
    return reports.layout_effect(two_readings(t), layout.cut_counts(*bordered(t)))


def bordered(t: Tables):
    """A box 120 wide per document, high unless it is English, and a border through two of three."""
    docs = t.table("documents").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("text"), "lang")
    middle = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: (i - 0.5) * 120.0 / F.length("text"))
    high = F.when(F.col("lang") == "en", 10.0).otherwise(30.0)
    boxes = docs.select("frame_id", "text", F.lit(0.0).alias("x"), F.lit(100.0).alias("y"), F.lit(120.0).alias("w"), high.alias("h"), middle.alias("char_x"))
    at = (F.lit(10) + F.col("frame_id") % 100).cast("double")
    borders = docs.where(F.col("frame_id") % 3 != 0).select("frame_id", F.lit("v").alias("axis"), at.alias("at"), F.lit(0.0).alias("lo"), F.lit(1000.0).alias("hi"))
    return boxes, borders


@query("cut_boxes", """WITH b AS (SELECT doc_id AS frame_id, source AS text, lang = 'en' AND doc_id % 3 <> 0 AS cut, CAST(10 + doc_id % 100 AS DOUBLE) AS border FROM documents),
k AS (SELECT *, CASE WHEN cut THEN len(list_filter(range(1, length(text) + 1), lambda i: (i - 0.5) * 120.0 / length(text) <= border)) ELSE length(text) END AS k FROM b)
SELECT frame_id, substr(text, 1, k) AS text, 0.0::DOUBLE AS x, CASE WHEN k < length(text) THEN border ELSE 120.0 END AS w FROM k WHERE k > 0
UNION ALL SELECT frame_id, substr(text, k + 1), border, 120.0 - border FROM k WHERE k < length(text)""")
def cut_boxes(t: Tables):
    """Characters on the two sides of a border."""
    return layout.cut_boxes(*bordered(t)).select("frame_id", "text", "x", "w")


@query("version_diff", f"""WITH {TWO}, o AS (SELECT frame_id, text_a AS text, gen FROM two WHERE gen <> 'de'), n AS (SELECT frame_id, text_b AS text, gen FROM two WHERE gen <> 'fr')
SELECT coalesce(o.frame_id, n.frame_id) AS frame_id, CASE WHEN n.frame_id IS NULL THEN 'only_old' WHEN o.frame_id IS NULL THEN 'only_new' ELSE 'changed' END AS side,
  CASE WHEN o.frame_id IS NOT NULL AND n.frame_id IS NOT NULL THEN 'text' END AS columns
FROM o FULL JOIN n ON o.frame_id = n.frame_id WHERE o.frame_id IS NULL OR n.frame_id IS NULL OR o.text IS DISTINCT FROM n.text""")
def version_diff(t: Tables):
    two = two_readings(t)
    old = two.where(F.col("gen") != "de").select("frame_id", F.col("text_a").alias("text"), "gen")
    new = two.where(F.col("gen") != "fr").select("frame_id", F.col("text_b").alias("text"), "gen")
    return reports.compare_versions(old, new, ["frame_id"]).withColumn("columns", F.array_join("columns", ","))


def turns(t: Tables):
    """Conversation turns read twice: the later reading misses every full stop."""
    text = F.col("text")
    return t.table("conversations").select(F.col("role").alias("gen"), text.alias("text_a"), F.regexp_replace(text, r"[.e]", "").alias("text_b"))


@query("text_survival", """WITH p AS (SELECT role AS gen, text AS text_a, regexp_replace(text, '[.e]', '', 'g') AS text_b FROM conversations),
l AS (SELECT *, list_filter(string_split(text_a, chr(10)), lambda s: s <> '') AS a, list_filter(string_split(text_b, chr(10)), lambda s: s <> '') AS b FROM p),
m AS (SELECT *, list_filter(a, lambda x: len(list_filter(b, lambda y: 1.0::DOUBLE - CAST(levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y)) >= 0.85)) > 0) AS k FROM l)
SELECT gen, CAST(sum(len(b)) AS DOUBLE) / count(*) AS mean_lines, CAST(sum(least(length(text_a), length(text_b))) AS DOUBLE) / CAST(sum(length(text_a)) AS DOUBLE) AS kept_chars,
  CAST(sum(len(k)) AS DOUBLE) / CAST(sum(len(a)) AS DOUBLE) AS matched_lines FROM m GROUP BY gen""")
def text_survival(t: Tables):
    return reports.text_survival(turns(t))


RARE = f"""WITH {FRAMES}, {LINES}, l AS (SELECT DISTINCT device, day, epoch_us(ts) // 600000000 AS win, line FROM lines_all WHERE status = 'ok')"""


@query("rare_lines", RARE + " SELECT device, day, line, count(*) AS windows FROM l GROUP BY ALL HAVING count(*) <= 2")
def rare_lines(t: Tables):
    return reports.rare_lines(t.frames())[0]


@query("evaluation_windows", RARE + """, w AS (SELECT device, win, CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM l GROUP BY ALL HAVING sum(length(line) + 1) >= 3000)
SELECT * FROM w ORDER BY md5('7|' || device || '|' || win), device, win LIMIT 25""")
def evaluation_windows(t: Tables):
    return reports.rare_lines(t.frames())[1]


@query("stratified_sample", f"""WITH {FRAMES}, n AS (SELECT device, base, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM frames),
b AS (SELECT *, (row_number() OVER (ORDER BY lines, device, base) - 1) * 5 // count(*) OVER () AS stratum FROM n)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || device || '|' || base), device, base) <= 12""")
def stratified_sample(t: Tables):
    lines = F.size(D.split_lines("text"))
    return reports.stratified_sample(t.frames().withColumn("lines", lines), 5, 12).select("device", "base", "lines", "stratum")


@query("retrieval_metrics", f"""WITH {FRAMES}, {LINES},
m AS (SELECT line AS query, device || '/' || (epoch_us(ts) // 600000000) AS item, max(ts) AS seen, min(pkg) AS pkg FROM lines_all GROUP BY 1, 2),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY seen DESC, item) AS rank FROM m),
c AS (SELECT query, min(pkg) AS class FROM m GROUP BY query),
rel AS (SELECT DISTINCT line AS query, device || '/' || (epoch_us(ts) // 600000000) AS item FROM lines_all JOIN labels USING (doc_id) WHERE quality = 1),
best AS (SELECT query, min(rank) AS b FROM r JOIN rel USING (query, item) GROUP BY query)
SELECT class, count(*) AS queries, CAST(count(*) FILTER (WHERE b <= 5) AS DOUBLE) / count(*) AS hit,
  round(sum(CASE WHEN b <= 10 THEN 1.0::DOUBLE / b ELSE 0.0::DOUBLE END) / count(*), 9) AS mrr FROM c LEFT JOIN best USING (query) GROUP BY class""")
def retrieval_metrics(t: Tables):
    """Every line as an exact query; windows ranked by its latest sight; windows of good documents are relevant."""
    frames = t.frames()
    item = F.concat_ws("/", "device", C.window_id(F.col("ts")).cast("string")).alias("item")
    lines = frames.where(F.col("text") != "").select(
        F.explode(D.split_lines("text")).alias("query"), item, "ts", F.col("pkg").alias("class"), "doc_id"
    )
    per_item = lines.groupBy("query", "item").agg(F.max("ts").alias("seen"), F.min("class").alias("class"))
    w = Window.partitionBy("query").orderBy(F.desc("seen"), "item")
    # ranks beyond the tenth never count, so a line seen everywhere sends ten rows per task at most
    ranked = per_item.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)
    classes = per_item.groupBy("query").agg(F.min("class").alias("class"))
    good = t.table("labels").where(F.col("quality") == 1).select("doc_id")
    relevant = lines.join(good, "doc_id", "left_semi").select("query", "item")
    out = reports.retrieval_metrics(ranked.drop("class").join(classes, "query"), relevant)
    return out.withColumn("mrr", F.round("mrr", 9))


# -- layout --------------------------------------------------------------------------------------


def page_boxes(t: Tables):
    """Each document as a screen of two panes: its first half of lines left, the rest right of a divider."""
    lines = F.filter(D.split_lines("text"), lambda s: F.trim(s) != "")
    rows = t.table("documents").select(F.col("doc_id").cast("string").alias("frame_id"), lines.alias("lines")).where(F.size("lines") > 0)
    half = F.ceil(F.size("lines") / 2).cast("int")
    placed = rows.select("frame_id", half.alias("half"), F.posexplode("lines").alias("pos", "text"))
    left = F.col("pos") < F.col("half")
    boxes = placed.select(
        "frame_id", F.trim("text").alias("text"),
        F.when(left, 10.0).otherwise(210.0).alias("x"),
        (F.when(left, F.col("pos")).otherwise(F.col("pos") - F.col("half")) * 20.0 + 20.0).alias("y"),
        F.lit(160.0).alias("w"), F.lit(16.0).alias("h"), F.lit(None).cast("array<double>").alias("char_x"),
    )
    borders = rows.select(
        "frame_id", F.lit("v").alias("axis"), F.lit(200.0).alias("at"), F.lit(0.0).alias("lo"), (half * 20.0 + 60.0).alias("hi")
    )
    return boxes, borders


@query("layout_text", """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS frame_id, list_transform(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), lambda s: trim(s)) AS ls FROM documents),
h AS (SELECT *, CAST(ceil(len(ls) / 2.0) AS BIGINT) AS half FROM l WHERE len(ls) > 0)
SELECT frame_id, array_to_string(ls[1:half], chr(10)) || CASE WHEN len(ls) > half THEN chr(10) || chr(10) || array_to_string(ls[half + 1:], chr(10)) ELSE '' END AS text,
  CAST(len(ls) AS BIGINT) AS lines FROM h""")
def layout_text(t: Tables):
    return layout.emit_text(layout.read_layout(*page_boxes(t)))


@query("ingest_report", f"""WITH {READ} SELECT 'frames' AS metric, CAST(count(*) AS VARCHAR) AS value FROM rd WHERE status <> 'failed'
UNION ALL SELECT 'apps', CAST(count(*) AS VARCHAR) FROM rd WHERE event_type = 'signup'
UNION ALL SELECT 'unresolved', CAST(count(*) AS VARCHAR) FROM rd WHERE event_type = 'click'
UNION ALL SELECT 'bad', CAST(count(*) AS VARCHAR) FROM rd WHERE status = 'failed'
UNION ALL SELECT 'first_day', min(day) FROM rd WHERE status <> 'failed' UNION ALL SELECT 'last_day', max(day) FROM rd WHERE status <> 'failed'""")
def ingest_report(t: Tables):
    rows = readings(t)
    shots = rows.where(F.col("status") != "failed").withColumn("pkg", F.when(F.col("event_type") != "click", F.col("event_type")))
    sources_ = {"frames": shots, "apps": rows.where(F.col("event_type") == "signup")}
    return reports.ingest_report(sources_, shots, rows.where(F.col("status") == "failed"))


@query("remote_listing", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey || '.jpg' AS name, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderstatus <> 'P'""")
def remote_listing(t: Tables):
    """Orders as uploaded files; pending ones are unfinished."""
    suffix = F.when(F.col("o_orderstatus") == "P", ".jpg.tmp").otherwise(".jpg")
    path = F.concat(F.lit("/r/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.col("o_orderkey").cast("string"), suffix)
    return sources.remote_listing(t.table("orders").select(path.alias("path"), F.floor("o_totalprice").cast("bigint").alias("length")))
