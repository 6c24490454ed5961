import datetime as dt
import time


import numpy as np
from pyspark.sql import functions as F

from helpers import at
from retrace.functions import captures as C
from retrace.functions import keys as K
from retrace.functions import pixels as P
from retrace.functions import text as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_key_constants(spark):
    row = one(spark, a=X.text_key(F.lit("")), c=X.text_key(F.lit("日本語の行")))
    assert tuple(row) == (-2039914840885289964, 3654332203032423421)


def test_capture_path(spark):
    p = F.lit("/r/2026-08-13/162303_273.g2.jpg")
    q = F.lit("/r/notadate/whatever.jpg")
    row = one(spark, day=C.day_of(p), base=C.base_of(p), gen=C.gen_of(p), ts=C.capture_time(C.day_of(p), C.base_of(p)),
              odd=C.capture_time(C.day_of(q), C.base_of(q)), gen0=C.gen_of(q))
    assert tuple(row) == ("2026-08-13", "162303_273", 2, dt.datetime(2026, 8, 13, 16, 23, 3, 273000), None, 0)


def test_clock_duration_bytes(spark):
    a = F.lit(at("2026-08-13T10:00")).cast("timestamp")
    b = F.lit(at("2026-08-16T14:00")).cast("timestamp")
    size = lambda n: C.format_bytes(F.lit(n).cast("bigint"))
    row = one(spark, c=C.clock_text(F.lit("093015_123")), s=C.clock_text(F.lit("0930")), d=C.duration_text(a, b), e=C.duration_text(a, a),
              x=size(999), y=size(1500), z=size(7_300_000_000))
    assert tuple(row) == ("09:30:15", "0930", "3日と4時間", "—", "999 bytes", "1.5 KB", "7.3 GB")


def test_parse_time_and_terms():
    now = dt.datetime(2026, 10, 21, 14, 30)
    assert X.parse_time("-2h", now) == dt.datetime(2026, 10, 21, 12, 30)
    assert X.parse_time("2026-10-21") == dt.datetime(2026, 10, 21)
    assert X.parse_time("") is None
    assert X.split_terms('"a b"') == ["a b"] and X.split_terms(" a  b ") == ["a", "b"] and X.split_terms("  ") == []


def test_shingles_and_jaccard(spark):
    sh = lambda s: X.shingles(F.lit(s))
    row = one(spark, a=sh("ab c d e"), b=sh("a b"), c=sh(" 　\n"), j=X.jaccard(sh("abcde"), sh("bcdef"), 1.0),
              e1=X.jaccard(sh(""), sh(""), 1.0), e0=X.jaccard(sh(""), sh(""), 0.0), l=X.loss(sh("abcdef"), sh("abcd")))
    assert sorted(row.a) == ["abcd", "bcde"] and row.b == ["ab"] and row.c == []
    assert row.j == 1 / 3 and (row.e1, row.e0) == (1.0, 0.0) and row.l == 2 / 3


def test_snippet_and_signals(spark):
    text = F.lit("first\n\nSecond hit\nthird\nfourth")
    row = one(spark, hit=X.snippet(text, "HIT"), head=X.snippet(text, "zzz"), s=X.signals(F.lit("commit して エラーが発生")))
    assert (row.hit, row.head) == ("Second hit", "first / Second hit / third")
    assert row.s == ["エラー・詰まり", "仕事・開発"]


def test_term_case_rule(spark):
    row = one(spark, a=X.contains_term(F.lit("TypeError"), "typeerror"), b=X.contains_term(F.lit("TypeError"), "ty"))
    assert tuple(row) == (True, False)


def test_keys(spark):
    row = one(spark, a=K.key_name(F.lit(36), F.lit("\r")), b=K.key_name(F.lit(8), F.lit("c")), c=K.key_name(F.lit(200), F.lit("\u0001")),
              m=K.modifiers(F.lit((1 << 20) | (1 << 17) | (1 << 16))))
    assert tuple(row) == ("return", "c", "key200", ["cmd", "shift"])


W, H = 135, 300
BLACK, NEAR, GRAY, WHITE = -16777216, 0xFF060606 - (1 << 32), 0xFF808080 - (1 << 32), -1


def canvas(color=BLACK, rows=(), rects=()):
    px = [color] * (W * H)
    for lo, hi, c in rows:
        for i in range(lo * W, hi * W):
            px[i] = c
    for x0, y0, x1, y1, c in rects:
        for y in range(y0, y1):
            for x in range(x0, x1):
                px[y * W + x] = c
    return px


def test_uninformative(spark):
    scattered = [(c * 8, r * 8, c * 8 + 5, r * 8 + 2, WHITE) for r in range(2, 36) for c in range(1, 16)]
    cases = {
        "black": (canvas(), True),
        "white": (canvas(WHITE), False),
        "bars": (canvas(rows=[(0, 13, GRAY), (H - 8, H, GRAY)]), True),
        "dark mode": (canvas(rects=scattered), False),
        "video": (canvas(rows=[(80, 220, GRAY)]), False),
        "near black": (canvas(NEAR), True),
    }
    df = spark.createDataFrame([(n, px) for n, (px, _) in cases.items()], "name string, px array<int>")
    got = {r.name: r.u for r in df.select("name", P.uninformative(F.col("px"), F.lit(W), F.lit(H)).alias("u")).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}
    raw = df.select("name", P.packed("px", F.lit(4)).alias("px"))
    got = {r.name: r.u for r in raw.select("name", P.uninformative_bytes("px", F.lit(W), F.lit(H)).alias("u")).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}
    odd = spark.createDataFrame([(None, 8, 8), (b"", 8, 8), (bytes(4 * 64), 8, 8), (bytes(4 * 63), 8, 8), (bytes(4), 0, 1), (bytes(4), None, 1)], "px binary, w int, h int")
    assert [r.u for r in odd.select(P.uninformative_bytes("px", "w", "h").alias("u")).collect()] == [False, False, True, False, False, False]


def test_drawn_frames_are_packed_every_time(spark):
    from retrace.plans.catalog import QUERIES
    from retrace.plans.report_queries import drawn_pixels

    want = sorted(map(tuple, QUERIES["uninformative_frames"](spark, "/root/testdata/sf0.001").collect()))
    for _ in range(3):
        assert sorted(map(tuple, QUERIES["uninformative_frames_bytes"](spark, "/root/testdata/sf0.001").collect())) == want
    df = spark.createDataFrame([(1, [0, 141, None]), (2, None), (3, [255] * 70)], "id int, sig array<int>")
    lit = {r.id: [p & 255 for p in r.px] for r in df.select("id", drawn_pixels(F.col("sig")).alias("px")).collect()}
    assert lit == {1: [16] * 16 + [17] * 16 + [16] * 992, 2: [16] * 1024, 3: [17] * 1024}


def test_whole_screens_take_little_time():
    screen = np.full((2400, 1080), NEAR & 0xFFFFFFFF, dtype="<u4")
    screen[::7, ::11] = WHITE & 0xFFFFFFFF
    raw, start = screen.tobytes(), time.perf_counter()
    assert all(P._black_share(raw, 1080, 2400) < 0.85 for _ in range(10))
    assert time.perf_counter() - start < 10  # twenty a second on an idle core


def test_signature_difference(spark):
    a, b = F.array(F.lit(0), F.lit(10)), F.array(F.lit(4), F.lit(4))
    row = one(spark, d=P.mean_abs_diff(a, b), bad=P.mean_abs_diff(a, F.array(F.lit(1))), lum=P.mean_luminance(a), dark=P.dark_fraction(a))
    assert tuple(row) == (5.0, 255.0, 10 / 2 / 255.0, 0.5)
