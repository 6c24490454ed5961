"""Text expressions: line keys, whitespace, shingles, similarity, snippets, signals."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHINGLE = 4

# Whitespace as Unicode defines it, plus the four ASCII separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"
# What `\s` means in the SQL of the queries.
ASCII_SPACES = r"[\t\n\f\r ]+"

# Interest-signal categories and their keywords.
SIGNALS = {
    "買い物": ["カートに追加", "カートに入れる", "ご注文", "お届け", "レジに進む", "購入手続き",
               "在庫あり", "セール", "クーポン", "送料無料"],
    "予約・移動": ["予約する", "空席", "出発", "到着", "経路", "運賃", "チェックイン",
                   "分後", "乗換"],
    "エラー・詰まり": ["エラー", "失敗しました", "接続できません", "もう一度お試し",
                       "問題が発生", "読み込めません", "タイムアウト"],
    "健康": ["体重", "体脂肪", "BMI", "kg", "睡眠", "歩数", "kcal", "トレーニング"],
    "お金": ["請求", "支払い", "残高", "入金", "振込", "料金", "円/月", "解約"],
    "仕事・開発": ["エラーが発生", "ビルド", "commit", "pull request", "デプロイ",
                   "issue", "TODO", "締切", "納期"],
    "人間関係": ["ありがとう", "ごめん", "おめでとう", "お疲れ", "既読", "返信"],
}


def text_key(text: Column) -> Column:
    """First eight bytes of SHA-256 as a signed integer; equal keys still need equal text."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("bigint")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), "^ | $", "")


def strip_all(text: Column, spaces: str = SPACES) -> Column:
    return F.regexp_replace(text, spaces, "")


def let(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`; inside lambdas a plain column is evaluated per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; empty when the text is shorter than n."""

    def from_chars(chars: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(chars) - n)
        joined = F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
        return F.when(F.size(chars) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(joined))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), from_chars)


def shingles(text: Column, n: int = SHINGLE, spaces: str = SPACES) -> Column:
    """Distinct character n-grams of the text without whitespace; short text is its own gram."""

    def of(s: Column) -> Column:
        short = F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))
        return F.when(F.length(s) < n, short).otherwise(grams(s, n))

    return let(strip_all(F.coalesce(text, F.lit("")), spaces), of)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Set similarity. `both_empty` is 1.0 when collapsing frames, 0.0 when looking for triggers."""
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(float(both_empty)))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def loss(a: Column, ref: Column) -> Column:
    """Share of the grams of `a` that `ref` does not hold."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_except(a, ref)) / F.size(a))


def contains_term(text: Column, term: str) -> Column:
    """Substring rule: three characters and more ignore case, shorter terms do not."""
    if len(term) >= 3:
        return F.contains(F.lower(text), F.lower(F.lit(term)))
    return F.contains(text, F.lit(term))


def snippet(text: Column, query: str) -> Column:
    """First line holding the query, else the first three non-empty lines."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: s != "")
    head = F.array_join(F.slice(lines, 1, 3), " / ")
    if not query:
        return head
    hits = F.filter(lines, lambda s: F.contains(F.lower(s), F.lower(F.lit(query))))
    return F.when(F.size(hits) > 0, F.element_at(hits, 1)).otherwise(head)


def signals(text: Column, categories: dict[str, list[str]] | None = None) -> Column:
    """Names of all categories of which the text holds a keyword, in declaration order."""
    parts = []
    for name, words in (categories or SIGNALS).items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        parts.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*parts))


_TERM = re.compile(r'\A\s*"(?P<phrase>.*)"\s*\Z|(?P<word>\S+)', re.DOTALL)


def split_terms(query: str) -> list[str]:
    """Terms of a query: what stands between its outer double quotes if it has them, else its words. Empty ones are none."""
    found = (m["phrase"] if m["word"] is None else m["word"] for m in _TERM.finditer(query))
    return [term for term in found if term]


_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def parse_time(value: str | None, now: dt.datetime | None = None) -> dt.datetime | None:
    """A moment written as ISO date or time, or as an age such as `-10m`, `-2h`, `-1d`; nothing written means open."""
    written = (value or "").strip()
    unit = _UNITS.get(written[-1:])
    if unit and written.startswith("-") and written[1:-1].isdecimal():
        age = dt.timedelta(**{unit: int(written[1:-1])})
        return (now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) - age
    return dt.datetime.fromisoformat(written) if written else None


def gram_set(text: str | None, n: int = SHINGLE) -> frozenset[str]:
    """Worker-side twin of `shingles`: windows of n characters of the text without white space, or all of it if shorter."""
    bare = re.sub(r"\s+", "", text or "")
    windows = (bare[at : at + n] for at in range(max(len(bare) - n, 0) + 1))
    return frozenset(filter(None, windows))


_SHIFTS = np.array([48, 32, 16, 0], dtype=np.uint64)
_SHORT, _WIDE = np.uint64(0xD800 << 48), np.uint64(0xDC00 << 48)  # no text begins with these units
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(text: str | None) -> np.ndarray:
    """The grams of `gram_set` as sorted distinct numbers: four 16-bit characters, or the whole of a shorter text.

    Grams with characters beyond 16 bits go by 58 bits of a hash, in a range no other gram is in.
    """
    bare = "".join((text or "").split())
    if not bare:
        return np.empty(0, dtype=np.uint64)
    units = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    short = len(units) < SHINGLE
    if short:
        units = np.concatenate([units, np.zeros(SHINGLE - len(units), dtype=np.uint64)])
    columns = [units[k : len(units) - SHINGLE + 1 + k] for k in range(SHINGLE)]
    if short:
        columns = [_SHORT >> _SHIFTS[0] | np.uint64(len(bare)) + columns[0] * np.uint64(0), *columns[:3]]
    found = columns[0] << _SHIFTS[0]
    for column, shift in zip(columns[1:], _SHIFTS[1:]):
        found |= column << shift
    if units.max() > 0xFFFF:
        wide = np.max(columns, axis=0) > 0xFFFF
        mixed = np.zeros(int(wide.sum()), dtype=np.uint64)
        for column in columns:
            mixed = (mixed ^ column[wide]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        found[wide] = _WIDE | mixed >> np.uint64(6)
    found = np.sort(found)
    return found[np.append(True, found[1:] != found[:-1])]


def shared_ids(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted arrays of distinct ones share."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def overlap(a: frozenset[str], b: frozenset[str], both_empty: float) -> tuple[float, int]:
    """Worker-side twin of `jaccard`: similarity of two gram sets and the number of grams they share."""
    union = len(a | b)
    shared = len(a) + len(b) - union
    return (shared / union if union else both_empty), shared
