"""Operators give the same rows when every key counts as hot and is cut into slices."""

import pytest

from retrace.operators import ordered
from test_queries import FOLDER, SQL, QUERIES, canonical, duck  # noqa: F401

NAMES = ["asof_app", "app_runs", "state_intervals", "attribution_audit", "retention_phone", "near_dup_collapse", "cooldown",
         "percentiles", "timeline_windows", "resumed_counts", "failure_streak", "blackout_by_app", "event_sessions", "gap_intervals"]


ROWS = {"near_dup_collapse": 4, "timeline_windows": 4, "resumed_counts": 2}  # rows of a slice


@pytest.mark.parametrize("name", NAMES)
def test_sliced_query(spark, duck, monkeypatch, name):  # noqa: F811
    plain, cuts = ordered.Ordered.of, []

    def forced(df, keys, order, by=None, slice_rows=0, like=None):
        out = plain(df, keys, order, by, ROWS.get(name, 15), like)
        cuts.append(out.sliced)
        return out

    monkeypatch.setattr(ordered.Ordered, "of", staticmethod(forced))
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert any(cuts)


@pytest.mark.parametrize("name", ["sessions_by_pause", "adjacent_similarity"])
def test_neither_texts_of_whole_devices_nor_grams_meet_in_a_task(spark, duck, monkeypatch, name):  # noqa: F811
    plain, seen = ordered.Ordered.of, []

    def watched(df, keys, order, by=None, slice_rows=ordered.SLICE_ROWS, like=None):
        seen.append((set(df.columns), slice_rows))
        return plain(df, keys, order, by, min(slice_rows, 7), like)

    monkeypatch.setattr(ordered.Ordered, "of", staticmethod(watched))
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert all("g" not in columns and ("text" not in columns or rows <= 20_000) for columns, rows in seen)
