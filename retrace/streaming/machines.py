"""Per-device state machines. Each turns one row at a time into zero or more output rows.

A machine's state is a small dict of plain values; what there may be many of (activity slots) are named parts, which are
read and written one by one.
"""

from __future__ import annotations

from retrace.functions.text import gram_set, overlap
from retrace.operators.activity import PAUSE_STOP_WINDOW_MS, ResumedCount
from retrace.operators.intervals import GAP_RESOLVERS


class Parts:
    """Named parts kept in memory, as in the state store."""

    def __init__(self):
        self.known = {}

    def get(self, name: str):
        return self.known.get(name)

    def put(self, name: str, value) -> None:
        if value is None:
            self.known.pop(name, None)
        else:
            self.known[name] = value


class State(dict):
    """Plain values, and named parts in `slots`."""

    def __init__(self, values: dict | None = None, slots=None):
        super().__init__(values or {})
        self.slots = Parts() if slots is None else slots


class Machine:
    """Rows come as dicts with `us` (event time in microseconds) and the columns in `columns`, in time order."""

    columns: list[str] = []
    output = ""

    def step(self, state: State, row: dict) -> list[dict]:
        raise NotImplementedError

    def finish(self, state: State, horizon: int) -> list[dict]:
        """Called once per micro-batch and device; all rows before `horizon` were stepped, none before it will come."""
        return []


class ForegroundLog(Machine):
    """A row when the app in front changes or the day rolls; unknown apps and overlays change nothing."""

    columns = ["day", "pkg", "overlay"]
    output = "us bigint, day string, pkg string"

    def step(self, state, row):
        if row["pkg"] is None or row["overlay"]:
            return []
        if (state.get("day"), state.get("pkg")) == (row["day"], row["pkg"]):
            return []
        state.update(day=row["day"], pkg=row["pkg"])
        return [{"us": row["us"], "day": row["day"], "pkg": row["pkg"]}]


class BlackoutLog(Machine):
    """`start` on going dark or staying dark over midnight, `end` on coming back."""

    columns = ["day", "dark"]
    output = "us bigint, day string, state string"

    def step(self, state, row):
        was, before = state.get("dark", False), state.get("day")
        state.update(dark=bool(row["dark"]), day=row["day"])
        if row["dark"] and (not was or (before is not None and before != row["day"])):
            return [{"us": row["us"], "day": row["day"], "state": "start"}]
        if was and not row["dark"]:
            return [{"us": row["us"], "day": row["day"], "state": "end"}]
        return []


class GapLog(Machine):
    """Gap states and their resolvers; on a new day the still active gaps are written again first."""

    columns = ["day", "state", "reason"]
    output = "us bigint, day string, state string, reason string"

    def step(self, state, row):
        active = state.setdefault("active", [])
        name = row["state"]
        closes = next((g for g, r in GAP_RESOLVERS.items() if r == name), None)
        if closes is not None:
            if closes not in active:
                return []
            active.remove(closes)
        elif name in GAP_RESOLVERS:
            if name in active:
                return []
            active.append(name)
        out = []
        if state.get("day") not in (None, row["day"]):
            out = [
                {"us": row["us"], "day": row["day"], "state": gap, "reason": "carried over"}
                for gap in sorted(active)
                if gap != name
            ]
        state["day"] = row["day"]
        return out + [{"us": row["us"], "day": row["day"], "state": name, "reason": row["reason"] or None}]


class ResumedActivities(Machine):
    """Packages in front of a device and whether a sensitive one is among them; reports on change.

    Replayed events count once. Events come in time order, so an older one of a slot never follows a newer one. Plain values:
    the events of the current time, the number of slots in front per package, and slots whose pauses may still be settled; a
    slot that is not in front and has no such pause is forgotten.
    """

    columns = ["type", "pkg", "cls", "sensitive"]
    output = "us bigint, packages array<string>, sensitive array<string>"

    def __init__(self, window_ms: int = PAUSE_STOP_WINDOW_MS, every_event: bool = False):
        self.window_ms, self.every_event = window_ms, every_event

    def step(self, state, row):
        event = f"{row['type']}|{row['pkg']}|{row['cls']}"
        if state.get("us") != row["us"]:
            state["us"], state["seen"] = row["us"], []
        if event in state["seen"]:
            return []
        state["seen"].append(event)
        name, time = f"{row['pkg']}/{row['cls']}", row["us"] // 1000
        slot, before = ResumedCount(self.window_ms), state.slots.get(name)
        if before is not None:
            slot.resume(None, before["pauses"], None, before["counts"])
        was = slot.resumed
        slot.step(time, row["type"])
        _, pauses, _, counts = slot.state()
        state.slots.put(name, {"pauses": pauses, "counts": counts})
        front = state.setdefault("front", {})
        if (was > 0) != (slot.resumed > 0):
            n = front.get(row["pkg"], [0, False])[0] + (1 if slot.resumed > 0 else -1)
            front.pop(row["pkg"], None)
            if n:
                front[row["pkg"]] = [n, bool(row["sensitive"])]
        idle = state.setdefault("idle", {})
        idle.pop(name, None)
        if slot.resumed == 0:
            idle[name] = max([time, *pauses])
        return self._report(state) if self.every_event else []

    def finish(self, state, horizon):
        for name, time in list(state.get("idle", {}).items()):
            if horizon // 1000 - time > self.window_ms:
                state.slots.put(name, None)
                del state["idle"][name]
        return [] if self.every_event or "us" not in state else self._report(state)

    def _report(self, state):
        packages = sorted(state["front"])
        if state.get("packages") == packages:
            return []
        state["packages"] = packages
        return [{"us": state["us"], "packages": packages, "sensitive": sorted(p for p, (_, s) in state["front"].items() if s)}]


class NearDuplicateLog(Machine):
    """Streaming collapse: a row for every frame that is kept; frames like the last kept one only extend it."""

    columns = ["base", "text"]
    output = "us bigint, base string, dwell_before bigint, until_before bigint"

    def __init__(self, threshold: float = 0.90, both_empty: float = 1.0):
        self.threshold, self.both_empty = threshold, both_empty
        self.grams = (None, None)

    def step(self, state, row):
        text = row["text"] or ""
        grams = gram_set(text)
        if "text" in state:
            if self.grams[0] != state["text"]:
                self.grams = (state["text"], gram_set(state["text"]))
            value, _ = overlap(self.grams[1], grams, self.both_empty)
            if value >= self.threshold:
                state["dwell"] += 1
                state["until"] = row["us"]
                return []
        out = {"us": row["us"], "base": row["base"], "dwell_before": state.get("dwell"), "until_before": state.get("until")}
        state.update(text=text, dwell=1, until=row["us"])
        return [out]


class RunningStats(Machine):
    """Count and bytes from signed changes: +n and +bytes per capture, negative per deletion, never below zero after one.

    First and last capture times come from captures only, deletions leave them alone. A row per batch and device.
    """

    columns = ["n", "bytes"]
    output = "us bigint, count bigint, bytes bigint, first bigint, last bigint"

    def step(self, state, row):
        for name, change in (("count", row["n"]), ("bytes", row["bytes"])):
            state[name] = max(state.get(name, 0) + int(change), 0)
        if row["n"] > 0:
            state["first"] = min(state.get("first", row["us"]), row["us"])
            state["last"] = max(state.get("last", row["us"]), row["us"])
        state["us"] = row["us"]
        return []

    def finish(self, state, horizon):
        return [{name: state.get(name) for name in ("us", "count", "bytes", "first", "last")}] if "us" in state else []


class FailureStreak(Machine):
    """A row whenever consecutive failures reach a multiple of the threshold."""

    columns = ["failed", "id"]
    output = "us bigint, id bigint, streak bigint"

    def __init__(self, threshold: int = 10):
        self.threshold = threshold

    def step(self, state, row):
        state["n"] = state.get("n", 0) + 1 if row["failed"] else 0
        if state["n"] and state["n"] % self.threshold == 0:
            return [{"us": row["us"], "id": row["id"], "streak": state["n"]}]
        return []


class Throttle(Machine):
    """Pass an alert when `seconds` went by since the last one that passed."""

    columns = ["id"]
    output = "us bigint, id bigint"

    def __init__(self, seconds: float = 3600):
        self.step_us = int(seconds * 1_000_000)

    def step(self, state, row):
        if "us" in state and row["us"] - state["us"] < self.step_us:
            return []
        state["us"] = row["us"]
        return [{"us": row["us"], "id": row["id"]}]


class Sessions(Machine):
    """Sessions closed by a pause; rows exactly the gap apart share a session."""

    columns = []
    output = "start bigint, end bigint, frames bigint"

    def __init__(self, gap_seconds: float):
        self.gap = int(gap_seconds * 1_000_000)

    def step(self, state, row):
        out = self._close(state, row["us"])
        state.update(start=state.get("start", row["us"]), end=row["us"], frames=state.get("frames", 0) + 1)
        return out

    def finish(self, state, horizon):
        return self._close(state, horizon)

    def _close(self, state, now):
        if "end" not in state or now - state["end"] <= self.gap:
            return []
        return [{name: state.pop(name) for name in ("start", "end", "frames")}]
