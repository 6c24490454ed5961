"""Resumed activities from activity events: counting per activity slot, truth by instance, and their comparison."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.operators.folds import ordered_fold
from retrace.operators.ordered import Ordered
from retrace.session import materialise

PAUSE_STOP_WINDOW_MS = 10_000
OVERLAP_MS = 5_000


class ResumedCount:
    """Resumed instances of one activity class: a stop settles a recent pause, else it ends a resumed one."""

    inputs = ["time", "type"]
    outputs = "resumed bigint"

    def __init__(self, window_ms: int | None = PAUSE_STOP_WINDOW_MS):
        self.window_ms = window_ms
        self.reset()

    def reset(self):
        # pauses that may still be settled, rising; without a window none ever leaves, and their number is enough
        self.resumed, self.last, self.pauses, self.waiting = 0, None, deque(), 0

    def resume(self, text, us, ident, n):
        self.reset()
        if n is None:
            return
        self.pauses = deque(int(p) for p in us)
        self.resumed, self.last, self.waiting = int(n[0]), int(n[1]), int(n[2]) if len(n) > 2 else 0

    def state(self):
        if self.last is None:
            return (None, None, None, None)
        return (None, list(self.pauses), None, [self.resumed, self.last] + [self.waiting] * (self.window_ms is None))

    def step(self, time, kind):
        if time is None or self.last is not None and time < self.last:
            return (self.resumed,)
        self.last = time
        if self.window_ms is not None:
            while self.pauses and time - self.pauses[0] > self.window_ms:
                self.pauses.popleft()
        if kind == "RESUMED":
            self.resumed += 1
        elif kind == "PAUSED":
            self.resumed = max(0, self.resumed - 1)
            if self.window_ms is None:
                self.waiting += 1
            else:
                self.pauses.append(time)
        elif kind == "STOPPED":
            if self.pauses:
                self.pauses.popleft()
            elif self.waiting:
                self.waiting -= 1
            else:
                self.resumed = max(0, self.resumed - 1)
        return (self.resumed,)


class ResumedCounts:
    """`ResumedCount` for several pause windows at once: resumed_0, resumed_1, ..."""

    inputs = ResumedCount.inputs

    def __init__(self, windows: list[int | None]):
        self.counts = [ResumedCount(w) for w in windows]
        self.outputs = ", ".join(f"resumed_{i} bigint" for i in range(len(windows)))

    def reset(self):
        for count in self.counts:
            count.reset()

    def resume(self, text, us, ident, n):
        """`n` holds resumed, last, waiting and the number of pauses of every window, `us` the pauses of all."""
        self.reset()
        if n is None:
            return
        end = 0
        for i, count in enumerate(self.counts):
            *numbers, pauses = n[4 * i : 4 * i + 4]
            count.resume(None, us[end : end + pauses], None, numbers)
            end += pauses

    def state(self):
        if self.counts[0].last is None:
            return (None, None, None, None)
        numbers = [x for c in self.counts for x in (c.resumed, c.last, c.waiting, len(c.pauses))]
        return (None, [p for c in self.counts for p in c.pauses], None, numbers)

    def step(self, time, kind):
        return [count.step(time, kind)[0] for count in self.counts]


SLOT = ["device", "pkg", "cls"]


def counted(events: DataFrame, window_ms: int | None = PAUSE_STOP_WINDOW_MS, **layout) -> DataFrame:
    """Events (device, seq, time, type, pkg, cls) with the resumed count of their slot afterwards."""
    o = Ordered.of(events, SLOT, ["time", "seq"], by="time", **layout)
    return ordered_fold(o, ResumedCount(window_ms), ["time", "seq", "type"])


def _layout(events: DataFrame, **layout) -> Ordered:
    """Rows per device, counted before anything is folded: if no device is cut, no slot or package of one is."""
    return Ordered.of(events, ["device"], ["seq"], by="seq", **layout)


def _presence(points: DataFrame, slot: list[str], on, **layout) -> DataFrame:
    """(device, pkg, seq, present): whether any slot of the package is on after the event."""
    steps = points.withColumn("_delta", on.cast("bigint"))
    steps = _moved(steps, slot, ["_delta"], **layout).select("device", "pkg", "seq", "_delta")
    total = Ordered.of(steps, ["device", "pkg"], ["seq"], by="seq", **layout).running_sum(_n=F.col("_delta"))
    return total.done().select("device", "pkg", "seq", (F.col("_n") > 0).alias("present"))


def _moved(points: DataFrame, slot: list[str], columns: list[str], **layout) -> DataFrame:
    """Replace 0 or 1 in `columns` by the change against the slot's event before."""
    o = Ordered.of(points, ["device", "pkg", *slot], ["seq"], by="seq", **layout).lag(**{f"_was{c}": c for c in columns})
    changes = {c: F.col(c) - F.coalesce(F.col(f"_was{c}"), F.lit(0)) for c in columns}
    return o.done().withColumns(changes).drop(*[f"_was{c}" for c in columns])


def resumed_by_package(events: DataFrame, window_ms: int | None = PAUSE_STOP_WINDOW_MS, **layout) -> DataFrame:
    return _presence(counted(events, window_ms, **layout), ["cls"], F.col("resumed") > 0, **layout)


def true_by_package(events: DataFrame, **layout) -> DataFrame:
    """Packages in front according to instance ids: an instance is on from RESUMED to its next other event."""
    return _presence(events, ["instance_id"], F.col("type") == "RESUMED", **layout)


def sensitive_changes(events: DataFrame, sensitive: DataFrame, **layout) -> DataFrame:
    """Moments at which some sensitive package starts or stops being in front of a device."""
    own = events.join(sensitive.select("pkg").distinct(), "pkg", "left_semi")
    layout = {**layout, "like": _layout(own, **layout)}
    marked = resumed_by_package(own, **layout)
    if layout["like"].sliced:
        marked = materialise(marked)  # its layouts are counted
    return _any_package(marked, **layout)


def _any_package(marked: DataFrame, **layout) -> DataFrame:
    o = Ordered.of(marked, ["device", "pkg"], ["seq"], by="seq", **layout).lag(_was="present")
    delta = F.col("present").cast("bigint") - F.coalesce(F.col("_was"), F.lit(False)).cast("bigint")
    moves = o.done().withColumn("_delta", delta).where(F.col("_delta") != 0).select("device", "seq", "_delta")
    # events of one device at one position move at most one package
    total = Ordered.of(moves, ["device"], ["seq"], by="seq", **layout).running_sum(_n=F.col("_delta"))
    front = total.map(lambda d: d.withColumn("sensitive", F.col("_n") > 0)).lag(_before="sensitive").done()
    changed = F.col("sensitive") != F.coalesce(F.col("_before"), F.lit(False))
    return front.where(changed).select("device", "seq", "sensitive")


def evaluate(events: DataFrame, windows: list[int | None], **layout) -> DataFrame:
    """Per pause window and package: events at which it was wrongly counted as, or missed from, the front.

    Both views are step functions over event numbers; the length of the steps on which they disagree is the
    number of events concerned, so no per-event package sets are built. One fold counts for all windows, and the truth
    goes along in the same rows.
    """
    layout = {**layout, "like": _layout(events, **layout)}
    named = events.where(F.col("device").isNotNull() & F.col("pkg").isNotNull())
    o = Ordered.of(named, SLOT, ["time", "seq"], by="time", **layout)
    rows = ordered_fold(o, ResumedCounts(windows), ["seq", "type", "instance_id"])
    if layout["like"].sliced:
        rows = materialise(rows)  # its layouts are counted
    got = [f"_got{i}" for i in range(len(windows))]
    on = {g: (F.col(f"resumed_{i}") > 0).cast("bigint") for i, g in enumerate(got)}
    rows = rows.select("device", "pkg", "cls", "instance_id", "seq", *[c.alias(n) for n, c in on.items()],
                       (F.col("type") == "RESUMED").cast("bigint").alias("_want"))
    rows = _moved(_moved(rows, ["cls"], got, **layout), ["instance_id"], ["_want"], **layout)
    rows = rows.select("device", "pkg", "seq", *got, "_want")
    total = Ordered.of(rows, ["device", "pkg"], ["seq"], by="seq", **layout)
    step = total.running_sum(**{f"_n{c}": F.col(c) for c in [*got, "_want"]}).lead(_next="seq").done()
    step = step.where(F.col("seq").isNotNull())

    def wrong(i: int) -> tuple[Column, Column]:
        is_on, wanted = F.col(f"_n_got{i}") > 0, F.col("_n_want") > 0
        return is_on & ~wanted, ~is_on & wanted

    # a package's last step ends with the device, which is added once per package
    length, last = F.coalesce(F.col("_next"), F.lit(0)) - F.col("seq"), F.col("_next").isNull()
    sides = [(f"{side}{i}", found) for i in range(len(windows)) for side, found in zip(("extra", "missed"), wrong(i))]
    sums = [F.sum(F.when(found, length).otherwise(0)).alias(name) for name, found in sides]
    ends = [F.sum(F.when(found & last, 1).otherwise(0)).alias(f"_{name}") for name, found in sides]
    ended = events.groupBy("device").agg((F.max("seq") + 1).alias("_end"))
    per_device = step.groupBy("device", "pkg").agg(*sums, *ends).join(ended, "device")
    counts = per_device.groupBy("pkg").agg(*[F.sum(F.col(n) + F.col(f"_{n}") * F.col("_end")).alias(n) for n, _ in sides])
    one = [F.struct(F.col(f"extra{i}").alias("extra"), F.col(f"missed{i}").alias("missed"), F.lit(w).cast("bigint").alias("window_ms"))
           for i, w in enumerate(windows)]
    return counts.select("pkg", F.inline(F.array(*one)))


def worst_packages(evaluation: DataFrame, k: int = 3) -> DataFrame:
    """Totals per window setting and its worst packages on each side."""
    long = evaluation.select("window_ms", "pkg", F.inline(F.array(
        F.struct(F.lit("extra").alias("side"), F.col("extra").alias("n")),
        F.struct(F.lit("missed").alias("side"), F.col("missed").alias("n")),
    )))
    w = Window.partitionBy("window_ms", "side")
    ranked = long.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "pkg"))).where(F.col("rank") <= k)
    totals = long.groupBy("window_ms", "side").agg(F.sum("n").alias("total"))
    null_safe = (F.col("window_ms").eqNullSafe(F.col("_w"))) & (F.col("side") == F.col("_s"))
    renamed = totals.select(F.col("window_ms").alias("_w"), F.col("side").alias("_s"), "total")
    return ranked.where(F.col("n") > 0).join(F.broadcast(renamed), null_safe).drop("_w", "_s")  # two rows per window
