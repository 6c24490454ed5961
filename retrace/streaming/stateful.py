"""Run a per-device machine over a stream in event-time order, and drive streams to files.

Every device has a horizon of its own: the time of its newest row less a delay. Rows wait in state until the horizon has
passed their time slice and are then stepped in order, so rows may come shuffled within the delay and a device that uploads
an hour after the others loses nothing. A row that comes after its slice was stepped is kept as a late row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from retrace.session import scratch_path
from retrace.streaming.machines import Machine, State

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = 50_000  # rows of one device in memory; what comes beyond them waits in the state store
CHUNK = 2_000  # rows in one entry of the state store
FEW = 200  # so many waiting rows stay in the device's own entry, which is read and written once a batch
DELAY_MS, SLICE_MS = 60_000, 60_000


class Waiting:
    """Rows of one device that wait for their time slice: some in memory, the rest as chunks in the state store.

    `counts` has the number of stored chunks per slice. A slice is read back when its turn comes, so memory holds HELD rows
    and one slice. `few` are the rows that `rest` gave out after the last batch.
    """

    def __init__(self, chunks, counts: dict[int, int], width: int, few: list = ()):
        self.chunks, self.counts, self.width = chunks, counts, width
        self.held: dict[int, list] = {}
        self.n = 0
        for row in few:
            self.add(row)

    def add(self, row: list) -> None:
        self.held.setdefault(row[0] // self.width, []).append(row)
        self.n += 1
        if self.n >= HELD:
            self.store()

    def store(self) -> None:
        for slice_, rows in self.held.items():
            for at in range(0, len(rows), CHUNK):
                number = self.counts.get(slice_, 0)
                self.chunks.updateValue((slice_, number), (json.dumps(rows[at : at + CHUNK]),))
                self.counts[slice_] = number + 1
        self.held, self.n = {}, 0

    def rest(self) -> list:
        """FEW rows at most, to be kept with the device; more of them are stored as chunks."""
        few = [row for rows in self.held.values() for row in rows]
        if len(few) <= FEW:
            return few
        self.store()
        return []

    def released(self, before: int) -> Iterator[list]:
        """Rows of all slices before `before`, in order; they wait no longer."""
        for slice_ in sorted(s for s in {*self.held, *self.counts} if s < before):
            rows = self.held.pop(slice_, [])
            for number in range(self.counts.pop(slice_, 0)):
                rows += json.loads(self.chunks.getValue((slice_, number))[0])
                self.chunks.removeKey((slice_, number))
            rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
            yield from rows


class Slots:
    """Named parts of a machine's state. Each is read when it is asked for and written when it changed."""

    def __init__(self, store):
        self.store, self.known, self.changed = store, {}, set()

    def get(self, name: str):
        if name not in self.known:
            found = self.store.getValue((name,))
            self.known[name] = json.loads(found[0]) if found is not None else None
        return self.known[name]

    def put(self, name: str, value) -> None:
        """None takes the part out."""
        self.known[name] = value
        self.changed.add(name)

    def save(self) -> None:
        for name in self.changed:
            if self.known[name] is None:
                if self.store.containsKey((name,)):
                    self.store.removeKey((name,))
            else:
                self.store.updateValue((name,), (json.dumps(self.known[name]),))


class MachineProcessor(StatefulProcessor):
    """Feeds the rows of each device to the machine, slice by slice behind the device's horizon."""

    def __init__(self, machine: Machine, key: str, delay_ms: int, slice_ms: int):
        self.machine, self.key = machine, key
        self.delay, self.width = delay_ms * 1000, slice_ms * 1000
        self.columns = ["us", "tie", *machine.columns]
        self.names = [part.split(" ")[0] for part in machine.output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one entry per device, since every call to the state store is a message to another process
        self.device = handle.getValueState("device", "newest long, released long, chunks string, few string, json string")
        self.chunks = handle.getMapState("waiting", "slice long, number int", "rows string")
        self.parts = handle.getMapState("parts", "name string", "json string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, released, chunks, few, own = self.device.get() or (None, None, "{}", "[]", "{}")
        waiting = Waiting(self.chunks, {int(s): n for s, n in json.loads(chunks).items()}, self.width, json.loads(few))
        out, at = Row(self.key, *self.names, "late_row"), None
        for row in rows:
            at = at or [row.__fields__.index(c) for c in self.columns]
            values = [row[i] for i in at]
            if released is not None and values[0] < released:
                yield out(key[0], *[None] * len(self.names), json.dumps(dict(zip(self.columns, values))))
                continue
            newest = values[0] if newest is None else max(newest, values[0])
            waiting.add(values)
        state = State(json.loads(own), Slots(self.parts))
        if newest is not None:
            before = (newest - self.delay) // self.width
            for values in waiting.released(before):
                for found in self.machine.step(state, dict(zip(self.columns, values))):
                    yield out(key[0], *[found.get(n) for n in self.names], None)
            released = before * self.width if released is None else max(released, before * self.width)
            for found in self.machine.finish(state, released):
                yield out(key[0], *[found.get(n) for n in self.names], None)
        few = json.dumps(waiting.rest())
        self.device.update((newest, released, json.dumps(waiting.counts), few, json.dumps(state)))
        state.slots.save()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Start from history read in batch: rows before its newest one count as late from then on."""
        start = json.loads(initialState["json"])
        for name, part in start["parts"].items():
            self.parts.updateValue((name,), (json.dumps(part),))
        self.device.update((start["newest"], start["newest"], "{}", "[]", json.dumps(start["own"])))

    def close(self) -> None:
        pass


def _machine_rows(rows: DataFrame, machine: Machine, key: str, tie: str | None) -> DataFrame:
    return rows.select(key, F.unix_micros("ts").alias("us"), (F.col(tie) if tie else F.lit(0)).alias("tie"), *machine.columns).where("us is not null")


def run_machine(
    stream: DataFrame, machine: Machine, key: str = "device", tie: str | None = None, initial: DataFrame | None = None, delay_ms: int = DELAY_MS, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Stateful stream over `stream(key, ts, machine columns)`: the key, the machine's output, and `late_row`.

    Rows are stepped in order of time and `tie` once their device has sent a row that is `delay_ms` newer than the end of
    their slice. Later ones come out as JSON in `late_row`, with nulls in the machine's columns. Rows without a time are
    left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = _machine_rows(stream, machine, key, tie)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(machine.output).fields, T.StructField("late_row", T.StringType())])
    return rows.groupBy(key).transformWithState(
        MachineProcessor(machine, key, delay_ms, slice_ms),
        outputStructType=schema,
        outputMode="append",
        timeMode="none",
        initialState=initial.groupBy(key) if initial is not None else None,
    )


def bootstrap_state(history: DataFrame, machine: Machine, key: str = "device", tie: str | None = None) -> DataFrame:
    """(key, json) state after a stretch of history read in batch, e.g. the last six hours before the stream."""
    rows = _machine_rows(history, machine, key, tie)
    schema = T.StructType([rows.schema[key], T.StructField("json", T.StringType())])
    columns = [key, "us", "tie", *machine.columns]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, newest = None, None, None

        def done() -> pd.DataFrame:
            machine.finish(state, newest)
            return pd.DataFrame([(current, json.dumps({"own": state, "parts": state.slots.known, "newest": newest}))], columns=[key, "json"])

        for pdf in batches:
            for values in zip(*[pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in columns]):
                if state is None or values[0] != current:
                    if state is not None:
                        yield done()
                    current, state = values[0], State()
                newest = int(values[1])
                machine.step(state, dict(zip(columns[1:], values[1:])) | {"us": newest})
        if state is not None:
            yield done()

    return rows.repartition(key).sortWithinPartitions(key, "us", "tie").mapInPandas(fold, schema)


class Written(NamedTuple):
    """Rows a stream has written, and the late ones as (key, late_row)."""

    rows: DataFrame
    late: DataFrame


def drive(stream: DataFrame, label: str) -> Written:
    """Process everything available into a Parquet folder (append mode): rows and late rows apart, in one sink."""
    spark = stream.sparkSession
    folder = scratch_path(spark, label)
    late = F.col("late_row").isNotNull() if "late_row" in stream.columns else F.lit(False)
    query = (
        stream.withColumn("late", late).writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("late")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType())])
    found = spark.read.schema(schema).parquet(f"{folder}/rows")
    rows = found.where("not late").drop("late", "late_row")
    return Written(rows, found.where("late").select(stream.columns[0], *[c for c in ("late_row",) if c in stream.columns]))


def to_files(stream: DataFrame, label: str) -> DataFrame:
    return drive(stream, label).rows


def add_batches(stream: DataFrame, group: Callable[[DataFrame], DataFrame], keys: list[str], label: str) -> DataFrame:
    """Drive a stream whose result is a sum over its rows: `group` sums a batch, the batches' sums are added when read.

    Nothing is kept in state and no row is too late. A batch that is tried again overwrites its own folder.
    """
    spark = stream.sparkSession
    folder = scratch_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        group(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").drop("batch")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def open_table(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
