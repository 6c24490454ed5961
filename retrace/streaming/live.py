"""Follow JSON-lines logs as they grow: good rows and bad-row ledger as two outputs of one streaming query."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from retrace.sources import logs


class Followed(NamedTuple):
    rows: DataFrame
    ledger: DataFrame


def follow(spark: SparkSession, root: str, kind: str, out: str, device: str | None = None, file_glob: str | None = None, files_per_batch: int = 1000) -> Followed:
    """Process all log files that are new since the last call with the same `out`, and return everything followed so far.

    A file is read once, when it is first seen, so writers add files instead of lengthening them (`tables.append_log` does).
    Folders are `<device>/<day>/`, plain or as partition folders; `file_glob` stands in for the kind's file name. A batch
    that is tried again overwrites its own two folders.
    """
    file_name, schema = logs.FILES[kind]
    text = (
        spark.readStream.option("pathGlobFilter", file_glob or file_name)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(root)
    )

    def write(batch: DataFrame, number: int) -> None:
        for part, name in zip(logs.judged(logs.in_order(batch), schema, device), Followed._fields):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    query = logs.located(text).writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return Followed(*[spark.read.parquet(f"{out}/{name}").drop("batch") for name in Followed._fields])
