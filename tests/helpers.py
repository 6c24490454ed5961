import datetime as dt


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def frames(spark, rows, device="d"):
    """Rows (day, stem, text, status) as frames."""
    from pyspark.sql import functions as F

    from retrace.functions.captures import capture_time

    df = spark.createDataFrame([(device, *r) for r in rows], "device string, day string, base string, text string, status string")
    return df.withColumn("ts", capture_time(F.col("day"), F.col("base")))


def tuples(df, *columns, order=True):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=repr) if order else rows


FORCED = {"slice_rows": 40}
