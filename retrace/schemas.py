"""Row shapes of the screen-history model."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<INT>": T.ArrayType(T.IntegerType()),
    "ARRAY<BIGINT>": T.ArrayType(T.LongType()),
}


def _struct(columns: str) -> T.StructType:
    """Schema from `name TYPE` pairs; unlike DDL parsing it needs no running session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FRAME = _struct(
    "device STRING, day STRING, base STRING, gen INT, ts TIMESTAMP, path STRING, width INT, height INT, "
    "bytes BIGINT, dark_fraction DOUBLE, mean_lum DOUBLE, text_id BIGINT, lines INT, conf DOUBLE, "
    "ocr_ms INT, status STRING, err STRING, pkg STRING"
)
LINE = _struct("line_id BIGINT, key BIGINT, text STRING")
TEXT = _struct("text_id BIGINT, key BIGINT, line_ids ARRAY<BIGINT>")
LINE_RUN = _struct("line_id BIGINT, first_text BIGINT, last_text BIGINT")
OCR_LOG = _struct(
    "t STRING, gen INT, w INT, h INT, bytes BIGINT, lines INT, ms BIGINT, status STRING, text STRING, err STRING"
)
APP_LOG = _struct("t STRING, pkg STRING, label STRING")
BLACKOUT_LOG = _struct("t STRING, state STRING")
GAP_LOG = _struct("t STRING, state STRING, reason STRING")
KEY_LOG = _struct("t STRING, key STRING, mods ARRAY<STRING>, app STRING")
ACTIVITY = _struct("device STRING, time BIGINT, type STRING, pkg STRING, cls STRING")
ACTIVITY_DUMP = _struct("time BIGINT, type STRING, pkg STRING, cls STRING, instance_id STRING")
SIGNATURE = _struct("device STRING, day STRING, base STRING, sig ARRAY<INT>, mean_lum DOUBLE")
OCR_BOX = _struct("frame_id STRING, text STRING, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE")
BORDER = _struct("frame_id STRING, axis STRING, at DOUBLE, lo DOUBLE, hi DOUBLE")
CANDIDATE = _struct("device STRING, kind STRING, ts TIMESTAMP, session BIGINT, detail STRING, score INT")
