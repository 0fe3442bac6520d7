"""Schemas of the readings, averages and dimension."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ARCHIVE_SCHEMA = _struct(
    ("link_id", T.LongType()),
    ("speed", T.DoubleType()),
    ("volume", T.IntegerType()),
    ("ts", T.TimestampNTZType()),
)

# ``event_time`` is the text form of the reading's time, see functions.time.
LIVE_SCHEMA = _struct(
    ("link_id", T.LongType()),
    ("ts", T.TimestampNTZType()),
    ("speed", T.FloatType()),
    ("volume", T.FloatType()),
    ("event_time", T.StringType()),
)

LINK_SCHEMA = _struct(
    ("link_id", T.LongType()),
    ("x", T.DoubleType()),
    ("y", T.DoubleType()),
)

# One average per link and time of day.
SLOT_KEYS = ["link_id", "hrs", "mins"]

# Columns of a joined row without the evaluation time, which is wall clock.
JOINED_COLUMNS = [
    "link_id", "speed", "volume", "hist_link_id", "avg_speed", "avg_volume", "ts",
]
