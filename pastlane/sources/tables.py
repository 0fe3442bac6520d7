"""The test tables in the roles of archive, live readings and links."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pastlane.functions.time import ntz
from pastlane.sources.archive import in_range

# The archive is the six days before the live day.
ARCHIVE_START = datetime(2024, 1, 24)
LIVE_START = datetime(2024, 1, 30)
ARCHIVE_DAYS = 6

# Slots are hours, since the readings are sparse; some queries use five minutes.
SLOT_MINUTES = 60
FINE_SLOT_MINUTES = 5

REGION = "POLYGON((-0.2 -0.2, 0.2 -0.2, 0.15 0.15, -0.2 0.2, -0.2 -0.2))"

MORNING = ARCHIVE_START + timedelta(hours=8)
SLOT = timedelta(minutes=SLOT_MINUTES)

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

EMBEDDINGS_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


def to_readings(events: DataFrame) -> DataFrame:
    volume = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        "event_id",
        F.col("user_id").alias("link_id"),
        F.col("value").alias("speed"),
        volume.alias("volume"),
        "ts",
        "event_type",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS_SCHEMA).parquet(os.path.join(sf_dir, "events.parquet"))
    return to_readings(events)


def archive_of(rows: DataFrame) -> DataFrame:
    return in_range(rows, ARCHIVE_START, LIVE_START)


def live_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ts") >= ntz(LIVE_START))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_of(readings(spark, sf_dir))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_of(readings(spark, sf_dir))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(sf_dir, "embeddings.parquet")
    vectors = spark.read.schema(EMBEDDINGS_SCHEMA).parquet(path)
    return vectors.select(
        F.col("vec_id").alias("link_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )
