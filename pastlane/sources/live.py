"""Live readings as streaming frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pastlane.functions.time import parse_time
from pastlane.model import LIVE_SCHEMA


@dataclass(frozen=True)
class StreamSource:
    schema: StructType
    path: str
    format: str = "parquet"


def find_stream(registry: dict[str, StreamSource], name: str) -> StreamSource:
    """Looks a stream up by name, in any case."""
    by_name = {key.lower(): source for key, source in registry.items()}
    if name.lower() not in by_name:
        raise KeyError(f"no stream named {name!r}; there are {sorted(by_name)}")
    return by_name[name.lower()]


# What a micro-batch may read. Operators with keyed state hold a group's rows of one micro-batch in a task.
BYTES_PER_TRIGGER = 256 << 20


def open_stream(
    spark: SparkSession, source: StreamSource, files_per_trigger: int | None = None, bytes_per_trigger: int = BYTES_PER_TRIGGER
) -> DataFrame:
    """Files that appear under the path: as many per micro-batch as ``bytes_per_trigger`` allows, or ``files_per_trigger``.

    One file is read as a whole.
    """
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.format(source.format).schema(source.schema).option(*limit).load(source.path)


def open_kafka(spark: SparkSession, servers: str, topic: str, rows_per_trigger: int) -> DataFrame:
    """Live readings as JSON values of a topic; needs Spark's Kafka connector."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", rows_per_trigger)
        .load()
    )
    return live_from_json(records)


def live_from_json(records: DataFrame, value: str = "value") -> DataFrame:
    """Typed readings from text records; the time may come as ``event_time`` only."""
    parsed = records.select(F.from_json(F.col(value).cast("string"), LIVE_SCHEMA).alias("r"))
    rows = parsed.select("r.*")
    return rows.withColumn("ts", F.coalesce("ts", parse_time("event_time")))
