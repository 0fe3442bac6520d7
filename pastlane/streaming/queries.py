"""Streaming forms of the joins, slots, rates and latest values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pastlane.functions.time import slot_of_day, slot_start
from pastlane.model import SLOT_KEYS
from pastlane.operators.filters import of_region
from pastlane.operators.joins import live_archive_join, live_history_lookup
from pastlane.operators.metrics import period_counts
from pastlane.operators.windows import latest_per_key, latest_per_slot
from pastlane.streaming.run import BatchFunction, run_batches, run_totals, start_query

def write_profile(averages: DataFrame, path: str) -> str:
    """Writes the averages once, by hour, so that a micro-batch reads only its hours."""
    averages.hint("rebalance", "hrs").write.mode("overwrite").partitionBy("hrs").parquet(path)
    return path


def _slot_hours(rows: DataFrame, minutes: int) -> list[int]:
    """The hours of the day at which the rows' slots start, at most 24."""
    hours = rows.select(*slot_of_day("ts", minutes)).select("hrs").distinct()
    return [row.hrs for row in hours.collect()]


def joining(profile: DataFrame, minutes: int, links: DataFrame | None = None, wkt: str = "") -> BatchFunction:
    """Live rows of a micro-batch, in the region if one is given, with the profile."""

    def step(rows: DataFrame, batch_id: int) -> DataFrame:
        hours = _slot_hours(rows, minutes)
        live = of_region(rows, links, wkt) if links is not None else rows
        return live_archive_join(live, profile.where(F.col("hrs").isin(hours)), minutes)

    return step


def live_join_stream(
    live: DataFrame,
    profile: DataFrame,
    out: str,
    checkpoint: str,
    minutes: int,
    links: DataFrame | None = None,
    wkt: str = "",
) -> DataFrame:
    """Each live row with the average of its link and time of day.

    The profile is complete, so nothing depends on which side comes first, and
    only live rows make output.
    """
    schema = live_archive_join(_empty_like(live), profile, minutes).schema
    step = joining(profile, minutes, links, wkt)
    return run_batches(live, out, checkpoint, schema, transform=step).drop("batch")


def subscribe_joined(
    live: DataFrame,
    profile: DataFrame,
    subscriber: Callable[[DataFrame, int], None],
    checkpoint: str,
    minutes: int,
    links: DataFrame | None = None,
    wkt: str = "",
    once: bool = True,
) -> StreamingQuery:
    """Hands the joined rows of every micro-batch to ``subscriber(rows, batch_id)``.

    The rows have the time of evaluation, ``eval_ts``, as their last column. A
    micro-batch can come twice after a failure, with the same id.
    """
    step = joining(profile, minutes, links, wkt)

    def deliver(rows: DataFrame, batch_id: int) -> None:
        kept = rows.persist()
        try:
            subscriber(step(kept, batch_id).withColumn("eval_ts", F.current_timestamp()), batch_id)
        finally:
            kept.unpersist()

    return start_query(live, deliver, checkpoint, once=once)


def _empty_like(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def live_lookup_stream(live: DataFrame, history: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Each live row with the average of its link, or null."""
    schema = live_history_lookup(_empty_like(live), history).schema
    return run_batches(
        live, out, checkpoint, schema,
        transform=lambda rows, _: live_history_lookup(rows, history),
    ).drop("batch")


def passthrough(live: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The readings as they came, through Spark's own file sink."""
    query = (
        live.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return live.sparkSession.read.schema(live.schema).parquet(out)


def slot_counts_stream(
    readings: DataFrame, out: str, checkpoint: str, minutes: int, **compaction
) -> DataFrame:
    """Readings and mean speed by link and slot of the calendar; late readings count as others do."""
    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy("link_id", slot_start("ts", minutes).alias("slot")).agg(
            F.count("*").alias("count_rec"), F.sum(F.col("speed").cast("double")).alias("sum_speed"),
            F.count("speed").alias("n_speed"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("link_id", "slot").agg(
            *[F.sum(name).alias(name) for name in ("count_rec", "sum_speed", "n_speed")])

    schema = partial(_empty_like(readings)).schema
    totals = run_totals(readings, out, checkpoint, partial, merge, schema, **compaction)
    return totals.select(
        "link_id", "slot", "count_rec", F.try_divide("sum_speed", "n_speed").alias("avg_speed"))


def period_counts_stream(
    readings: DataFrame, out: str, checkpoint: str, seconds: int, **compaction
) -> DataFrame:
    """Rows per period, for periods that have any."""
    def partial(rows: DataFrame) -> DataFrame:
        return period_counts(rows, seconds)

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start").agg(F.sum("n").alias("n"))

    schema = partial(_empty_like(readings)).schema
    return run_totals(readings, out, checkpoint, partial, merge, schema, **compaction)


def latest_per_slot_stream(
    readings: DataFrame, out: str, checkpoint: str, minutes: int, arrival: str = "event_id", **compaction
) -> DataFrame:
    """The last reading to arrive of each link and time of day, by ``arrival``."""
    def partial(rows: DataFrame) -> DataFrame:
        return latest_per_slot(rows, minutes, arrival)

    schema = partial(_empty_like(readings)).schema
    values = [name for name in schema.names if name not in (*SLOT_KEYS, arrival)]

    def merge(parts: DataFrame) -> DataFrame:
        return latest_per_key(parts, SLOT_KEYS, values, arrival)

    return run_totals(readings, out, checkpoint, partial, merge, schema, **compaction)
