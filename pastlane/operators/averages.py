"""Averages of the archive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pastlane.functions.numeric import narrowed_speed, whole_volume
from pastlane.functions.time import slot_of_day, slot_start
from pastlane.model import SLOT_KEYS


def _mean(column: str, null_as_zero: bool) -> Column:
    value = F.coalesce(F.col(column), F.lit(0)) if null_as_zero else F.col(column)
    return F.avg(value)


def day_aligned_average(
    rows: DataFrame, instant: datetime, reference_numeric: bool = False
) -> DataFrame:
    """Average by link over rows of one time of day, stamped with that time.

    ``reference_numeric`` gives speeds of four digits in single precision and
    volumes without a fraction.
    """
    speed, volume = F.avg("speed"), F.avg("volume")
    if reference_numeric:
        speed, volume = narrowed_speed(speed), whole_volume(volume)
    return (
        rows.groupBy("link_id")
        .agg(speed.alias("avg_speed"), volume.alias("avg_volume"))
        .withColumns({"hrs": F.lit(instant.hour), "mins": F.lit(instant.minute)})
    )


def slot_aggregate(readings: DataFrame, minutes: int, null_as_zero: bool = False) -> DataFrame:
    """Count and averages by link and time-of-day slot, over all days given."""
    return readings.groupBy("link_id", *slot_of_day("ts", minutes)).agg(
        F.count("*").alias("count_rec"),
        _mean("volume", null_as_zero).alias("avg_volume"),
        _mean("speed", null_as_zero).alias("avg_speed"),
    )


def all_slots_average(rows: DataFrame, minutes: int) -> DataFrame:
    """The day-aligned average of every slot of the day, in one pass."""
    return rows.groupBy("link_id", *slot_of_day("ts", minutes)).agg(
        F.avg("speed").alias("avg_speed"), F.avg("volume").alias("avg_volume")
    )


def link_history(rows: DataFrame) -> DataFrame:
    """Average speed by link; what a live row looks up."""
    return rows.groupBy("link_id").agg(F.avg("speed").alias("hist_avg"))


def day_substreams(readings: DataFrame, first_day: datetime) -> DataFrame:
    """The archive as one sub-stream per day, told apart by ``day_index``."""
    index = F.datediff(F.to_date("ts"), F.lit(first_day.date()))
    return readings.withColumn("day_index", index)


def day_averages(substreams: DataFrame) -> DataFrame:
    return substreams.groupBy("day_index").agg(
        F.count("*").alias("count_rec"),
        F.avg("speed").alias("avg_speed"),
        F.avg("volume").alias("avg_volume"),
    )


def slot_counts(readings: DataFrame, minutes: int) -> DataFrame:
    """Readings and mean speed by link and slot of the calendar."""
    return (
        readings.select("link_id", "speed", slot_start("ts", minutes).alias("slot"))
        .groupBy("link_id", "slot")
        .agg(F.count("*").alias("count_rec"), F.avg("speed").alias("avg_speed"))
    )


def averages_of(aggregate: DataFrame) -> DataFrame:
    """The columns of a slot aggregate that the join needs."""
    return aggregate.select(*SLOT_KEYS, "avg_speed", "avg_volume")
