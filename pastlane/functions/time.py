"""Slots, time of day and the text form of timestamps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# The text forms of a time in the configuration and in live rows.
CONFIG_FORMAT = "dd-MMM-yyyy HH:mm:ss"
EVENT_FORMAT = "dd-MMM-yyyy HH:mm:ss.SSS"


def slot_start(ts: str, minutes: int) -> Column:
    """Start of the slot that holds ``ts``; a row at a slot's end is in the next one."""
    return F.window(ts, f"{minutes} minutes")["start"]


def time_of_day(ts: str | Column) -> list[Column]:
    """``hrs`` and ``mins`` of a time."""
    return [F.hour(ts).alias("hrs"), F.minute(ts).alias("mins")]


def slot_of_day(ts: str, minutes: int) -> list[Column]:
    """``hrs`` and ``mins`` of the slot's start, the join key that repeats every day."""
    if 1440 % minutes:
        raise ValueError(f"slots of {minutes} minutes do not fill a day")
    if 60 % minutes == 0:
        first = F.minute(ts) - F.minute(ts) % minutes
        return [F.hour(ts).alias("hrs"), (first if minutes < 60 else F.lit(0)).alias("mins")]
    start = minute_of_day(F.hour(ts), F.minute(ts))
    start = start - start % minutes
    return [F.floor(start / 60).cast("int").alias("hrs"), (start % 60).alias("mins")]


def minute_of_day(hrs: Column, mins: Column) -> Column:
    return hrs * 60 + mins


def parse_time(text: str | Column, pattern: str = EVENT_FORMAT) -> Column:
    return F.to_timestamp_ntz(text, F.lit(pattern))


def format_time(ts: str | Column, pattern: str = EVENT_FORMAT) -> Column:
    return F.date_format(ts, pattern)


def day_aligned_instants(start: datetime, days: int) -> list[datetime]:
    """The same time of day on ``days`` consecutive days."""
    return [start + timedelta(days=n) for n in range(days)]


def ntz(at: datetime) -> Column:
    """A literal without time zone, so comparing it with ``ts`` needs no cast."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
