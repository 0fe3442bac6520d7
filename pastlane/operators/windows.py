"""Data windows of the stream engine as relational operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from pastlane.functions.numeric import bucket_of
from pastlane.functions.time import minute_of_day, ntz, slot_start
from pastlane.model import SLOT_KEYS
from pastlane.operators.hot import PIECE_ROWS, with_position
from pastlane.operators.joins import with_slot_keys

# Rows of a full batch (one per archive day) and the percentage
# above which a change of rate counts.
BATCH_ROWS = 6
RATE_CHANGE_PERCENT = 20


def latest_per_key(
    rows: DataFrame, keys: list[str], values: list[str], arrival: str = "event_id"
) -> DataFrame:
    """The row of each key that arrived last replaces those before it.

    ``arrival`` is any column that orders rows by arrival, and no two rows of a key have
    the same: of two that have, values may come from either.
    """
    return rows.groupBy(*keys).agg(
        F.max(arrival).alias(arrival),
        *[F.max_by(value, arrival).alias(value) for value in values],
    )


def latest_per_slot(readings: DataFrame, minutes: int, arrival: str = "event_id") -> DataFrame:
    keyed = with_slot_keys(readings, minutes)
    values = [name for name in ("speed", "volume", "ts") if name != arrival]
    return latest_per_key(keyed, SLOT_KEYS, values, arrival)


def batch_number(position: Column, size: int) -> Column:
    return F.call_function("div", position, F.lit(size))


def batch_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and sums of a batch, in a form that can be added up again."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("count_rec"),
        F.sum("volume").alias("sum_volume"),
        F.count("volume").alias("n_volume"),
        F.sum("speed").alias("sum_speed"),
        F.count("speed").alias("n_speed"),
        F.min("ts").alias("first_ts"),
    )


def batch_averages(sums: DataFrame) -> DataFrame:
    """What a batch emits."""
    return sums.select(
        *SLOT_KEYS,
        "first_ts",
        "count_rec",
        F.try_divide("sum_volume", "n_volume").alias("avg_volume"),
        F.try_divide("sum_speed", "n_speed").alias("avg_speed"),
    )


def length_batch(
    readings: DataFrame,
    minutes: int,
    size: int = BATCH_ROWS,
    partial: bool = False,
    tie: str | list[str] = "event_id",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Averages of every ``size`` successive rows of a link and time of day.

    ``partial`` also gives the last, unfinished batch of each group, as the time
    limit does when no more rows come.
    """
    keyed = with_slot_keys(readings, minutes)
    placed = with_position(keyed, SLOT_KEYS, tie=tie, piece_rows=piece_rows)
    batched = placed.withColumn("batch", batch_number(F.col("position"), size))
    sums = batch_sums(batched, [*SLOT_KEYS, "batch"])
    return batch_averages(sums if partial else sums.where(F.col("count_rec") == size))


def every_nth(
    readings: DataFrame, n: int, buckets: int, tie: str | list[str] = "event_id", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Rows n, 2n, 3n, ... of each bucket of links."""
    bucketed = readings.withColumn("bucket", bucket_of("link_id", buckets).cast("int"))
    placed = with_position(bucketed, ["bucket"], tie=tie, piece_rows=piece_rows)
    ordinal = F.col("position") + 1
    return placed.withColumn("ordinal", ordinal).where(ordinal % n == 0).drop("position")


def live_clock(live: DataFrame, minutes: int, arrival: str = "event_id") -> DataFrame:
    """Hour and minute of the last live row to arrive, as they stood at the end of each slot.

    It is the latest arrival up to then and not the largest time. A slot without rows
    keeps what stood before it. Slots are added up day by day and then within the
    day, so no task has more of them than a day or the series of days has.
    """
    slot = slot_start("ts", minutes)
    last = live.where(F.col("ts").isNotNull()).groupBy(slot.alias("slot")).agg(
        F.max(F.struct(F.col(arrival).alias("arrival"), F.col("ts").alias("at"))).alias("last"))
    span = last.agg(F.min("slot").alias("first"), F.max("slot").alias("end"))
    day = F.expr("INTERVAL 1 DAY")
    days = span.where(F.col("first").isNotNull()).select(
        "end", "first", F.explode(F.sequence(F.date_trunc("day", "first").cast("timestamp_ntz"), "end", day)).alias("day"))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    grid = days.select(F.explode(F.sequence(
        F.greatest("day", "first"), F.least(F.col("day") + day - step, F.col("end")), step)).alias("slot"))
    slots = grid.join(last, "slot", "left").withColumn("day", F.to_date("slot"))
    by_day = slots.groupBy("day").agg(F.max("last").alias("last"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = by_day.select("day", F.max("last").over(earlier).alias("before"))
    upto = Window.partitionBy("day").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    stood = slots.withColumn("now", F.max("last").over(upto)).join(before, "day")
    clock = F.coalesce(F.greatest("now", "before"), "now", "before")["at"]
    return stood.select("slot", F.hour(clock).alias("livehours"), F.minute(clock).alias("livemins"))


def clock_at(live: DataFrame, at: datetime | None = None, arrival: str = "event_id") -> DataFrame:
    """One row: time of the last live row to arrive, among those not after ``at`` if it is given."""
    seen = live if at is None else live.where(F.col("ts") <= ntz(at))
    return seen.agg(F.max_by("ts", arrival).alias("clock"))


def unexpired(averages: DataFrame, clock: DataFrame, componentwise: bool = False) -> DataFrame:
    """Averages that are not behind the live clock (a frame of one row, ``clock``).

    ``componentwise`` compares hours and minutes apart, so that 01:00 counts as
    behind 00:55; otherwise the time of day is compared as a whole.
    """
    now = clock.select("clock").scalar()
    hours, minutes = F.hour(now), F.minute(now)
    if componentwise:
        return averages.where((minutes <= F.col("mins")) & (hours <= F.col("hrs")))
    return averages.where(
        minute_of_day(hours, minutes) <= minute_of_day(F.col("hrs"), F.col("mins"))
    )


def unexpired_dated(averages: DataFrame, clock: DataFrame, slot: str = "slot") -> DataFrame:
    """As ``unexpired`` for averages that carry their date, so midnight is no border."""
    now = clock.select(F.date_trunc("minute", F.col("clock")).cast("timestamp_ntz")).scalar()
    return averages.where(now <= F.col(slot))


def last_per_minute(
    samples: DataFrame, series: str, value: str, ts: str = "ts", arrival: str = "event_id"
) -> DataFrame:
    """One value per series and minute, the last one that came."""
    minute = F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz")
    return samples.groupBy(F.col(series).alias("series"), minute.alias("minute")).agg(
        F.max_by(value, arrival).alias("value")
    )


def last_minutes(
    samples: DataFrame, minutes: int = 10, ts: str = "ts", day: str | None = None
) -> DataFrame:
    """The samples of the last ``minutes`` before the newest one.

    With ``day``, the date column that the files are partitioned by, the newest one is looked
    for on the last date only, and dates before the edge are not read.
    """
    newest = samples.where(F.col(day) == samples.agg(F.max(day)).scalar()) if day else samples
    edge = newest.agg(F.max(ts) - F.expr(f"INTERVAL {minutes} MINUTES")).scalar()
    kept = samples.where(F.col(ts) > edge)
    return kept.where(F.col(day) >= edge.cast("date")) if day else kept


def percent_change(previous: Column, current: Column) -> Column:
    """Change in whole percent of ``previous``; null without one, or when it is 0."""
    change = F.abs(previous - current) * 100
    return F.call_function("div", change, F.nullif(previous, F.lit(0)))


def rate_changes(
    rates: DataFrame, width_seconds: int, percent: int = RATE_CHANGE_PERCENT
) -> DataFrame:
    """Each sample of a gap-free series with the sample before it.

    A sample also counts as "previous" one period later. Sending it to both
    periods pairs neighbours by key, so no task has to sort the whole series.
    """
    later = F.col("window_start") + F.expr(f"INTERVAL {width_seconds} SECONDS")
    roles = F.array(
        F.struct(F.col("window_start").alias("at"), F.col("us_per_msg").alias("current"),
                 F.lit(None).cast("long").alias("previous")),
        F.struct(later.alias("at"), F.lit(None).cast("long").alias("current"),
                 F.col("us_per_msg").alias("previous")),
    )
    paired = (
        rates.select(F.inline(roles))
        .groupBy(F.col("at").alias("window_start"))
        .agg(F.max("current").alias("us_per_msg"), F.max("previous").alias("previous"))
        .where(F.col("us_per_msg").isNotNull())
    )
    change = percent_change(F.col("previous"), F.col("us_per_msg"))
    return paired.withColumn("percent_change", change).withColumn(
        "changed", F.coalesce(F.col("percent_change") > percent, F.lit(False))
    )
