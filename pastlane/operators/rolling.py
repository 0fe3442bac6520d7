"""The profile of the last days, kept up to date day by day.

Each day leaves its partial sums by link and time of day in a folder of its own, and the sums of the last ``days`` days stand in another.
Moving on by a day adds the new day's sums and takes out those of the day that falls out of the span: the archive is read for
the new day alone, and of the daily sums only these two days are. Sums are decimals, so what was added is
taken out exactly and nothing drifts, however many days go by.

A folder is written for each day and replaced if the day is repeated, so a move can be done again after a failure.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from pastlane.functions.time import ntz, slot_of_day
from pastlane.model import SLOT_KEYS

# Whole digits and places of a reading in a sum; a sum of 10 ** 10 readings keeps them all.
EXACT = "decimal(28,15)"
SUMS = "link_id long, hrs int, mins int, count_rec long, sum_speed decimal(38,15), n_speed long, sum_volume decimal(38,15), n_volume long"
TOTALS = [part.split(" ")[0] for part in SUMS.split(", ")][len(SLOT_KEYS):]


def _midnight(day: date) -> datetime:
    return datetime.combine(day, time())


def _days(path: str) -> str:
    return f"{path.rstrip('/')}/days"


def _upto(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/upto={day.isoformat()}"


def _exact(column: str) -> Column:
    return F.sum(F.col(column).cast(EXACT)).cast("decimal(38,15)")


def day_sums(rows: DataFrame, minutes: int) -> DataFrame:
    """Partial sums by day, link and time of day."""
    keys = [F.col("link_id").cast("long").alias("link_id"), *slot_of_day("ts", minutes), F.to_date("ts").alias("day")]
    sums = rows.where("ts is not null").groupBy(*keys).agg(
        F.count("*").alias("count_rec"),
        F.coalesce(_exact("speed"), F.lit(0)).alias("sum_speed"), F.count("speed").alias("n_speed"),
        F.coalesce(_exact("volume"), F.lit(0)).alias("sum_volume"), F.count("volume").alias("n_volume"))
    kinds = dict(part.split(" ", 1) for part in SUMS.split(", "))
    return sums.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()], "day")


def _write_days(sums: DataFrame, path: str) -> None:
    """Replaces the folders of the days that the sums have."""
    sums.hint("rebalance", "day").write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(_days(path))


def read_days(frame: DataFrame, path: str, days: list[date]) -> DataFrame:
    """The daily sums of some days; others are not read."""
    sums = frame.sparkSession.read.schema(f"{SUMS}, day date").parquet(_days(path))
    return sums.where(F.col("day").isin([F.lit(day) for day in days]))


def _added(parts: DataFrame) -> DataFrame:
    """Sums of sums; groups that no day of the span has any more go."""
    added = parts.groupBy(*SLOT_KEYS).agg(*[F.sum(name).alias(name) for name in TOTALS])
    kinds = dict(part.split(" ", 1) for part in SUMS.split(", "))
    return added.where("count_rec > 0").select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()])


def _within(archive: DataFrame, first: date, last: date, day: str | None) -> DataFrame:
    """The rows of a span of days; ``day`` names the date column that the archive's files are partitioned by."""
    start, end = _midnight(first), _midnight(last + timedelta(days=1))
    rows = archive.where((F.col("ts") >= ntz(start)) & (F.col("ts") < ntz(end)))
    return rows.where(F.col(day).between(F.lit(first), F.lit(last))) if day else rows


def start_profile(archive: DataFrame, path: str, last: date, days: int, minutes: int, day: str | None = None) -> DataFrame:
    """Writes the sums of the ``days`` days up to ``last``, and gives their averages."""
    first = last - timedelta(days=days - 1)
    _write_days(day_sums(_within(archive, first, last, day), minutes), path)
    span = [first + timedelta(days=n) for n in range(days)]
    _added(read_days(archive, path, span)).write.mode("overwrite").parquet(_upto(path, last))
    return profile_upto(archive, path, last)


def moved(frame: DataFrame, path: str, last: date, days: int) -> DataFrame:
    """The sums of the span that ends with ``last``, from those that end a day before it."""
    before = frame.sparkSession.read.schema(SUMS).parquet(_upto(path, last - timedelta(days=1)))
    gone = last - timedelta(days=days)
    sign = F.when(F.col("day") == F.lit(gone), -1).otherwise(1)
    two = read_days(frame, path, [gone, last])
    return _added(before.unionByName(two.select(*SLOT_KEYS, *[(F.col(x) * sign).alias(x) for x in TOTALS]).select(
        *SLOT_KEYS, *[F.col(x).cast(before.schema[x].dataType).alias(x) for x in TOTALS])))


def advance_profile(archive: DataFrame, path: str, last: date, days: int, minutes: int, day: str | None = None) -> DataFrame:
    """Moves the profile at ``path`` on to the span that ends with ``last``, a day later than it did; gives its averages."""
    _write_days(day_sums(_within(archive, last, last, day), minutes), path)
    moved(archive, path, last, days).write.mode("overwrite").parquet(_upto(path, last))
    return profile_upto(archive, path, last)


def profile_upto(frame: DataFrame, path: str, last: date) -> DataFrame:
    """The averages of the span that ends with ``last``: what a join looks up."""
    sums = frame.sparkSession.read.schema(SUMS).parquet(_upto(path, last))
    return sums.select(
        *SLOT_KEYS, "count_rec",
        *[F.try_divide(F.col(f"sum_{x}").cast("double"), F.col(f"n_{x}")).alias(f"avg_{x}") for x in ("speed", "volume")])
