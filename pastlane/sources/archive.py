"""Scans of the archive."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pastlane.functions.time import ntz
from pastlane.model import ARCHIVE_SCHEMA

# Fixed value: rows fetched from a database at a time.
FETCH_ROWS = 10_000


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive readings from parquet; every reading has a link and a time."""
    rows = spark.read.schema(ARCHIVE_SCHEMA).parquet(path)
    return rows.where(F.col("link_id").isNotNull() & F.col("ts").isNotNull())


def day_predicates(
    start: datetime, end: datetime, pieces: int = 24, ts: str = "TIME_STAMP"
) -> list[str]:
    """Disjoint conditions on ``ts`` that cover [start, end), one per read task."""
    days = (end - start) / timedelta(days=1)
    step = (end - start) / max(1, round(days * pieces))
    predicates, at = [], start
    while at < end:
        upto = min(at + step, end)
        predicates.append(f"{ts} >= '{at:%F %T.%f}' AND {ts} < '{upto:%F %T.%f}'")
        at = upto
    return predicates


def read_archive_jdbc(
    spark: SparkSession,
    url: str,
    start: datetime,
    end: datetime,
    table: str = "dataarchive",
    pieces: int = 24,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Archive readings in [start, end) from a database, ``pieces`` reads per day."""
    return _from_database(spark, url, table, day_predicates(start, end, pieces), properties)


def instant_predicates(
    instants: Iterable[datetime], width: timedelta | None = None, ts: str = "TIME_STAMP"
) -> list[str]:
    """Conditions on ``ts`` for the given instants, or the slots that start there, one per read task."""
    if width is None:
        return [f"{ts} = '{at:%F %T.%f}'" for at in instants]
    return [f"{ts} >= '{at:%F %T.%f}' AND {ts} < '{at + width:%F %T.%f}'" for at in instants]


def read_instants_jdbc(
    spark: SparkSession,
    url: str,
    instants: Iterable[datetime],
    width: timedelta | None = None,
    table: str = "dataarchive",
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Archive readings of some instants or slots from a database, which gives no others."""
    return _from_database(spark, url, table, instant_predicates(instants, width), properties)


def _from_database(spark, url, table, predicates, properties) -> DataFrame:
    # Times as the database has them: no cast stands between conditions on ts and the database.
    rows = spark.read.option("preferTimestampNTZ", True).jdbc(
        url,
        f"(SELECT LINKID, SPEED, VOLUME, TIME_STAMP FROM {table}) archive",
        predicates=predicates,
        properties={"fetchsize": str(FETCH_ROWS), **(properties or {})},
    )
    return rows.select(
        F.col("LINKID").cast("long").alias("link_id"),
        F.col("SPEED").cast("double").alias("speed"),
        F.col("VOLUME").cast("int").alias("volume"),
        F.col("TIME_STAMP").alias("ts"),
    )


def in_range(
    rows: DataFrame, start: datetime, end: datetime, ts: str = "ts", day: str | None = None
) -> DataFrame:
    """Rows in [start, end). ``day`` names a date column the files are partitioned by."""
    kept = rows.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))
    if day:
        last = end - timedelta(microseconds=1)
        kept = kept.where(F.col(day).between(F.lit(start.date()), F.lit(last.date())))
    return kept


def range_scan(rows: DataFrame, start: datetime, end: datetime, day: str | None = None) -> DataFrame:
    """Rows in [start, end) by link.

    Time follows in the order so that the rows of one link can be cut into
    several sorted partitions.
    """
    kept = in_range(rows, start, end, day=day)
    return kept.select("link_id", "speed", "volume", "ts").orderBy("link_id", "ts")


def day_aligned_scan(
    rows: DataFrame, instants: Iterable[datetime], width: timedelta | None = None, day: str | None = None
) -> DataFrame:
    """Rows at the given instants, or in the slots of ``width`` that start there.

    The condition is on ``ts`` itself, so it reaches the files; a condition on a
    slot computed from ``ts`` would not. ``day`` names a date column the files are
    partitioned by; of the others none is opened.
    """
    instants = list(instants)
    if day:
        ends = [instant + width - timedelta(microseconds=1) for instant in instants] if width else []
        dates = {instant.date() + timedelta(days=n) for instant, end in zip(instants, ends or instants)
                 for n in range((end.date() - instant.date()).days + 1)}
        rows = rows.where(F.col(day).isin(sorted(dates)))
    if width is None:
        at = F.col("ts").isin([ntz(instant) for instant in instants])
        return rows.where(at)
    slots = [
        (F.col("ts") >= ntz(instant)) & (F.col("ts") < ntz(instant + width))
        for instant in instants
    ]
    return rows.where(reduce(lambda a, b: a | b, slots))
