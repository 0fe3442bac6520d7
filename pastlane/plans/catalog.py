"""The registered queries: every operator on the test tables.

Averages are rounded to nine digits, because a sum of doubles depends on the order
in which its parts are added.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pastlane.functions.spatial import parse_polygon
from pastlane.functions.time import (
    EVENT_FORMAT,
    day_aligned_instants,
    format_time,
    ntz,
    parse_time,
    slot_start,
    time_of_day,
)
from pastlane.operators import averages, cutting, filters, joins, metrics, periods, regions, rolling, routed, windows
from pastlane.plans import pipelines
from pastlane.session import fresh_dir, use_query_settings
from pastlane.sources import archive as scans, tables
from pastlane.sources.live import StreamSource, find_stream, open_stream
from pastlane.streaming import expiry, length_batch as batches, moving, queries as streams, recent

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Start of the slot count for the archive's parity.
FIRST_SLOT = datetime(2024, 1, 1)

# The two instants of the lookup, and the moment the expiry looks at the clock.
LOOKUP_INSTANTS = day_aligned_instants(tables.MORNING, 2)
CLOCK_AT = datetime(2024, 1, 30, 13, 30)

# Time limit of a batch: the readings of a link and hour are days apart.
BATCH_SECONDS = 5 * 86_400

# A group without rows for so long, by the stream's time less a day, is forgotten.
IDLE_SECONDS = 3 * 86_400

# The last evening hours are not of the live rows of which the last one sets the clock.
LAST_LIVE = datetime(2024, 1, 30, 22)

# The days by which the profile moves on to the archive's last day.
MOVES = 3

# The vertices that each edge of the region is cut at.
VERTICES = 5_000

JOIN_BUCKETS = 5
SAMPLE_EVERY = 100


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(use_query_settings(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 9) for name in columns})


def _averages(df: DataFrame) -> DataFrame:
    return _rounded(df, "avg_speed", "avg_volume")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.readings(spark, sf_dir)
    return tables.live_of(rows), tables.archive_of(rows)


def _joined(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (), how: str = "inner"):
    live, archive = _split(spark, sf_dir)
    return pipelines.live_with_archive(
        live, archive, tables.links(spark, sf_dir), tables.REGION, tables.SLOT_MINUTES, how, extra
    )


# Scans


@query
def archive_range_scan(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return scans.range_scan(rows, tables.MORNING, tables.MORNING + tables.SLOT)


def _morning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = day_aligned_instants(tables.MORNING, tables.ARCHIVE_DAYS)
    return scans.day_aligned_scan(tables.readings(spark, sf_dir), instants, tables.SLOT)


@query
def archive_day_aligned_scan(spark, sf_dir):
    return _morning_rows(spark, sf_dir).select("link_id", "speed", "volume", "ts")


@query
def archive_all_slots(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _averages(averages.all_slots_average(rows, tables.SLOT_MINUTES))


@query
def link_dimension(spark, sf_dir):
    return tables.links(spark, sf_dir)


# Filters


@query
def region_links(spark, sf_dir):
    return filters.region_links(tables.links(spark, sf_dir), tables.REGION)


@query
def region_readings(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    inside = filters.in_region(rows, tables.links(spark, sf_dir), tables.REGION)
    return inside.select("event_id", "link_id", "speed", "volume", "ts", "x", "y")


def _with_vertices(wkt: str, count: int) -> str:
    """The same polygon with ``count`` vertices on each edge."""
    (ring,) = parse_polygon(wkt)
    points = [(ax + (bx - ax) * k / count, ay + (by - ay) * k / count) for (ax, ay), (bx, by) in zip(ring, ring[1:]) for k in range(count)]
    return f"POLYGON(({', '.join(f'{x!r} {y!r}' for x, y in [*points, points[0]])}))"


@query
def region_links_by_strips(spark, sf_dir):
    return regions.region_links_by_strips(tables.links(spark, sf_dir), _with_vertices(tables.REGION, VERTICES))


@query
def parity_live(spark, sf_dir):
    rows = filters.parity_live(tables.readings(spark, sf_dir))
    return rows.select("event_id", "link_id", "speed", "volume", "ts")


@query
def parity_archive(spark, sf_dir):
    minutes = tables.FINE_SLOT_MINUTES
    rows = tables.readings(spark, sf_dir).withColumn("slot", slot_start("ts", minutes))
    kept = filters.parity_archive(rows, ntz(FIRST_SLOT), minutes)
    return kept.select("event_id", "link_id", "speed", "volume", "ts", "slot")


@query
def parity_filtered_join(spark, sf_dir):
    live, archive = _split(spark, sf_dir)
    return _averages(
        pipelines.live_with_archive_by_parity(live, archive, FIRST_SLOT, tables.SLOT_MINUTES)
    )


# Averages


@query
def day_aligned_average(spark, sf_dir):
    rows = _morning_rows(spark, sf_dir)
    return _averages(averages.day_aligned_average(rows, tables.MORNING)).orderBy("link_id")


@query
def day_aligned_average_refnum(spark, sf_dir):
    rows = _morning_rows(spark, sf_dir)
    return averages.day_aligned_average(rows, tables.MORNING, reference_numeric=True)


@query
def slot_aggregate(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _averages(averages.slot_aggregate(rows, tables.SLOT_MINUTES))


@query
def slot_aggregate_clean(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    groups = averages.slot_aggregate(rows, tables.SLOT_MINUTES)
    kept = filters.without_null_averages(filters.without_empty_groups(groups))
    return _averages(kept)


@query
def day_substreams_union(spark, sf_dir):
    rows = averages.day_substreams(tables.readings(spark, sf_dir), tables.ARCHIVE_START)
    return _averages(averages.day_averages(rows))


@query
def slots_5min(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _rounded(averages.slot_counts(rows, tables.FINE_SLOT_MINUTES), "avg_speed")


@query
def profile_advance(spark, sf_dir):
    """The six days before the live day, reached by moving on from six days that ended earlier."""
    archive, path = tables.readings(spark, sf_dir), fresh_dir(spark, "profile-days")
    last = (tables.LIVE_START - timedelta(days=1 + MOVES)).date()
    profile = rolling.start_profile(archive, path, last, tables.ARCHIVE_DAYS, tables.SLOT_MINUTES)
    for move in range(1, MOVES + 1):
        day = last + timedelta(days=move)
        profile = rolling.advance_profile(archive, path, day, tables.ARCHIVE_DAYS, tables.SLOT_MINUTES)
    return _averages(profile)


# Joins


@query
def live_archive_join(spark, sf_dir):
    return _averages(_joined(spark, sf_dir))


@query
def live_archive_left_join(spark, sf_dir):
    live, archive = _split(spark, sf_dir)
    profile = pipelines.archive_profile(archive, tables.SLOT_MINUTES)
    return _averages(joins.live_archive_join(live, profile, tables.SLOT_MINUTES, "left"))


@query
def fetched_slot_join(spark, sf_dir):
    live, archive = _split(spark, sf_dir)
    links = tables.links(spark, sf_dir)
    return _averages(
        pipelines.live_with_fetched_slot(
            live, archive, links, tables.REGION, tables.MORNING, tables.ARCHIVE_DAYS, tables.SLOT
        )
    )


@query
def default_mode_join(spark, sf_dir):
    """Region, averages of every slot and both parities, in slots of an hour."""
    live, archive = _split(spark, sf_dir)
    links = tables.links(spark, sf_dir)
    return _averages(
        pipelines.default_run(
            live, archive, links, tables.REGION, FIRST_SLOT, tables.SLOT_MINUTES
        )
    )


@query
def needed_links_join(spark, sf_dir):
    """The flagship's rows; only links that have live rows are averaged."""
    live, archive = _split(spark, sf_dir)
    return _averages(pipelines.live_with_needed_archive(
        live, archive, tables.links(spark, sf_dir), tables.REGION, tables.SLOT_MINUTES))


@query
def routed_join(spark, sf_dir):
    """The flagship's rows, from sides that were routed to join instances."""
    live, archive = _split(spark, sf_dir)
    links = tables.links(spark, sf_dir)
    profile = pipelines.archive_profile(filters.of_region(archive, links, tables.REGION), tables.SLOT_MINUTES)
    live = joins.with_slot_keys(filters.of_region(live, links, tables.REGION), tables.SLOT_MINUTES)
    return _averages(routed.routed_join(
        routed.route(live, JOIN_BUCKETS, "routed_live"), routed.route(profile, JOIN_BUCKETS, "routed_averages")))


@query
def live_history_lookup(spark, sf_dir):
    live, archive = _split(spark, sf_dir)
    return _rounded(
        pipelines.live_with_lookup(live, archive, LOOKUP_INSTANTS, tables.SLOT), "hist_avg"
    )


@query
def bucketed_join_counts(spark, sf_dir):
    counts = joins.bucketed_join_counts(_joined(spark, sf_dir), JOIN_BUCKETS)
    return _rounded(counts, "mean_speed", "mean_hist_speed")


# Data windows


@query
def latest_per_slot(spark, sf_dir):
    return windows.latest_per_slot(tables.readings(spark, sf_dir), tables.SLOT_MINUTES)


@query
def length_batch(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _averages(windows.length_batch(rows, tables.SLOT_MINUTES))


@query
def length_batch_partial(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _averages(windows.length_batch(rows, tables.SLOT_MINUTES, partial=True))


@query
def time_length_batch(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return _averages(cutting.time_length_batch(
        rows, tables.SLOT_MINUTES, windows.BATCH_ROWS, BATCH_SECONDS, ["event_id"]))


@query
def every_nth_sample(spark, sf_dir):
    rows = windows.every_nth(tables.readings(spark, sf_dir), SAMPLE_EVERY, JOIN_BUCKETS)
    return rows.select("bucket", "ordinal", "event_id", "link_id", "speed", "volume", "ts")


@query
def live_clock(spark, sf_dir):
    return windows.live_clock(tables.live(spark, sf_dir), tables.SLOT_MINUTES)


def _unexpired(spark: SparkSession, sf_dir: str, componentwise: bool) -> DataFrame:
    live, archive = _split(spark, sf_dir)
    profile = pipelines.archive_profile(archive, tables.FINE_SLOT_MINUTES)
    clock = windows.clock_at(live, CLOCK_AT)
    return _averages(windows.unexpired(profile, clock, componentwise))


@query
def unexpired_componentwise(spark, sf_dir):
    return _unexpired(spark, sf_dir, componentwise=True)


@query
def unexpired_ordered(spark, sf_dir):
    return _unexpired(spark, sf_dir, componentwise=False)


@query
def unexpired_at_the_last_row(spark, sf_dir):
    live, archive = _split(spark, sf_dir)
    profile = pipelines.archive_profile(archive, tables.FINE_SLOT_MINUTES)
    clock = windows.clock_at(live.where(F.col("ts") < ntz(LAST_LIVE)))
    return _averages(windows.unexpired(profile, clock))


@query
def last_per_minute(spark, sf_dir):
    return windows.last_per_minute(tables.readings(spark, sf_dir), "event_type", "speed")


@query
def last_10_minutes(spark, sf_dir):
    rows = windows.last_minutes(tables.readings(spark, sf_dir), 10)
    return rows.select("event_id", "link_id", "speed", "ts")


# Metrics


@query
def ingestion_rate_30s(spark, sf_dir):
    counts = metrics.period_counts(tables.readings(spark, sf_dir))
    return metrics.ingestion_rate(metrics.fill_gaps(counts))


@query
def rate_change_flags(spark, sf_dir):
    width = 3600
    counts = metrics.period_counts(tables.readings(spark, sf_dir), width)
    rates = metrics.ingestion_rate(metrics.fill_gaps(counts, width), width)
    return windows.rate_changes(rates, width)


@query
def throughput_30s(spark, sf_dir):
    return metrics.throughput(_joined(spark, sf_dir))


@query
def latency_last_30s(spark, sf_dir):
    # Periods of an hour: the readings are too sparse for 30 seconds.
    rows = _joined(spark, sf_dir, extra=("event_id",))
    return metrics.latency(pipelines.with_emit_time(rows, tables.SLOT_MINUTES), seconds=3600)


@query
def floating_throughput(spark, sf_dir):
    """Periods of an hour or more that begin with a joined row and end with one."""
    rows = pipelines.with_emit_time(_joined(spark, sf_dir, extra=("event_id",)), tables.SLOT_MINUTES)
    return periods.floating_periods(rows, 3600, emit_ts="emit_ts")


# Scalar functions


@query
def time_parts(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    return rows.select("event_id", *time_of_day("ts"), F.second("ts").alias("secs"))


@query
def timestamp_format_roundtrip(spark, sf_dir):
    rows = tables.readings(spark, sf_dir).select(
        "event_id", format_time("ts", EVENT_FORMAT).alias("event_time")
    )
    return rows.withColumn("parsed", parse_time("event_time", EVENT_FORMAT))


# Streams: each runs to the end of its input


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events*.parquet"
    registry = {"traffic": StreamSource(tables.EVENTS_SCHEMA, path)}
    return tables.to_readings(open_stream(spark, find_stream(registry, "Traffic")))


def _folders(spark: SparkSession, name: str) -> dict[str, str]:
    base = fresh_dir(spark, name)
    return {"out": f"{base}/rows", "checkpoint": f"{base}/checkpoint"}


@query
def live_stream_passthrough(spark, sf_dir):
    live = tables.live_of(_events_stream(spark, sf_dir))
    rows = live.select("event_id", "link_id", "speed", "volume", "ts")
    return streams.passthrough(rows, **_folders(spark, "passthrough"))


@query
def live_join_stream(spark, sf_dir):
    links = tables.links(spark, sf_dir)
    archive = filters.of_region(tables.archive(spark, sf_dir), links, tables.REGION)
    profile = pipelines.archive_profile(archive, tables.SLOT_MINUTES)
    written = streams.write_profile(profile, fresh_dir(spark, "profile"))
    live = tables.live_of(_events_stream(spark, sf_dir))
    return _averages(
        streams.live_join_stream(
            live,
            spark.read.schema(profile.schema).parquet(written),
            minutes=tables.SLOT_MINUTES,
            links=links,
            wkt=tables.REGION,
            **_folders(spark, "live-join"),
        )
    )


@query
def live_lookup_stream(spark, sf_dir):
    rows = scans.day_aligned_scan(tables.archive(spark, sf_dir), LOOKUP_INSTANTS, tables.SLOT)
    history = averages.link_history(rows)
    path = fresh_dir(spark, "history")
    history.write.parquet(path)
    live = tables.live_of(_events_stream(spark, sf_dir))
    return _rounded(
        streams.live_lookup_stream(
            live, spark.read.schema(history.schema).parquet(path), **_folders(spark, "lookup")
        ),
        "hist_avg",
    )


@query
def slots_5min_stream(spark, sf_dir):
    counts = streams.slot_counts_stream(
        _events_stream(spark, sf_dir),
        minutes=tables.FINE_SLOT_MINUTES,
        **_folders(spark, "slots"),
    )
    return _rounded(counts, "avg_speed")


@query
def ingestion_rate_stream(spark, sf_dir):
    counts = streams.period_counts_stream(
        _events_stream(spark, sf_dir), seconds=metrics.PERIOD, **_folders(spark, "rate")
    )
    return metrics.ingestion_rate(metrics.fill_gaps(counts))


@query
def latest_per_slot_stream(spark, sf_dir):
    return streams.latest_per_slot_stream(
        _events_stream(spark, sf_dir), minutes=tables.SLOT_MINUTES, **_folders(spark, "latest")
    )


@query
def length_batch_stream(spark, sf_dir):
    rows = batches.length_batch_stream(
        _events_stream(spark, sf_dir), minutes=tables.SLOT_MINUTES, **_folders(spark, "batches")
    )
    return _averages(rows)


@query
def time_length_batch_stream(spark, sf_dir):
    rows = batches.length_batch_stream(
        _events_stream(spark, sf_dir),
        minutes=tables.SLOT_MINUTES,
        limit_seconds=BATCH_SECONDS,
        **_folders(spark, "time-batches"),
    )
    return _averages(rows)


@query
def aged_batches_stream(spark, sf_dir):
    rows = batches.length_batch_stream(
        _events_stream(spark, sf_dir), minutes=tables.SLOT_MINUTES, idle_seconds=IDLE_SECONDS, lateness="1 day",
        **_folders(spark, "aged-batches"))
    return _averages(rows)


def _daily_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average of each day, link and hour; it arrives with its last reading."""
    rows = joins.with_slot_keys(tables.readings(spark, sf_dir), tables.SLOT_MINUTES)
    return rows.groupBy("link_id", "hrs", "mins", slot_start("ts", tables.SLOT_MINUTES).alias("slot")).agg(
        F.avg("speed").alias("avg_speed"), F.avg("volume").alias("avg_volume"), F.max("event_id").alias("event_id"))


def _as_stream(rows: DataFrame, name: str) -> DataFrame:
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return open_stream(spark, StreamSource(rows.schema, path))


@query
def moving_archive_stream(spark, sf_dir):
    """Every reading with the daily average of its link and hour that had arrived last."""
    arriving = _as_stream(_daily_averages(spark, sf_dir), "arriving")
    return _averages(moving.moving_join_stream(
        _events_stream(spark, sf_dir), arriving, minutes=tables.SLOT_MINUTES, **_folders(spark, "moving"))).withColumnRenamed(
            "arrival", "event_id")


@query
def unexpired_stream(spark, sf_dir):
    """The daily averages that the last live row but those of the evening has not passed, over all dates."""
    live = _events_stream(spark, sf_dir).where(F.col("ts") < ntz(LAST_LIVE))
    kept = expiry.expiry_stream(live, _as_stream(_daily_averages(spark, sf_dir), "dated"), **_folders(spark, "expiry"))
    return _averages(kept)


@query
def recent_minutes_stream(spark, sf_dir):
    return recent.recent_minutes_stream(
        _events_stream(spark, sf_dir), series="event_type", value="speed", **_folders(spark, "recent"))


@query
def rate_change_stream(spark, sf_dir):
    counts = metrics.period_counts(tables.readings(spark, sf_dir), 3600)
    rates = metrics.ingestion_rate(metrics.fill_gaps(counts, 3600), 3600).select("window_start", "us_per_msg")
    return recent.rate_changes_stream(_as_stream(rates, "rates"), **_folders(spark, "rate-changes"))
