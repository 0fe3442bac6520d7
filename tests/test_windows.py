from datetime import datetime, timedelta

import pytest
from frames import as_set, at, plan_text, readings

from pastlane.operators import averages, cutting, windows
from pastlane.functions.time import format_time, parse_time, CONFIG_FORMAT
from pastlane.plans import pipelines
from pyspark.sql import functions as F

FIRST = datetime(2011, 4, 11)


def averages_at(spark, *times):
    return spark.createDataFrame(
        [(1, 1.0, 1.0, h, m) for h, m in times],
        "link_id long, avg_speed double, avg_volume double, hrs int, mins int",
    )


def clock(spark, text):
    return spark.createDataFrame([(at(text),)], "clock timestamp_ntz")


@pytest.mark.parametrize("piece_rows", [100, 2])
def test_seven_rows_make_a_full_and_a_partial_batch(spark, piece_rows):
    rows = readings(spark, [(1, float(n), n, FIRST + timedelta(days=n)) for n in range(7)])
    full = windows.length_batch(rows, 5, piece_rows=piece_rows)
    assert as_set(full, "count_rec", "avg_speed", "avg_volume") == {(6, 2.5, 2.5)}
    every = windows.length_batch(rows, 5, partial=True, piece_rows=piece_rows)
    assert as_set(every, "count_rec", "avg_speed") == {(6, 2.5), (1, 6.0)}


def test_batches_hold_every_row_once(spark):
    rows = readings(spark, [(n % 5, float(n), n, FIRST + timedelta(minutes=7 * n)) for n in range(1000)])
    for piece_rows in (1000, 3):
        batches = windows.length_batch(rows, 60, partial=True, piece_rows=piece_rows)
        assert batches.agg(F.sum("count_rec")).collect()[0][0] == 1000
        assert batches.agg(F.max("count_rec")).collect()[0][0] == 6


def test_batches_skip_nulls(spark):
    rows = readings(spark, [(1, None if n else 4.0, None, FIRST + timedelta(days=n)) for n in range(6)])
    assert as_set(windows.length_batch(rows, 5), "avg_speed", "avg_volume") == {(4.0, None)}


def test_later_average_replaces_the_earlier(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, 0, 10.0), (2, 1, 0, 0, 20.0), (3, 1, 0, 5, 30.0)],
        "event_id long, link_id long, hrs int, mins int, avg_speed double",
    )
    latest = windows.latest_per_key(rows, ["link_id", "hrs", "mins"], ["avg_speed"])
    assert as_set(latest, "mins", "avg_speed") == {(0, 20.0), (5, 30.0)}


def test_clock_follows_arrival_and_not_time(spark):
    live = readings(spark, [
        (1, 1.0, 1, at("2011-04-17 00:10:00")), (2, 1.0, 1, at("2011-04-17 00:05:00")),
        (3, 1.0, 1, at("2011-04-17 01:02:00")), (4, 1.0, 1, at("2011-04-17 04:01:00")),
        (4, 1.0, 1, at("2011-04-17 01:03:00")), (4, 1.0, 1, at("2011-04-18 01:03:00")),
    ])
    ticks = windows.live_clock(live, 60)
    # A row for each slot; hour 4's row came before one of hour 1, which stands until the next day.
    stood = {(n, (0, 5) if n == 0 else (1, 3)) for n in range(26)}
    first = at("2011-04-17 00:00:00")
    assert {((r.slot - first) // timedelta(hours=1), (r.livehours, r.livemins)) for r in ticks.collect()} == stood
    assert windows.live_clock(live.limit(0), 60).count() == 0
    assert as_set(windows.clock_at(live), "clock") == {(at("2011-04-18 01:03:00"),)}
    stopped = windows.clock_at(live, at("2011-04-17 00:30:00"))
    assert as_set(stopped, "clock") == {(at("2011-04-17 00:05:00"),)}


def test_expiry_over_the_hour(spark):
    rows = averages_at(spark, (0, 50), (0, 55), (1, 0), (2, 55))
    now = clock(spark, "2011-04-17 00:55:00")
    ordered = windows.unexpired(rows, now)
    assert as_set(ordered, "hrs", "mins") == {(0, 55), (1, 0), (2, 55)}
    apart = windows.unexpired(rows, now, componentwise=True)
    assert as_set(apart, "hrs", "mins") == {(0, 55), (2, 55)}


def test_expiry_over_midnight_needs_the_date(spark):
    now = clock(spark, "2011-04-17 23:55:30")
    assert windows.unexpired(averages_at(spark, (0, 0)), now).count() == 0
    dated = spark.createDataFrame(
        [(at("2011-04-17 23:50:00"),), (at("2011-04-17 23:55:00"),), (at("2011-04-18 00:00:00"),)],
        "slot timestamp_ntz",
    )
    assert as_set(windows.unexpired_dated(dated, now), "slot") == {
        (at("2011-04-17 23:55:00"),), (at("2011-04-18 00:00:00"),),
    }


@pytest.mark.parametrize("piece_rows", [100, 7])
def test_every_nth_row_of_a_bucket(spark, piece_rows):
    rows = readings(spark, [(n % 4, float(n), n, FIRST + timedelta(seconds=n)) for n in range(100)])
    picked = windows.every_nth(rows, 10, 2, piece_rows=piece_rows)
    assert as_set(picked, "bucket", "ordinal", "event_id") == {
        (b, n, 2 * (n - 1) + b) for b in (0, 1) for n in (10, 20, 30, 40, 50)
    }


def test_last_value_of_a_minute(spark):
    rows = readings(spark, [
        (1, 1.0, 1, at("2011-04-11 00:00:01")), (1, 2.0, 1, at("2011-04-11 00:00:59")),
        (1, 3.0, 1, at("2011-04-11 00:01:00")),
    ])
    kept = windows.last_per_minute(rows, "link_id", "speed")
    assert as_set(kept, "minute", "value") == {
        (at("2011-04-11 00:00:00"), 2.0), (at("2011-04-11 00:01:00"), 3.0),
    }


def test_view_of_the_last_minutes(spark):
    rows = readings(spark, [(1, float(m), 1, FIRST + timedelta(minutes=m)) for m in range(30)])
    assert {s for (s,) in as_set(windows.last_minutes(rows), "speed")} == {float(m) for m in range(20, 30)}


def test_last_minutes_read_the_last_dates_only(spark, tmp_path):
    rows = readings(spark, [(1, float(n), 1, FIRST + timedelta(hours=n)) for n in range(60)])
    path = str(tmp_path / "rows")
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    kept = windows.last_minutes(stored, 12 * 60, day="day")
    assert sorted(r.speed for r in kept.collect()) == [float(n) for n in range(48, 60)]
    assert "PartitionFilters: [isnotnull(day" in plan_text(kept)


def test_batches_of_limited_time(spark):
    """Six rows ten minutes apart, at most 15 minutes from the first of a batch."""
    rows = readings(spark, [(1, float(n), n, FIRST + timedelta(minutes=10 * n)) for n in range(6)] + [(2, 1.0, None, FIRST)])
    cut = cutting.time_length_batch(rows, 120, 6, 900, ["event_id"])
    assert as_set(cut, "first_ts", "count_rec", "avg_speed") == {
        (FIRST, 2, 0.5), (FIRST + timedelta(minutes=20), 2, 2.5)}
    every = cutting.time_length_batch(rows, 120, 6, 900, ["event_id"], partial=True)
    assert every.agg(F.sum("count_rec")).first()[0] == 7 and every.where("avg_volume is null").count() == 1
    plain = cutting.time_length_batch(rows, 120, 6, None, ["event_id"])
    assert as_set(plain, "count_rec", "avg_speed") == {(6, 2.5)}
    assert cutting.time_length_batch(rows.limit(0), 120, 6, 900, ["event_id"]).count() == 0


def rates(spark, *micros):
    return spark.createDataFrame(
        [(FIRST + timedelta(seconds=30 * n), m) for n, m in enumerate(micros)],
        "window_start timestamp_ntz, us_per_msg long",
    )


def test_change_of_rate_above_twenty_percent(spark):
    changes = windows.rate_changes(rates(spark, 8000, 9600, 9600, 7680, 7600, 9196), 30)
    assert [row.percent_change for row in changes.orderBy("window_start").collect()] == [
        None, 20, 0, 20, 1, 21,
    ]
    assert as_set(changes.where("changed"), "previous", "us_per_msg") == {(7600, 9196)}
    assert as_set(windows.rate_changes(rates(spark, 8000, 9680), 30).where("changed"), "percent_change") == {(21,)}


def test_previous_rate_of_zero_is_guarded(spark):
    changes = windows.rate_changes(rates(spark, 0, 9600), 30)
    assert as_set(changes, "us_per_msg", "percent_change", "changed") == {
        (0, None, False), (9600, None, False),
    }


def test_text_form_of_times(spark):
    df = spark.createDataFrame([("17-Apr-2011 00:05:06.789",)], "event_time string")
    parsed = df.select(parse_time("event_time").alias("ts"))
    assert as_set(parsed, "ts") == {(at("2011-04-17 00:05:06.789"),)}
    assert as_set(parsed.select(format_time("ts").alias("t")), "t") == {("17-Apr-2011 00:05:06.789",)}
    start = spark.createDataFrame([("11-Apr-2011 00:00:00",)], "t string")
    assert as_set(start.select(parse_time("t", CONFIG_FORMAT).alias("t")), "t") == {(FIRST,)}


def test_profile_has_one_row_per_link_and_slot(spark):
    rows = readings(spark, [(n % 3, 1.0, 1, FIRST + timedelta(minutes=13 * n)) for n in range(500)])
    profile = pipelines.archive_profile(rows, 60)
    assert profile.count() == profile.select("link_id", "hrs", "mins").distinct().count()
    assert averages.slot_aggregate(rows, 60).count() == profile.count()
