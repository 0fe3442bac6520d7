from datetime import datetime, timedelta

import pytest
from frames import LINKS, as_set, at, plan_text, readings

from pastlane.functions.time import day_aligned_instants, ntz, slot_start
from pastlane.model import ARCHIVE_SCHEMA
from pastlane.operators import averages, filters
from pastlane.sources import archive
from pastlane.sources.links import read_links, unique_links
from pyspark.sql import functions as F

FIRST = datetime(2011, 4, 11)


def six_days(speeds, volume=0, hour="00:00"):
    return [
        (103015784, speed, volume, at(f"2011-04-{11 + day} {hour}:00"))
        for day, speed in enumerate(speeds)
    ]


@pytest.fixture
def parquet(spark, tmp_path):
    rows = [
        (n % 7, float(n), n, FIRST + timedelta(minutes=5 * n)) for n in range(6 * 288)
    ]
    path = str(tmp_path / "archive")
    readings(spark, rows).select("link_id", "speed", "volume", "ts").write.parquet(path)
    return path


def test_range_is_half_open_ordered_and_pushed_down(spark, parquet):
    rows = archive.read_archive(spark, parquet)
    df = archive.range_scan(rows, FIRST, FIRST + timedelta(minutes=5))
    assert [row.ts for row in df.collect()] == [FIRST]
    plan = plan_text(df)
    assert "GreaterThanOrEqual(ts,2011-04-11T00:00)" in plan
    assert "LessThan(ts,2011-04-11T00:05)" in plan
    hour = archive.range_scan(rows, FIRST, FIRST + timedelta(hours=1)).collect()
    assert [row.link_id for row in hour] == sorted(row.link_id for row in hour)


def test_day_aligned_scan_is_pushed_down(spark, parquet):
    rows = archive.read_archive(spark, parquet)
    instants = day_aligned_instants(FIRST + timedelta(hours=8), 6)
    df = archive.day_aligned_scan(rows, instants)
    assert sorted(row.ts for row in df.collect()) == instants
    assert "In(ts" in plan_text(df)
    slots = archive.day_aligned_scan(rows, instants, timedelta(hours=1))
    assert slots.count() == 6 * 12
    assert "Or(" in plan_text(slots)


def test_partition_column_prunes_files(spark, tmp_path):
    rows = [(1, 1.0, 1, FIRST + timedelta(days=n)) for n in range(4)]
    path = str(tmp_path / "by_day")
    by_day = readings(spark, rows).withColumn("day", F.to_date("ts"))
    by_day.write.partitionBy("day").parquet(path)
    kept = archive.in_range(
        spark.read.parquet(path), FIRST + timedelta(days=1), FIRST + timedelta(days=3), day="day"
    )
    assert kept.count() == 2
    plan = plan_text(kept)
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_database_predicates_cover_the_range_once():
    start, end = datetime(2011, 4, 11), datetime(2011, 4, 12, 6)
    predicates = archive.day_predicates(start, end, pieces=4)
    bounds = [part.split("'")[1::2] for part in predicates]
    assert len(predicates) == 5
    assert bounds[0][0].startswith("2011-04-11 00:00:00")
    assert bounds[-1][1].startswith("2011-04-12 06:00:00")
    assert all(before[1] == after[0] for before, after in zip(bounds, bounds[1:]))


def test_database_rows_take_the_archive_form(spark):
    """The reader's arguments and the form of its rows, without a database."""
    asked = {}

    class Reader:
        def option(self, name, value):
            assert (name, value) == ("preferTimestampNTZ", True)
            return self

        def jdbc(self, url, table, predicates, properties):
            asked.update(url=url, table=table, predicates=predicates, properties=properties)
            stored = "LINKID int, SPEED float, VOLUME int, TIME_STAMP timestamp_ntz"
            return spark.createDataFrame([(7, 1.5, 3, FIRST)], stored)

    class Session:
        read = Reader()

    rows = archive.read_archive_jdbc(Session(), "jdbc:x", FIRST, FIRST + timedelta(days=2), pieces=3)
    assert rows.schema == ARCHIVE_SCHEMA and rows.collect() == [(7, 1.5, 3, FIRST)]
    assert len(asked["predicates"]) == 6 and asked["properties"] == {"fetchsize": "10000"}


def test_average_of_six_days_in_both_numeric_forms(spark):
    # Six speeds with the sum 233, as behind a logged average.
    rows = readings(spark, six_days([40.0, 39.0, 38.0, 38.0, 39.0, 39.0], 1))
    (plain,) = averages.day_aligned_average(rows, FIRST).collect()
    assert plain.avg_speed == pytest.approx(38.8333333333)
    assert (plain.hrs, plain.mins, plain.avg_volume) == (0, 0, 1.0)
    (narrow,) = averages.day_aligned_average(rows, FIRST, reference_numeric=True).collect()
    assert narrow.avg_speed == 38.83330154418945


def test_whole_volume_drops_the_fraction(spark):
    rows = readings(spark, [(1, 1.0, v, FIRST) for v in (1553, 1554, 1554)])
    (row,) = averages.day_aligned_average(rows, FIRST, reference_numeric=True).collect()
    assert row.avg_volume == 1553


def test_nulls_are_skipped_or_count_as_zero(spark):
    rows = readings(spark, six_days([10.0, 10.0, 10.0, 10.0, 10.0, None]))
    (skipped,) = averages.slot_aggregate(rows, 5).collect()
    assert (skipped.count_rec, skipped.avg_speed) == (6, 10.0)
    (zero,) = averages.slot_aggregate(rows, 5, null_as_zero=True).collect()
    assert zero.avg_speed == pytest.approx(50 / 6)


def test_group_of_nulls_is_not_passed_on(spark):
    rows = readings(spark, [(1, None, 5, FIRST), (2, 3.0, 5, FIRST), (3, 3.0, None, FIRST)])
    kept = filters.without_null_averages(averages.slot_aggregate(rows, 5))
    assert as_set(kept, "link_id") == {(2,)}


def test_row_off_the_grid_is_only_in_the_slot_aggregate(spark):
    rows = readings(spark, [(1, 10.0, 1, FIRST), (1, 20.0, 1, FIRST + timedelta(minutes=2))])
    (slot,) = averages.slot_aggregate(rows, 5).collect()
    assert slot.avg_speed == 15.0
    exact = averages.day_aligned_average(archive.day_aligned_scan(rows, [FIRST]), FIRST)
    assert exact.collect()[0].avg_speed == 10.0


def test_row_at_the_end_of_a_slot_is_in_the_next(spark):
    rows = readings(spark, [(1, 1.0, 1, at("2011-04-11 00:05:00"))])
    assert as_set(averages.slot_aggregate(rows, 5), "hrs", "mins") == {(0, 5)}
    assert as_set(averages.slot_counts(rows, 5), "slot") == {(at("2011-04-11 00:05:00"),)}


@pytest.mark.parametrize("minutes,expected", [(5, (13, 55)), (60, (13, 0)), (90, (13, 30)), (720, (12, 0))])
def test_slots_of_any_width_that_fills_a_day(spark, minutes, expected):
    rows = readings(spark, [(1, 1.0, 1, at("2011-04-11 13:59:59"))])
    assert as_set(averages.slot_aggregate(rows, minutes), "hrs", "mins") == {expected}


def test_slots_that_do_not_fill_a_day_are_refused(spark):
    with pytest.raises(ValueError):
        averages.slot_aggregate(readings(spark, []), 7)


def test_all_slots_equal_one_slot_at_a_time(spark, parquet):
    rows = archive.read_archive(spark, parquet)
    every = averages.all_slots_average(rows, 5)
    for minute in (0, 485, 1435):
        first = FIRST + timedelta(minutes=minute)
        one = averages.day_aligned_average(
            archive.day_aligned_scan(rows, day_aligned_instants(first, 6)), first
        )
        columns = ["link_id", "avg_speed", "avg_volume", "hrs", "mins"]
        mine = every.where((F.col("hrs") == first.hour) & (F.col("mins") == first.minute))
        assert as_set(mine, *columns) == as_set(one, *columns)


def test_parity_leaves_an_odd_negative_link_out(spark):
    links = [(-7, 1.0, 1, FIRST + timedelta(minutes=m)) for m in (0, 1, 5)]
    rows = readings(spark, links)
    assert filters.parity_live(rows).count() == 0
    slotted = rows.withColumn("slot", slot_start("ts", 5))
    assert filters.parity_archive(slotted, ntz(FIRST), 5).count() == 0


def test_parity_of_the_archive_counts_slots_from_the_start(spark):
    start = FIRST + timedelta(minutes=5)
    rows = readings(spark, [(link, 1.0, 1, start + timedelta(minutes=5 * n)) for link in (1, 2) for n in (0, 1)])
    kept = filters.parity_archive(rows.withColumn("slot", slot_start("ts", 5)), ntz(start), 5)
    assert as_set(kept, "link_id", "ts") == {(2, start), (1, start + timedelta(minutes=5))}


def test_link_lines_keep_three_columns(spark, tmp_path):
    (tmp_path / "links.csv").write_text("1,46.0,-61.0,ignored\n2,45.5,-60.5\n")
    links = read_links(spark, str(tmp_path / "links.csv"))
    assert as_set(links, "link_id", "x", "y") == {(1, 46.0, -61.0), (2, 45.5, -60.5)}


def test_link_given_twice(spark):
    links = spark.createDataFrame([(1, 1.0, 1.0, 1), (1, 2.0, 2.0, 2), (2, 3.0, 3.0, 3)], LINKS + ", line int")
    last = unique_links(links, order_by="line")
    assert as_set(last, "link_id", "x", "y") == {(1, 2.0, 2.0), (2, 3.0, 3.0)}
    with pytest.raises(Exception, match="link given twice: 1"):
        unique_links(links).collect()
    assert unique_links(links.where("line > 1")).count() == 2


def test_link_without_place_is_dropped(spark):
    links = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 5.0)], LINKS)
    rows = readings(spark, [(1, 1.0, 1, FIRST), (2, 1.0, 1, FIRST), (3, 1.0, 1, FIRST)])
    kept = filters.in_region(rows, links, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))")
    assert as_set(kept, "link_id", "x", "y") == {(1, 5.0, 5.0)}


def test_day_substreams_hold_the_archive(spark, parquet):
    rows = archive.read_archive(spark, parquet)
    days = averages.day_averages(averages.day_substreams(rows, FIRST))
    assert as_set(days, "day_index", "count_rec") == {(n, 288) for n in range(6)}
