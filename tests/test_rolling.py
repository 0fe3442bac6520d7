"""The profile that moves on day by day, and joins between routed tables."""

import re
from datetime import date, datetime, timedelta

import pytest
from frames import as_rows, as_set, plan_text, readings
from pyspark.sql import functions as F

from pastlane.operators import averages, joins, rolling, routed

FIRST = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def archive(spark):
    rows = []
    for n in range(1200):  # sixteen days, with nulls, and a link that comes on two days only
        link = 7 if n % 400 == 3 else n % 5
        rows.append((link, None if n % 11 == 0 else n * 1.37, None if n % 7 == 0 else n, FIRST + timedelta(minutes=19 * n)))
    return readings(spark, rows)


def recomputed(archive, last, days):
    first = datetime.combine(last, datetime.min.time()) - timedelta(days=days - 1)
    rows = archive.where((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(first + timedelta(days=days)).cast("timestamp_ntz")))
    return averages.slot_aggregate(rows, 60)


def rounded(df):
    return as_rows(df.select("link_id", "hrs", "mins", "count_rec", *[F.round(x, 9).alias(x) for x in ("avg_speed", "avg_volume")]))


def test_ten_days_equal_full_recomputation(archive, tmp_path):
    path, last = str(tmp_path / "profile"), date(2024, 1, 4)
    profile = rolling.start_profile(archive, path, last, 4, 60)
    assert rounded(profile) == rounded(recomputed(archive, last, 4))
    for n in range(1, 11):
        day = last + timedelta(days=n)
        profile = rolling.advance_profile(archive, path, day, 4, 60)
        assert rounded(profile) == rounded(recomputed(archive, day, 4))
    assert profile.where("link_id = 7").count() < recomputed(archive, date(2024, 1, 16), 16).where("link_id = 7").count()


def test_a_move_reads_two_days_and_can_be_repeated(spark, archive, tmp_path):
    path, last = str(tmp_path / "profile"), date(2024, 1, 4)
    rolling.start_profile(archive, path, last, 4, 60)
    once = rounded(rolling.advance_profile(archive, path, date(2024, 1, 5), 4, 60))
    assert rounded(rolling.advance_profile(archive, path, date(2024, 1, 5), 4, 60)) == once
    two = rolling.read_days(archive, path, [date(2024, 1, 1), date(2024, 1, 5)])
    files = {re.search(r"day=([\d-]+)", row[0]).group(1) for row in two.select(F.input_file_name()).distinct().collect()}
    assert files == {"2024-01-01", "2024-01-05"}
    assert "PartitionFilters: [day" in re.sub(r"#\d+", "", plan_text(rolling.moved(archive, path, date(2024, 1, 5), 4)))


def test_days_without_rows_and_before_the_archive(spark, tmp_path):
    path = str(tmp_path / "profile")
    rows = readings(spark, [(1, 2.0, None, FIRST), (1, 4.0, 3, FIRST + timedelta(days=1))])
    rolling.start_profile(rows, path, date(2024, 1, 2), 2, 60)
    after = rolling.advance_profile(rows, path, date(2024, 1, 3), 2, 60)
    assert as_set(after, "link_id", "count_rec", "avg_speed", "avg_volume") == {(1, 1, 4.0, 3.0)}
    assert rolling.advance_profile(rows, path, date(2024, 1, 4), 2, 60).count() == 0
    assert rolling.start_profile(rows.limit(0), str(tmp_path / "none"), date(2024, 1, 2), 2, 60).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_routed_tables_join_without_exchange(spark, archive, how):
    live = readings(spark, [(n % 9 if n % 13 else None, float(n), n, FIRST + timedelta(days=20, minutes=31 * n)) for n in range(300)])
    profile = averages.averages_of(averages.slot_aggregate(archive, 60))
    left, right = routed.route(joins.with_slot_keys(live, 60), 4, "test_live"), routed.route(profile, 4, "test_averages")
    try:
        joined = routed.routed_join(left, right, how)
        want = joins.live_archive_join(live, profile, 60, how)
        assert as_rows(joined) == as_rows(want) and joined.count() > 50
        plan = plan_text(joined)
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    finally:
        for name in ("test_live", "test_averages"):
            routed.drop_routed(spark, name)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("test_")]
