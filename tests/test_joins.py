import random
from datetime import datetime, timedelta

import pytest
from frames import LINKS, as_rows, as_set, at, plan_text, readings

from pastlane.operators import averages, hot, joins, windows
from pastlane.plans import pipelines
from pyspark.sql import Window, functions as F

FIRST = datetime(2011, 4, 11)
LIVE = datetime(2011, 4, 17)


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 readings; link 1 has a third of them, all in one hour of one day."""
    chance = random.Random(3)
    rows = []
    for n in range(3000):
        if n % 3 == 0:
            rows.append((1, float(n), n % 11, FIRST + timedelta(seconds=chance.randrange(3600))))
        else:
            rows.append((chance.randrange(2, 60), float(n), n % 13,
                         FIRST + timedelta(seconds=chance.randrange(3 * 86400))))
    return readings(spark, rows).cache()


def test_golden_row(spark):
    speeds = [40.0, 39.0, 38.0, 38.0, 39.0, 39.0]
    rows = [(103015784, s, 0, FIRST + timedelta(days=n)) for n, s in enumerate(speeds)]
    live = readings(spark, [(103015784, 85.0, 0, LIVE)])
    profile = averages.day_aligned_average(readings(spark, rows), FIRST, reference_numeric=True)
    (row,) = joins.live_archive_join(live, profile, 5).collect()
    assert row == (103015784, 85.0, 0, 103015784, 38.83330154418945, 0, LIVE)


def test_live_row_without_history(spark):
    live = readings(spark, [(1, 5.0, 1, LIVE), (2, 6.0, 1, LIVE), (1, 7.0, 1, LIVE + timedelta(hours=1))])
    profile = pipelines.archive_profile(readings(spark, [(1, 50.0, 1, FIRST), (9, 1.0, 1, FIRST)]), 60)
    inner = joins.live_archive_join(live, profile, 60)
    assert as_set(inner, "link_id", "speed", "avg_speed") == {(1, 5.0, 50.0)}
    left = joins.live_archive_join(live, profile, 60, "left")
    assert as_set(left, "speed", "hist_link_id", "avg_speed") == {
        (5.0, 1, 50.0), (6.0, None, None), (7.0, None, None),
    }
    history = averages.link_history(readings(spark, [(1, 50.0, 1, FIRST), (1, 70.0, 1, FIRST)]))
    found = joins.live_history_lookup(live, history)
    assert as_set(found, "speed", "hist_link", "hist_avg") == {
        (5.0, 1, 60.0), (6.0, None, None), (7.0, 1, 60.0),
    }


def test_average_without_live_row_makes_no_output(spark):
    live = readings(spark, [(1, 5.0, 1, LIVE)])
    profile = pipelines.archive_profile(readings(spark, [(2, 50.0, 1, FIRST)]), 60)
    assert joins.live_archive_join(live, profile, 60, "left").count() == 1
    assert joins.live_archive_join(live, profile, 60).count() == 0


def test_keys_of_different_types_are_refused(spark, skewed):
    keyed = spark.createDataFrame([(1, 2.0)], "link_id int, a double")
    with pytest.raises(ValueError, match="link_id is bigint and int"):
        hot.keyed_join(skewed, keyed, ["link_id"])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_split_by_adaptive_execution(spark, skewed, how):
    """Without broadcast: the same rows, and the hot link's in several tasks."""
    profile = skewed.where("link_id < 30").groupBy("link_id").agg(F.avg("speed").alias("a"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        # Several map tasks: a piece of a skewed partition is what some of them wrote.
        joined = hot.keyed_join(skewed.repartition(8), profile, ["link_id"], how)
        placed = joined.withColumn("task", F.spark_partition_id()).collect()
        assert sorted(tuple(map(repr, row[:-1])) for row in placed) == sorted(
            tuple(map(repr, row)) for row in skewed.join(F.broadcast(profile), "link_id", how).collect())
        assert len({row.task for row in placed if row.link_id == 1}) > 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_rows_without_key_survive_a_left_join(spark):
    rows = readings(spark, [(None, float(n), n, LIVE) for n in range(20)] + [(1, 1.0, 1, LIVE)])
    keyed = spark.createDataFrame([(1, 9.0)], "link_id long, a double")
    joined = hot.keyed_join(rows, keyed, ["link_id"], "left")
    assert joined.count() == 21 and joined.where("a = 9").count() == 1


def test_a_link_given_twice_does_not_double_its_readings(spark):
    links = spark.createDataFrame(
        [(1, 5.0, 5.0, 1), (1, 50.0, 5.0, 2), (2, 5.0, 5.0, 1), (2, 6.0, 5.0, 2)], LINKS + ", line int")
    live = readings(spark, [(1, 1.0, 1, LIVE), (2, 2.0, 1, LIVE)])
    past = readings(spark, [(1, 10.0, 1, FIRST), (2, 20.0, 1, FIRST)])
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
    for joined in (pipelines.live_with_archive(live, past, links, wkt, 60, latest_by="line"),
                   pipelines.default_run(live, past, links, wkt, FIRST, 60, latest_by="line")):
        assert as_set(joined, "link_id", "avg_speed") == {(2, 20.0)}  # link 1 has moved away
    with pytest.raises(Exception, match="link given twice"):
        pipelines.live_with_archive(live, past, links, wkt, 60).collect()


def test_only_lookups_are_joined(spark, skewed):
    with pytest.raises(ValueError):
        hot.keyed_join(skewed, skewed, ["link_id"], "full")


@pytest.mark.parametrize("piece_rows", [500, 100_000])
def test_positions_equal_plain_row_numbers(spark, skewed, piece_rows):
    odd = readings(spark, [(None, 1.0, 1, LIVE), (None, 2.0, 1, FIRST), (1, 3.0, 1, None), (1, 4.0, 1, FIRST)])
    rows = skewed.unionByName(odd.withColumn("event_id", F.col("event_id") + 10_000))
    for keys in (["link_id"], ["link_id", "volume"]):
        order = Window.partitionBy(*keys).orderBy("ts", "event_id")
        plain = rows.withColumn("position", F.row_number().over(order).cast("long") - 1)
        assert as_rows(hot.with_position(rows, keys, piece_rows=piece_rows)) == as_rows(plain)


def test_no_piece_of_a_hot_group_is_large(spark):
    """One key has a third of two million rows, and half of those have one time."""
    n = 2_000_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("link_id"),
        F.timestamp_seconds(F.when(F.col("id") % 6 == 0, 5000).otherwise(F.col("id") % 86_400)).cast("timestamp_ntz").alias("ts"))
    whole, cut = hot.in_pieces(rows, ["link_id"], ["ts", "event_id"])
    assert whole.groupBy("link_id").count().agg(F.max("count")).first()[0] <= hot.PIECE_ROWS
    pieces = cut.groupBy("link_id", "_piece").count()
    assert pieces.agg(F.max("count")).first()[0] < 2 * hot.PIECE_ROWS and pieces.count() >= n / 3 / hot.PIECE_ROWS
    placed = hot.with_position(rows, ["link_id"]).groupBy("link_id").agg(
        F.max("position").alias("last"), F.count("*").alias("n"), F.count_distinct("position").alias("different"))
    assert placed.where("last <> n - 1 or n <> different").count() == 0


def test_plans_read_the_readings_twice_at_most(spark, tmp_path):
    """With nothing broadcast: once live, once archive; once numbered, once counted."""
    path = str(tmp_path / "readings")
    readings(spark, [(n % 5, 1.0, 1, FIRST + timedelta(hours=n)) for n in range(200)]).write.parquet(path)
    stored = spark.read.parquet(path)
    links = spark.createDataFrame([(1, 5.0, 5.0)], LINKS)
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [pipelines.live_with_archive(stored, stored, links, wkt, 60),
                 windows.length_batch(stored, 60), windows.every_nth(stored, 10, 5)]
        for plan in map(plan_text, plans):
            first = plan.split("(1) Scan")[0]  # the tree, before the details of its nodes
            assert first.count("Scan parquet") <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_change_nothing(spark, skewed):
    profile = pipelines.archive_profile(skewed, 60)
    joined = joins.live_archive_join(skewed, profile, 60)
    buckets = joins.bucketed_join_counts(joined, 5)
    assert buckets.agg(F.sum("n")).collect()[0][0] == joined.count() == 3000
    negative = readings(spark, [(-7, 1.0, 1, LIVE)])
    placed = windows.every_nth(negative, 1, 5)
    assert as_set(placed, "bucket") == {(3,)}


def test_region_is_taken_on_both_sides(spark):
    links = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 5.0)], LINKS)
    live = readings(spark, [(1, 1.0, 1, LIVE), (2, 2.0, 1, LIVE)])
    past = readings(spark, [(1, 10.0, 1, FIRST), (2, 20.0, 1, FIRST)])
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
    joined = pipelines.live_with_archive(live, past, links, wkt, 60)
    assert as_set(joined, "link_id", "avg_speed") == {(1, 10.0)}


def test_fetched_slot_takes_the_instants_only(spark):
    links = spark.createDataFrame([(1, 5.0, 5.0)], LINKS)
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
    past = readings(spark, [
        (1, 10.0, 1, at("2011-04-11 08:00:00")), (1, 20.0, 1, at("2011-04-12 08:00:00")),
        (1, 99.0, 1, at("2011-04-12 08:01:00")),
    ])
    live = readings(spark, [(1, 7.0, 1, at("2011-04-13 08:00:00")), (1, 8.0, 1, at("2011-04-13 09:00:00"))])
    joined = pipelines.live_with_fetched_slot(live, past, links, wkt, at("2011-04-11 08:00:00"), 2)
    assert as_set(joined, "speed", "avg_speed") == {(7.0, 15.0)}


def test_shedding_by_parity(spark):
    rows = [(link, 1.0, 1, FIRST + timedelta(hours=h)) for link in (2, 3) for h in (0, 1)]
    past = readings(spark, rows)
    live = readings(spark, [(link, s, v, ts + timedelta(days=6)) for link, s, v, ts in rows])
    both = pipelines.live_with_archive_by_parity(live, past, FIRST, 60)
    assert as_set(both, "link_id", F.hour("ts")) == {(2, 0), (3, 1)}
    assert pipelines.live_with_archive_by_parity(live, past, FIRST, 60, by_parity=False).count() == 4
