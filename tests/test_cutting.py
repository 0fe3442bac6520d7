"""Batches that end by rows or by time, in pieces, against a walk row by row."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from frames import as_rows, as_set, plan_text, readings
from pyspark.sql import functions as F

from pastlane.operators import cutting, hot

FIRST = datetime(2024, 1, 1, 8)


def walked(times, size, limit):
    """The rows that begin a batch, one after the other."""
    starts, n = [], 0
    for k, at in enumerate(times):
        if not starts or n == size or limit is not None and at - times[starts[-1]] >= limit:
            starts.append(k)
            n = 0
        n += 1
    return starts


def test_starts_equal_a_walk():
    rng = random.Random(1)
    for _ in range(300):
        groups = [sorted(rng.randrange(60) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        size, limit = rng.choice([1, 2, 6, 50]), rng.choice([None, 1, 3, 10, 100])
        want, before = [], 0
        for times in groups:
            want += [before + k for k in walked(times, size, limit)]
            before += len(times)
        first = np.concatenate([np.arange(len(times)) == 0 for times in groups])
        assert cutting.batch_starts(np.array(sum(groups, [])), first, size, limit).tolist() == want


def random_readings(spark, n, seed):
    """Half of the rows are of one group, with runs at one time and long gaps."""
    rng = random.Random(seed)
    rows, now = [], FIRST
    for k in range(n):
        now += timedelta(seconds=rng.choice([0, 0, 1, 5, 20, 300]))
        link = 1 if k % 2 else rng.choice([None, 2, 3, 4, 5])
        rows.append((link, rng.choice([None, float(k), 1.5]), rng.choice([None, k]), now))
    rows.append((9, 1.0, 1, None))
    return readings(spark, rows)


@pytest.mark.parametrize("size,limit", [(6, 60), (6, None), (1, 5), (4, 1), (40, 400)])
def test_pieces_make_no_difference(spark, size, limit):
    rows = random_readings(spark, 700, size)
    cut = lambda piece_rows, partial: as_rows(cutting.time_length_batch(
        rows, 1440, size, limit, ["event_id"], partial, piece_rows).withColumns({x: F.round(x, 6) for x in ("avg_speed", "avg_volume")}))
    for partial in (False, True):
        whole = cut(10_000, partial)
        for piece_rows in (3, 17, 90):
            assert cut(piece_rows, partial) == whole
    every = cutting.time_length_batch(rows, 1440, size, limit, ["event_id"], True, 17)
    assert every.agg(F.sum("count_rec")).first()[0] == 700
    times = [r.ts.timestamp() for r in rows.where("link_id = 1").orderBy("ts", "event_id").collect()]
    firsts = [times[k] for k in walked(times, size, limit)]
    assert sorted(r.first_ts.timestamp() for r in every.where("link_id = 1").collect()) == firsts


def test_a_hot_group_is_cut_by_many_tasks(spark):
    """One group has a third of two million rows; no piece of it has much more than a piece's share."""
    n = 2_000_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("link_id"),
        F.lit(1.0).alias("speed"), F.lit(2).alias("volume"),
        (F.lit(FIRST).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 3600).cast("decimal(18,6)"))).alias("ts"))
    cut = cutting.time_length_batch(rows, 60, 6, 30, ["event_id"], partial=True)
    found = cut.where("link_id = 0").agg(F.sum("count_rec").alias("n"), F.max("count_rec").alias("most"), F.count("*").alias("batches")).first()
    assert found.n == rows.where("link_id = 0").count() and found.most == 6 and found.batches >= found.n / 6
    plan = plan_text(cut)
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    _, pieces = hot.in_pieces(rows, ["link_id"], ["ts", "event_id"])
    assert pieces.groupBy("link_id", "_piece").count().agg(F.max("count")).first()[0] < 2 * hot.PIECE_ROWS


def test_few_rows(spark):
    assert cutting.time_length_batch(readings(spark, []), 60, 6, 30, ["event_id"], True).count() == 0
    one = readings(spark, [(1, None, None, FIRST)])
    assert as_set(cutting.time_length_batch(one, 60, 6, 30, ["event_id"], True), "count_rec", "avg_speed") == {(1, None)}
    assert cutting.time_length_batch(one, 60, 6, 30, ["event_id"]).count() == 0
    assert as_set(cutting.time_length_batch(one, 60, 1, 30, ["event_id"]), "first_ts", "count_rec") == {(FIRST, 1)}
