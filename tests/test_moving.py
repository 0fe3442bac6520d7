"""An archive side that arrives, and averages that expire, on streams."""

import os
import random
from datetime import datetime, timedelta

import pytest
from frames import READING, as_rows, as_set, readings
from pyspark.sql import functions as F

from pastlane.operators import windows
from pastlane.sources.live import StreamSource, open_stream
from pastlane.streaming import expiry, moving
from pastlane.streaming.run import start_batches

FIRST = datetime(2024, 1, 1, 8)
AVERAGE = "event_id long, link_id long, hrs int, mins int, avg_speed double, avg_volume double"
DATED = "link_id long, slot timestamp_ntz, avg_speed double"


def stream_of(spark, path, parts, schema):
    """One file a micro-batch."""
    for part in parts:
        frame = part if not isinstance(part, list) else spark.createDataFrame(part, schema)
        frame.coalesce(1).write.mode("append").parquet(str(path))
    return open_stream(spark, StreamSource(spark.createDataFrame([], schema).schema, str(path)), files_per_trigger=1)


def as_of(live, averages):
    """Row by row in the order of arrival."""
    latest, found = {}, []
    events = [(a[0], 1, a) for a in averages] + [(r[0], 0, r) for r in live]
    for _, average, row in sorted(events, key=lambda x: x[:2]):
        if average:
            latest[row[1:4]] = row
        elif (known := latest.get((row[1], row[4].hour, 0))) is not None:
            found.append((row[0], row[1], row[2], known[4], known[5]))
    return found


@pytest.mark.parametrize("parts", [1, 4])
def test_live_rows_get_the_average_as_of_their_arrival(spark, tmp_path, folders, parts):
    rng = random.Random(3)
    live, averages = [], []
    for n in range(600):  # a third of the rows are of one link and hour
        link = 1 if n % 3 else rng.choice([None, 2, 3])
        if rng.random() < 0.15:
            averages.append((n, link, rng.choice([8, 9]), 0, rng.choice([None, float(n)]), float(n % 7)))
        else:
            live.append((n, link, float(n), n, FIRST + timedelta(hours=rng.choice([0, 0, 1, 2]), seconds=n)))
    averages.append((live[5][0], 1, 8, 0, -1.0, -1.0))  # at one number a live row comes first
    joined = moving.moving_archive_join(
        stream_of(spark, tmp_path / "live", [live], READING), stream_of(spark, tmp_path / "averages", [averages], AVERAGE), 60, parts=parts)
    start_batches(joined, **folders).awaitTermination()
    found = spark.read.schema(joined.schema).parquet(folders["out"])
    got = sorted((r.arrival, str(r.link_id), r.speed, str(r.avg_speed), str(r.avg_volume)) for r in found.collect())
    assert got == sorted((a, str(b), c, str(d), str(e)) for a, b, c, d, e in as_of(live, averages)) and len(got) > 200


def test_an_average_that_comes_later_makes_no_output(spark, tmp_path, folders):
    live = [[(1, 1, 1.0, 1, FIRST)], [(5, 1, 5.0, 1, FIRST)], [(9, 1, 9.0, 1, FIRST)]]
    averages = [[(7, 2, 8, 0, 2.0, 2.0)], [(2, 1, 8, 0, 10.0, 1.0)], [(8, 1, 8, 0, 20.0, None)]]
    joined = moving.moving_archive_join(
        stream_of(spark, tmp_path / "live", live, READING), stream_of(spark, tmp_path / "averages", averages, AVERAGE), 60)
    query = start_batches(joined, **folders)
    query.awaitTermination()
    found = spark.read.schema(joined.schema).parquet(folders["out"])
    assert as_set(found, "speed", "avg_speed", "avg_volume") == {(5.0, 10.0, 1.0), (9.0, 20.0, None)}
    states = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert states[-1].numRowsTotal == 2 * moving.PARTS  # one average for each key and part, however many came


def test_kept_averages_equal_the_static_form_after_each_micro_batch(spark, tmp_path, folders):
    """The clock goes over midnight, and once back."""
    hours = [(20, 22), (23, 24), (21, 22), (25, 27)]
    live = [[(10 * n + k, 1, 1.0, 1, FIRST.replace(hour=0) + timedelta(hours=h, minutes=31)) for k, h in enumerate(part)] for n, part in enumerate(hours)]
    slots = [FIRST.replace(hour=0) + timedelta(minutes=5 * n) for n in range(0, 12 * 36)]
    averages = [[(n % 5, slot, float(n)) for n, slot in enumerate(slots) if n % 4 == part] for part in range(4)]
    left, out = [], folders["out"]
    for n in range(4):
        kept = expiry.expiry_stream(
            stream_of(spark, tmp_path / "live", live[n:n + 1], READING), stream_of(spark, tmp_path / "averages", averages[n:n + 1], DATED), **folders)
        arrived = spark.createDataFrame(sum(averages[:n + 1], []), DATED)
        # what has expired stays away, so the clock that counts is the furthest that a micro-batch ended with
        last = max(part[-1][4] for part in live[:n + 1])
        clock = spark.createDataFrame([(last,)], "clock timestamp_ntz")
        assert as_rows(kept) == as_rows(windows.unexpired_dated(arrived, clock))
        folders_now = [d for batch in os.listdir(f"{out}/kept") for d in os.listdir(f"{out}/kept/{batch}") if d.startswith("slot_day")]
        assert min(d[-8:] for d in folders_now) >= last.strftime("%Y%m%d")
        left.append(len(folders_now))
    assert expiry.read_clock(spark, out).orderBy("batch").first().ts == live[0][-1][4]
    assert expiry.read_clock(spark, out).where("batch = 2").first().ts == live[2][-1][4]
    assert expiry.evict(spark, out) == 0 and left == [2, 2, 3, 4]  # of eight folders


def test_nothing_expires_without_live_rows(spark, tmp_path, folders):
    averages = [[(1, FIRST, 1.0), (2, None, 2.0)]]
    none = spark.createDataFrame([], READING)
    kept = expiry.expiry_stream(stream_of(spark, tmp_path / "live", [none], READING), stream_of(spark, tmp_path / "averages", averages, DATED), **folders)
    assert as_set(kept, "link_id") == {(1,)}
