import os
import random
from datetime import datetime, timedelta

import pytest
from frames import LINKS, READING, as_rows, as_set, at, plan_text, readings

from pyspark.sql import functions as F

from pastlane.model import LIVE_SCHEMA
from pastlane.operators import averages, cutting, filters, joins, metrics, windows
from pastlane.plans import pipelines
from pastlane.sources.live import StreamSource, find_stream, live_from_json, open_stream
from pastlane.streaming import keyed, length_batch as batches, queries as streams
from pastlane.streaming.run import _span, covering, read_batches, start_batches

FIRST = datetime(2011, 4, 11)
WKT = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"


@pytest.fixture(scope="module")
def rows(spark):
    chance = random.Random(11)
    times = sorted(chance.randrange(8 * 86400) for _ in range(1500))
    return readings(spark, [
        (1 if n % 3 == 0 else chance.randrange(2, 12), float(n % 97), n % 17, FIRST + timedelta(seconds=t))
        for n, t in enumerate(times)
    ]).cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """The rows in three files, one for each micro-batch, in the order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    for n in range(3):
        part = rows.where(f"event_id div 500 = {n}").coalesce(1)
        part.write.mode("append").parquet(path)
    return path


@pytest.fixture
def stream(spark, folder):
    source = StreamSource(spark.createDataFrame([], READING).schema, folder)
    return open_stream(spark, source, files_per_trigger=1)


def batch_count(folders):
    return len([d for d in os.listdir(folders["out"]) if d.startswith("batch=") and d != "batch=-1"])


def test_registry_knows_streams_in_any_case():
    source = StreamSource(LIVE_SCHEMA, "/live")
    assert find_stream({"traffic": source}, "TRAFFIC") is source
    with pytest.raises(KeyError, match="weather"):
        find_stream({"traffic": source}, "weather")


def test_readings_from_json(spark):
    texts = [
        ('{"link_id": 5, "ts": "2011-04-17T00:00:01", "speed": 1.5, "volume": 2}',),
        ('{"link_id": 6, "speed": 2.5, "volume": 3, "event_time": "17-Apr-2011 00:00:02.250"}',),
    ]
    rows = live_from_json(spark.createDataFrame(texts, "value string"))
    assert as_set(rows, "link_id", "speed", "ts") == {
        (5, 1.5, at("2011-04-17 00:00:01")), (6, 2.5, at("2011-04-17 00:00:02.250")),
    }
    assert rows.schema == LIVE_SCHEMA


def test_passthrough(stream, rows, folders):
    assert as_rows(streams.passthrough(stream, **folders)) == as_rows(rows)


def test_join_equals_static_join(spark, stream, rows, folders, tmp_path):
    links = spark.createDataFrame([(n, float(n), 5.0) for n in range(1, 15)], LINKS)
    profile = pipelines.archive_profile(rows, 60)
    path = streams.write_profile(profile, str(tmp_path / "profile"))
    stored = spark.read.schema(profile.schema).parquet(path)
    got = streams.live_join_stream(stream, stored, minutes=60, links=links, wkt=WKT, **folders)
    want = joins.live_archive_join(filters.in_region(rows, links, WKT), profile, 60)
    assert batch_count(folders) == 3
    assert as_rows(got.select(*want.columns)) == as_rows(want)
    assert 0 < want.count() < 1500


def test_micro_batch_reads_only_its_hours(spark, rows, tmp_path):
    profile = pipelines.archive_profile(rows, 60)
    path = streams.write_profile(profile, str(tmp_path / "profile"))
    stored = spark.read.schema(profile.schema).parquet(path)
    step = streams.joining(stored, 60)
    morning = step(rows.where("hour(ts) = 8"), 0)
    assert morning.count() == rows.where("hour(ts) = 8").count()
    plan = plan_text(morning)
    assert "hrs" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_slots_of_two_hours_read_the_right_hours(spark, stream, rows, folders, tmp_path):
    profile = pipelines.archive_profile(rows, 120)
    path = streams.write_profile(profile, str(tmp_path / "profile"))
    stored = spark.read.schema(profile.schema).parquet(path)
    got = streams.live_join_stream(stream, stored, minutes=120, **folders)
    want = joins.live_archive_join(rows, profile, 120)
    assert as_rows(got.select(*want.columns)) == as_rows(want) and want.count() == 1500
    odd = rows.where("hour(ts) = 9")
    assert streams.joining(stored, 120)(odd, 0).count() == odd.count() > 0


def test_lookup_equals_static_lookup(stream, rows, folders):
    history = averages.link_history(rows.where("link_id < 6"))
    got = streams.live_lookup_stream(stream, history, **folders)
    want = joins.live_history_lookup(rows, history)
    assert as_rows(got.select(*want.columns)) == as_rows(want)


def test_slots_equal_static_slots(stream, rows, folders):
    got = streams.slot_counts_stream(stream, minutes=60, **folders)
    assert as_rows(got) == as_rows(averages.slot_counts(rows, 60))


def test_periods_equal_static_periods(stream, rows, folders):
    got = streams.period_counts_stream(stream, seconds=3600, **folders)
    assert as_rows(got) == as_rows(metrics.period_counts(rows, 3600))


def test_latest_equals_static_latest(stream, rows, folders):
    got = streams.latest_per_slot_stream(stream, minutes=60, **folders)
    want = windows.latest_per_slot(rows, 60)
    assert as_rows(got.select(*want.columns)) == as_rows(want)


def test_batches_equal_static_batches(stream, rows, folders):
    got = batches.length_batch_stream(stream, minutes=360, **folders)
    want = windows.length_batch(rows, 360)
    assert batch_count(folders) == 3
    assert as_rows(got.select(*want.columns)) == as_rows(want)
    assert want.count() > 100


def test_a_hot_group_over_micro_batches(spark, tmp_path, folders):
    """Most rows are of one group; the open batch goes over micro-batches as the value of its key."""
    path, data = str(tmp_path / "events"), []
    for n in range(3):
        part = [(1 if k % 10 else None, float(k), k, FIRST + timedelta(seconds=1000 * n + k // 2)) for k in range(100 + n)]
        data += part
        readings(spark, part).withColumn("event_id", F.col("event_id") + 1000 * n).coalesce(1).write.mode("append").parquet(path)
    rows = spark.read.schema(spark.createDataFrame([], READING).schema).parquet(path)
    source = StreamSource(rows.schema, path)
    want = windows.length_batch(rows, 1440)
    got = batches.length_batch_stream(open_stream(spark, source, files_per_trigger=1), minutes=1440, **folders)
    assert as_rows(got.select(*want.columns)) == as_rows(want)
    assert want.count() == 45 + 5


def progress_of(emitted, folders):
    """The micro-batches of a run, with what the state store says of each."""
    query = start_batches(emitted, **folders)
    query.awaitTermination()
    return [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]


def test_only_changed_groups_are_written(spark, tmp_path, folders):
    """Of forty open groups a later micro-batch touches three."""
    path = str(tmp_path / "events")
    parts = [[(n, 1.0, 1, FIRST) for n in range(40)], [(n, 2.0, 2, FIRST + timedelta(seconds=1)) for n in range(3)]]
    for part in parts:
        readings(spark, part).coalesce(1).write.mode("append").parquet(path)
    source = StreamSource(spark.createDataFrame([], READING).schema, path)
    states = progress_of(batches.batches_of_stream(open_stream(spark, source, files_per_trigger=1), 1440), folders)
    assert [(s.numRowsUpdated, s.numRowsTotal) for s in states] == [(40, 40), (3, 40)]


def test_state_of_idle_groups_is_removed(spark, tmp_path, folders):
    path = str(tmp_path / "events")
    parts = [[(n, 1.0, 1, FIRST) for n in range(40)], [(99, 2.0, 2, FIRST + timedelta(hours=1))], [(99, 2.0, 2, FIRST + timedelta(hours=1))]]
    for part in parts:
        readings(spark, part).coalesce(1).write.mode("append").parquet(path)
    source = StreamSource(spark.createDataFrame([], READING).schema, path)
    stream = open_stream(spark, source, files_per_trigger=1)
    states = progress_of(batches.batches_of_stream(stream, 1440, idle_seconds=600, lateness="1 minute"), folders)
    assert sum(s.numRowsRemoved for s in states) >= 40 and states[-1].numRowsTotal < 10
    left = read_batches(spark, folders["out"], batches.batches_of_stream(stream, 1440).schema)
    assert left.count() == 40


@pytest.mark.parametrize("files", [1, 3])
def test_idle_gaps_do_not_see_micro_batches(spark, folder, rows, folders, files):
    source = StreamSource(spark.createDataFrame([], READING).schema, folder)
    stream = open_stream(spark, source, files_per_trigger=files)
    got = batches.length_batch_stream(stream, minutes=360, idle_seconds=5400, limit_seconds=20_000, lateness="1 day", **folders)
    found = sorted((str(r.link_id), r.hrs, r.first_ts, r.count_rec) for r in got.collect())
    want = []
    groups = {}
    for r in rows.where("ts is not null").orderBy("ts", "event_id").collect():
        groups.setdefault((str(r.link_id), r.ts.hour // 6 * 6), []).append(r.ts)
    end = max(t for times in groups.values() for t in times) - timedelta(days=1)
    for (link, hrs), times in groups.items():
        batch = []
        for at in [*times, None]:
            ends = batch and (len(batch) == 6 or at is not None and (at - batch[-1] >= timedelta(seconds=5400) or at - batch[0] >= timedelta(seconds=20_000)))
            passed = batch and at is None and (batch[-1] + timedelta(seconds=5400) <= end or batch[0] + timedelta(seconds=20_000) <= end)
            if ends or passed:
                want.append((link, hrs, batch[0], len(batch)))
                batch = []
            batch.append(at)
    assert found == sorted(want) and {n for *_, n in want} >= {1, 6}


@pytest.mark.parametrize("files", [1, 2, 3])
def test_time_limit_does_not_see_micro_batches(spark, folder, rows, folders, files):
    source = StreamSource(spark.createDataFrame([], READING).schema, folder)
    stream = open_stream(spark, source, files_per_trigger=files)
    got = batches.length_batch_stream(stream, minutes=360, limit_seconds=7200, **folders)
    want = cutting.time_length_batch(rows, 360, 6, 7200, ["event_id"])
    assert as_rows(got.select(*want.columns)) == as_rows(want)
    assert 0 < want.where("count_rec < 6").count() < want.count()


def test_idle_groups_are_put_out_and_forgotten(spark, tmp_path, folders):
    path = str(tmp_path / "events")
    parts = [[(1, 1.0, 1, FIRST)], [(2, 2.0, 2, FIRST + timedelta(hours=5))], [(2, 3.0, 3, FIRST + timedelta(hours=6))]]
    for part in parts:
        readings(spark, part).coalesce(1).write.mode("append").parquet(path)
    source = StreamSource(spark.createDataFrame([], READING).schema, path)
    got = batches.length_batch_stream(
        open_stream(spark, source, files_per_trigger=1), minutes=1440, idle_seconds=600, lateness="1 minute", **folders)
    assert as_set(got, "link_id", "count_rec", "avg_speed") == {(1, 1, 1.0), (2, 1, 2.0)}


def live_rows(spark, rows):
    """Readings as the live schema has them, without an event id."""
    return spark.createDataFrame([(link, ts, float(s), float(v), None) for link, s, v, ts in rows], LIVE_SCHEMA)


def test_operators_run_on_the_live_schema(spark, tmp_path, folders):
    data = [(1, n, n % 3, FIRST + timedelta(minutes=n)) for n in range(20)]
    path = str(tmp_path / "live")
    live_rows(spark, data).coalesce(1).write.parquet(path)
    static = spark.read.schema(LIVE_SCHEMA).parquet(path)
    def stream():
        return open_stream(spark, StreamSource(LIVE_SCHEMA, path))

    def at_folder(name):
        return {key: f"{value}-{name}" for key, value in folders.items()}

    latest = windows.latest_per_slot(static, 60, arrival="ts")
    assert as_set(latest, "link_id", "speed") == {(1, 19.0)}
    got = streams.latest_per_slot_stream(stream(), minutes=60, arrival="ts", **at_folder("latest"))
    assert as_rows(got.select(*latest.columns)) == as_rows(latest)
    full = windows.length_batch(static, 60, tie=["speed"])
    assert full.count() == 3
    got = batches.length_batch_stream(stream(), minutes=60, tie=["speed"], **at_folder("batches"))
    assert as_rows(got.select(*full.columns)) == as_rows(full)
    assert windows.every_nth(static, 5, 1, tie="speed").count() == 4
    assert windows.live_clock(static, 60, arrival="ts").count() == 1
    assert windows.last_per_minute(static, "link_id", "speed", arrival="ts").count() == 20
    assert streams.slot_counts_stream(stream(), minutes=60, **at_folder("slots")).count() == 1
    assert streams.period_counts_stream(stream(), seconds=60, **at_folder("periods")).count() == 20


@pytest.mark.parametrize("every", [2, 32])
def test_late_rows_count_and_totals_are_compacted(spark, tmp_path, folders, every):
    """Five micro-batches, of which the last is three days late."""
    path = str(tmp_path / "events")
    parts = [[(n, float(n), 1, FIRST + timedelta(days=n if n < 4 else 0, minutes=k)) for k in range(3)] for n in range(5)]
    for part in parts:
        readings(spark, part).coalesce(1).write.mode("append").parquet(path)
    rows = spark.read.schema(spark.createDataFrame([], READING).schema).parquet(path)
    source = StreamSource(rows.schema, path)
    got = streams.slot_counts_stream(
        open_stream(spark, source, files_per_trigger=1), minutes=60, compact_every=every, **folders)
    assert as_rows(got) == as_rows(averages.slot_counts(rows, 60))
    assert got.agg({"count_rec": "sum"}).first()[0] == 15
    if every == 2:  # what was merged last has all groups up to then, and what it was merged from is gone
        assert spark.read.parquet(f"{folders['out']}/batch=3").count() == 4
        assert {name for name in os.listdir(folders["out"]) if "=" in name} == {"batch=-1", "batch=3", "batch=4"}


def test_every_micro_batch_is_covered_once():
    for every in (1, 2, 3, 16):
        for last in range(200):
            parts = covering(last, every)
            spans = [range(part + 1 - _span(part, every), part + 1) for part in parts]
            assert sorted(n for span in spans for n in span) == list(range(last + 1))
    assert len(covering(10**6, 16)) < 16 * 6


def test_a_repeated_micro_batch_leaves_its_rows_once(spark, stream, rows, folders):
    query = start_batches(stream, **folders)
    query.awaitTermination()
    # A crash after writing and before the commit repeats the last micro-batch.
    commits = os.path.join(folders["checkpoint"], "commits")
    for name in ("2", ".2.crc"):
        os.remove(os.path.join(commits, name))
    start_batches(stream, **folders).awaitTermination()
    again = read_batches(spark, folders["out"], rows.schema)
    assert as_rows(again.drop("batch")) == as_rows(rows)


def test_a_stream_goes_on_where_it_stopped(spark, rows, folders, tmp_path):
    path = str(tmp_path / "events")
    source = StreamSource(spark.createDataFrame([], READING).schema, path)
    for n in range(3):
        rows.where(f"event_id div 500 = {n}").coalesce(1).write.mode("append").parquet(path)
        got = batches.length_batch_stream(open_stream(spark, source), minutes=360, **folders)
    want = windows.length_batch(rows, 360)
    assert as_rows(got.select(*want.columns)) == as_rows(want)


def test_no_files_give_no_rows(spark, folders, tmp_path):
    (tmp_path / "none").mkdir()
    source = StreamSource(spark.createDataFrame([], READING).schema, str(tmp_path / "none"))
    got = batches.length_batch_stream(open_stream(spark, source), minutes=60, **folders)
    assert got.count() == 0


def test_subscriber_gets_every_joined_row(spark, stream, rows, folders, tmp_path):
    profile = pipelines.archive_profile(rows, 60)
    path = streams.write_profile(profile, str(tmp_path / "profile"))
    stored = spark.read.schema(profile.schema).parquet(path)
    got = {}

    def subscriber(joined, batch_id):
        got[batch_id] = (joined.columns, joined.count())
        per_second = metrics.throughput(joined, 3600)
        metrics.write_metric(per_second, "rows_per_s", str(tmp_path), "Throughput", 8000, batch_id)

    streams.subscribe_joined(stream, stored, subscriber, folders["checkpoint"], 60).awaitTermination()
    assert sorted(got) == [0, 1, 2] and sum(n for _, n in got.values()) == 1500
    assert got[0][0] == [
        "link_id", "speed", "volume", "hist_link_id", "avg_speed", "avg_volume", "ts", "eval_ts",
    ]
    assert spark.read.text(str(tmp_path / "Throughput_8000")).count() > 100


def test_idle_limit_has_a_floor():
    assert batches.idle_limit_seconds(8000, 0.038) == 304
    assert batches.idle_limit_seconds(100, 0.038) == 20


def test_links_share_keys_and_calls(spark, tmp_path, folders, monkeypatch):
    """However many links there are, the keys of a micro-batch are bounded; the batches are those of each link."""
    monkeypatch.setattr(keyed, "BUCKETS", 8)
    path, first = str(tmp_path / "events"), 1 << 60
    for n in range(3):
        data = [(None if k % 50 == 0 else first + k % 50, float(k), k % 7, FIRST + timedelta(minutes=10 * k + n)) for k in range(300)]
        readings(spark, data).withColumn("event_id", F.col("event_id") + 1000 * n).coalesce(1).write.mode("append").parquet(path)
    source = StreamSource(spark.createDataFrame([], READING).schema, path)
    rows = spark.read.schema(source.schema).parquet(path)
    emitted = batches.batches_of_stream(open_stream(spark, source), 1440, size=5)
    states = progress_of(emitted, folders)
    assert 0 < max(s.numRowsTotal for s in states) <= 9
    want = windows.length_batch(rows, 1440, size=5)
    got = read_batches(spark, folders["out"], emitted.schema)
    assert as_rows(got.select(*want.columns)) == as_rows(want) and want.where("link_id is null").count() and want.where(f"link_id > {first}").count()
