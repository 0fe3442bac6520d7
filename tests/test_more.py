"""Floating periods, needed links, regions of many vertices, and the views of a stream."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from frames import as_rows, as_set, plan_text, readings
from pyspark.sql import functions as F

from pastlane.operators import filters, metrics, needed, periods, regions, windows
from pastlane.plans import pipelines
from pastlane.sources.live import StreamSource, open_stream
from pastlane.streaming import recent

FIRST = datetime(2024, 1, 1)


def walked(times, span):
    """Row by row: (first, last, rows) of the periods that a row has ended."""
    found, start = [], None
    for k, at in enumerate(times):
        if start is None:
            start = k
        if at - times[start] >= span:
            found.append((times[start], at, k - start + 1))
            start = None
    return found


@pytest.mark.parametrize("seed", range(3))
def test_periods_equal_a_walk(spark, seed):
    rng, now, rows = random.Random(seed), FIRST, []
    for _ in range(500):
        now += timedelta(seconds=rng.choice([0, 0, 1, 1, 3, 10, 29, 31, 400]))
        rows.append((1, 1.0, 1, now))
    frame = readings(spark, [*rows, (2, 2.0, 2, None)]).withColumn("emit_ts", F.col("ts") + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)")))
    want = {(a, b, n, 1000 * n // int((b - a) / timedelta(milliseconds=1))) for a, b, n in walked([r[3] for r in rows], timedelta(seconds=30))}
    for piece_rows in (10_000, 60, 7):
        found = periods.floating_periods(frame, 30, emit_ts="emit_ts", piece_rows=piece_rows)
        assert as_set(found, "first_ts", "last_ts", "n", "throughput") == want
        late = {r.last_ts: r.latency_us for r in found.collect()}
        assert all(frame.where(F.col("event_id") == v // 10**6).first().ts == k for k, v in list(late.items())[:3])
    assert periods.floating_periods(frame.limit(0)).count() == 0
    assert periods.floating_periods(frame.where("event_id = 0")).count() == 0


def test_only_links_with_live_rows_are_averaged(spark):
    links = [0, 1, 5, 32_768, 32_769, 65_536, 10**12, -1, -40_000]
    rows = spark.createDataFrame([(n, 1.0) for n in [*links, 2, 4, 7, 32_770, 10**12 + 1, -2, None]], "link_id long, speed double")
    bits = needed.link_bits(spark.createDataFrame([(n,) for n in [*links, *links, None]], "link_id long"))
    assert as_set(needed.of_links(rows, bits), "link_id") == {(n,) for n in links}
    assert needed.of_links(rows, needed.link_bits(rows.limit(0))).count() == 0
    live = readings(spark, [(1, 1.0, 1, FIRST + timedelta(days=3, hours=h)) for h in range(3)])
    archive = readings(spark, [(n % 4, float(n), n, FIRST + timedelta(hours=n)) for n in range(60)])
    place = spark.createDataFrame([(n, 1.0, 1.0) for n in range(4)], "link_id long, x double, y double")
    wkt = "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"
    joined = pipelines.live_with_needed_archive(live, archive, place, wkt, 60)
    assert as_rows(joined) == as_rows(pipelines.live_with_archive(live, archive, place, wkt, 60)) and joined.count() > 0
    plan = plan_text(joined)
    assert plan.index("HashAggregate") < plan.index("bitmap_construct_agg")  # the look-up stands below the average


def _star(n):
    ring = [(math.cos(2 * math.pi * k / n) * (2 + k % 2), math.sin(2 * math.pi * k / n) * (2 + k % 2)) for k in range(n)]
    return [*ring, ring[0]]


def _wkt(*rings):
    return f"POLYGON({', '.join('(' + ', '.join(f'{x!r} {y!r}' for x, y in ring) + ')' for ring in rings)})"


def test_strips_equal_the_one_expression(spark):
    shell = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    for wkt in (_wkt(shell, hole), _wkt(_star(40))):
        points = [(x / 4, y / 4) for x in range(-14, 46) for y in range(-14, 46)] + shell + hole + _star(40)
        rows = [(n, x, y) for n, (x, y) in enumerate(points)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)]
        links = spark.createDataFrame(rows, "link_id long, x double, y double").withColumn("strip", F.lit(1)).withColumn("edges", F.lit(2))
        want = filters.region_links(links, wkt)
        assert as_rows(regions.region_links_by_strips(links, wkt)) == as_rows(want) and want.count() > 50


def test_a_hundred_thousand_vertices(spark):
    ring = _star(100_000)
    draw = np.random.default_rng(4)
    points = [*map(tuple, draw.uniform(-3.2, 3.2, (2000, 2)).tolist()), *ring[:200], *[((a[0] + b[0]) / 2, 0.0) for a, b in zip(ring[:5], ring[1:6])]]
    links = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(points)], "link_id long, x double, y double")
    found = {r.link_id for r in regions.region_links_by_strips(links, _wkt(ring)).collect()}
    a, b = np.array(ring[:-1]), np.array(ring[1:])
    for n, (x, y) in enumerate(points[:600]):
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]) * (y - a[:, 1]) + a[:, 0]
        odd = (((y < a[:, 1]) != (y < b[:, 1])) & (x < at)).sum() % 2 == 1
        assert (n in found) == bool(odd)
    assert not found & set(range(2000, 2200))  # vertices are out
    strips, _, _ = regions.region_strips(spark, _wkt(ring))
    assert strips.agg(F.sum(F.size("_edges"))).first()[0] <= 5 * 100_000


def stream_of(spark, path, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(path))
    return open_stream(spark, StreamSource(parts[0].schema, str(path)), files_per_trigger=1)


@pytest.mark.parametrize("cuts", [[], [5], [40, 41, 90]])
def test_views_do_not_see_micro_batches(spark, tmp_path, folders, cuts):
    rng, now, rows = random.Random(1), FIRST, []
    for n in range(120):
        now += timedelta(seconds=rng.choice([0, 20, 50, 200]))
        rows.append((n % 3 if n % 10 else None, float(n), n, now))
    frame = readings(spark, rows)
    ends = [0, *cuts, 120]
    parts = [frame.where((F.col("event_id") >= a) & (F.col("event_id") < b)) for a, b in zip(ends, ends[1:])]
    got = recent.recent_minutes_stream(stream_of(spark, tmp_path / "in", parts), series="link_id", value="speed", **folders)
    want = windows.last_per_minute(frame, "link_id", "speed").withColumn("series", F.col("series").cast("string"))
    newest = want.groupBy(F.col("series").alias("_s")).agg(F.max("minute").alias("_m"))
    want = want.join(newest, F.col("series").eqNullSafe(F.col("_s"))).where(F.col("minute") > F.col("_m") - F.expr("INTERVAL 10 MINUTES"))
    assert as_rows(got) == as_rows(want.select("series", "minute", "value"))


@pytest.mark.parametrize("cuts", [[], [1], [3, 4, 20]])
def test_rate_changes_do_not_see_micro_batches(spark, tmp_path, folders, cuts):
    rng = random.Random(2)
    samples = [(FIRST + timedelta(seconds=30 * n), rng.choice([0, 100, 119, 121, 150])) for n in range(40)]
    ends = [0, *cuts, 40]
    rates = spark.createDataFrame(samples, "window_start timestamp_ntz, us_per_msg long")
    parts = [spark.createDataFrame(samples[a:b], rates.schema) for a, b in zip(ends, ends[1:])]
    got = recent.rate_changes_stream(stream_of(spark, tmp_path / "in", parts), **folders)
    want = windows.rate_changes(rates, metrics.PERIOD)
    assert as_rows(got) == as_rows(want.select(*got.columns))
