import random
from datetime import datetime, timedelta

from frames import as_set, at, readings

from pastlane.operators import metrics
from pyspark.sql import functions as F

FIRST = datetime(2011, 4, 11)


def rows_at(spark, *seconds):
    return readings(spark, [(1, 1.0, 1, FIRST + timedelta(seconds=s)) for s in seconds])


def test_empty_period_has_rate_zero(spark):
    counts = metrics.period_counts(rows_at(spark, 0, 1, 29, 95))
    rate = metrics.ingestion_rate(metrics.fill_gaps(counts))
    assert as_set(rate, "window_start", "n", "msgs_per_s", "us_per_msg") == {
        (FIRST, 3, 0.1, 10_000_000),
        (FIRST + timedelta(seconds=30), 0, 0.0, 30_000_000),
        (FIRST + timedelta(seconds=60), 0, 0.0, 30_000_000),
        (FIRST + timedelta(seconds=90), 1, 1 / 30, 30_000_000),
    }


def test_nothing_gives_no_periods(spark):
    counts = metrics.period_counts(rows_at(spark).where("false"))
    assert metrics.fill_gaps(counts).count() == 0


def test_grid_over_several_blocks(spark):
    chance = random.Random(5)
    seconds = [chance.randrange(4 * 86400) for _ in range(300)] + [0, 4 * 86400 - 1]
    filled = metrics.fill_gaps(metrics.period_counts(rows_at(spark, *seconds)))
    periods = {FIRST + timedelta(seconds=30 * n): 0 for n in range(4 * 2880)}
    for s in seconds:
        periods[FIRST + timedelta(seconds=s // 30 * 30)] += 1
    assert as_set(filled, "window_start", "n") == set(periods.items())


def test_gap_filling_counts_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows_at(spark, *range(0, 600, 7)).write.parquet(path)
    filled = metrics.fill_gaps(metrics.period_counts(spark.read.parquet(path)))
    filled.collect()
    assert "ReusedExchange" in filled._jdf.queryExecution().executedPlan().toString()


def test_throughput(spark):
    joined = rows_at(spark, *[n / 100 for n in range(3000)], 31)
    assert as_set(metrics.throughput(joined), "window_start", "n", "rows_per_s", "throughput") == {
        (FIRST, 3000, 100.0, 100), (FIRST + timedelta(seconds=30), 1, 1 / 30, 0),
    }


def test_latency_is_that_of_the_last_row(spark):
    rows = rows_at(spark, 0, 5, 40).withColumn(
        "emit_ts", F.col("ts") + F.expr("INTERVAL 1 SECOND") * (F.col("event_id") + 1)
    )
    assert as_set(metrics.latency(rows), "window_start", "latency_us") == {
        (FIRST, 2_000_000), (FIRST + timedelta(seconds=30), 3_000_000),
    }


def test_metric_lines_are_written_once(spark, tmp_path):
    values = spark.createDataFrame([(1.5,), (2.0,)], "rows_per_s double")
    for _ in range(2):
        path = metrics.write_metric(values, "rows_per_s", str(tmp_path), "Throughput", 8000, 0)
    metrics.write_metric(values.limit(1), "rows_per_s", str(tmp_path), "Throughput", 8000, 1)
    assert path == str(tmp_path / "Throughput_8000" / "batch=0")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["1.5", "2.0"]
    assert spark.read.text(str(tmp_path / "Throughput_8000")).count() == 3


def test_periods_of_any_length(spark):
    counts = metrics.period_counts(rows_at(spark, 0, 3599, 3600), 3600)
    assert as_set(counts, "window_start", "n") == {(FIRST, 2), (at("2011-04-11 01:00:00"), 1)}
