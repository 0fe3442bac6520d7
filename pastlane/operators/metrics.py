"""Ingestion rate, throughput and latency over fixed periods."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: a metric period in seconds.
PERIOD = 30

# Periods per block of the time grid; a block is made by one task.
_BLOCK = 2880


def period_counts(rows: DataFrame, seconds: int = PERIOD, ts: str = "ts") -> DataFrame:
    """Rows per period, for periods that have any."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    return rows.groupBy(start.alias("window_start")).agg(F.count("*").alias("n"))


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def fill_gaps(counts: DataFrame, seconds: int = PERIOD) -> DataFrame:
    """The counts with a 0 for every empty period between the first and last.

    The periods are laid out block by block, so a long time span is neither one
    big array nor the work of one task. They are added up with the counts, which
    are thus computed once: for the span and for the sum.
    """
    first, last = F.min("window_start"), F.max("window_start")
    span = counts.agg(
        _seconds(first).alias("first"), _seconds(last).alias("last"), F.sum("n").alias("rows")
    )
    block = F.lit(_BLOCK * seconds)
    blocks = span.where(F.col("rows") > 0).select(
        "last", F.explode(F.sequence("first", "last", block)).alias("from")
    )
    upto = F.least(F.col("last"), F.col("from") + block - seconds)
    grid = blocks.repartition("from").select(
        F.explode(F.sequence(F.col("from"), upto, F.lit(seconds))).alias("at")
    )
    empty = grid.select(
        F.timestamp_seconds("at").cast("timestamp_ntz").alias("window_start"),
        F.lit(0).cast("long").alias("n"),
    )
    return counts.unionByName(empty).groupBy("window_start").agg(F.sum("n").alias("n"))


def ingestion_rate(counts: DataFrame, seconds: int = PERIOD) -> DataFrame:
    """Messages per second and microseconds per message.

    A period without a message has rate 0 and counts as one message in the second
    figure, so that is the length of the period.
    """
    micros = F.lit(seconds * 1_000_000)
    return counts.select(
        "window_start",
        "n",
        (F.col("n") / F.lit(float(seconds))).alias("msgs_per_s"),
        F.call_function("div", micros, F.greatest("n", F.lit(1))).alias("us_per_msg"),
    )


def throughput(joined: DataFrame, seconds: int = PERIOD, ts: str = "ts") -> DataFrame:
    """Joined rows per period, per second and as the whole number that is reported."""
    whole = F.call_function("div", F.col("n") * 1000, F.lit(seconds * 1000))
    return period_counts(joined, seconds, ts).select(
        "window_start",
        "n",
        (F.col("n") / F.lit(float(seconds))).alias("rows_per_s"),
        whole.alias("throughput"),
    )


def latency(
    rows: DataFrame,
    seconds: int = PERIOD,
    ts: str = "ts",
    emit_ts: str = "emit_ts",
    arrival: str = "event_id",
) -> DataFrame:
    """Microseconds from event to output of the last row to arrive in each period."""
    taken = F.timestamp_diff("MICROSECOND", F.col(ts), F.col(emit_ts))
    start = F.window(emit_ts, f"{seconds} seconds")["start"]
    return rows.groupBy(start.alias("window_start")).agg(
        F.max_by(taken, arrival).alias("latency_us")
    )


def write_metric(values: DataFrame, column: str, folder: str, name: str, rate: int, batch_id: int) -> str:
    """One value per line in a folder named by metric and stream rate.

    Each batch has a folder of its own and replaces it, so a repeated batch does
    not add its lines twice.
    """
    path = os.path.join(folder, f"{name}_{rate}", f"batch={batch_id}")
    values.select(F.col(column).cast("double")).write.mode("overwrite").csv(path)
    return path
