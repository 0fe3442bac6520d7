"""The rolling view and the change of rate on a stream.

The last minutes of each series are a ring of minutes in state, each with the value that arrived last; the sample before the next one
is a value in state. So neither sees where micro-batches end, as long as a series' samples come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pastlane.operators.windows import RATE_CHANGE_PERCENT, percent_change
from pastlane.streaming.run import run_batches

MINUTE = "minute long, arrival long, value double"
RING = f"series string, {MINUTE}"
RING_ROW = Row(*[part.split(" ")[0] for part in RING.split(", ")])
SAMPLE = "at long, us_per_msg long"
PAIRS = "series string, at long, us_per_msg long, previous long"
PAIR_ROW = Row(*[part.split(" ")[0] for part in PAIRS.split(", ")])


class RecentMinutes(StatefulProcessor):
    """Keeps the last minutes of a series and gives all that are left after each micro-batch that has rows of it."""

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", MINUTE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring = {minute: (arrival, value) for minute, arrival, value in self.ring.get()}
        for row in rows:
            if row.minute not in ring or ring[row.minute][0] < row.arrival:
                ring[row.minute] = (row.arrival, row.value)
            if len(ring) > 2 * self.minutes:
                ring = self._last(ring)
        ring = self._last(ring)
        self.ring.put([(minute, *last) for minute, last in ring.items()])
        for minute, last in ring.items():
            yield RING_ROW(key[0], minute, *last)

    def _last(self, ring: dict) -> dict:
        newest = max(ring)
        return {minute: last for minute, last in ring.items() if minute > newest - self.minutes}


class PreviousSample(StatefulProcessor):
    """Pairs each sample of a series with the one before it, in the order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", SAMPLE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        samples = sorted((row.at, row.us_per_msg) for row in rows)
        before = self.last.get()
        previous = None if before is None else before[1]
        for at, value in samples:
            yield PAIR_ROW(key[0], at, value, previous)
            previous = value
        self.last.update(samples[-1])


def recent_minutes_stream(
    samples: DataFrame, out: str, checkpoint: str, series: str, value: str, minutes: int = 10, ts: str = "ts", arrival: str = "event_id"
) -> DataFrame:
    """(series, minute, value) of the last ``minutes`` minutes of each series, up to its newest sample."""
    rows = samples.where(F.col(ts).isNotNull()).select(
        F.col(series).cast("string").alias("series"), (F.call_function("div", F.unix_seconds(F.col(ts).cast("timestamp")), F.lit(60))).alias("minute"),
        F.col(arrival).cast("long").alias("arrival"), F.col(value).cast("double").alias("value"))
    rings = rows.groupBy("series").transformWithState(RecentMinutes(minutes), RING, "Append", "None")
    written = run_batches(rings, out, checkpoint, rings.schema)
    newest = written.groupBy(F.col("series").alias("_series")).agg(F.max("batch").alias("_batch"))
    last = written.join(newest, F.col("series").eqNullSafe(F.col("_series")) & (F.col("batch") == F.col("_batch")))
    return last.select("series", F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz").alias("minute"), "value")


def rate_changes_stream(
    rates: DataFrame, out: str, checkpoint: str, series: str | None = None, percent: int = RATE_CHANGE_PERCENT
) -> DataFrame:
    """As ``rate_changes`` for a stream of samples (window_start, us_per_msg), of one series or of several."""
    name = F.lit("all") if series is None else F.col(series).cast("string")
    rows = rates.select(name.alias("series"), F.unix_micros(F.col("window_start").cast("timestamp")).alias("at"), F.col("us_per_msg").cast("long"))
    pairs = rows.groupBy("series").transformWithState(PreviousSample(), PAIRS, "Append", "None")
    change = percent_change(F.col("previous"), F.col("us_per_msg"))
    return run_batches(pairs, out, checkpoint, pairs.schema).select(
        *([] if series is None else ["series"]), F.timestamp_micros("at").cast("timestamp_ntz").alias("window_start"), "us_per_msg", "previous",
        change.alias("percent_change"), F.coalesce(change > percent, F.lit(False)).alias("changed"))
