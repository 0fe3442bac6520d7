"""Batches of n rows or of limited time per link and time of day, on a stream.

The open batches of a bucket of links (see ``keyed``) are one value in Spark's state store, a record for each link and time of day: a
micro-batch reads and writes the buckets that it has rows of, and no others. Time-outs by the stream's own time put out what no more rows will end.

A bucket's rows of one micro-batch come as Arrow batches. They are held by the task that has them, at 8 bytes a column, and sorted and cut
for all groups at once, without a loop over rows or groups. How many rows a
micro-batch can have is bounded by the stream's trigger (see ``open_stream``), whatever share of them one link has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType

from pastlane.operators.cutting import KEYS, SUMS, batch_starts
from pastlane.operators.joins import with_slot_keys
from pastlane.operators.windows import BATCH_ROWS, batch_averages
from pastlane.streaming.keyed import link_bucket, links, of_key, whole
from pastlane.streaming.run import run_batches

# Fixed value: the shortest time, in seconds, that an idle group is kept.
MIN_IDLE_SECONDS = 20

ENDED = f"{KEYS}, first_us long, {SUMS}"
SUM_NAMES = [part.split(" ")[0] for part in SUMS.split(", ")]
GIVEN = {"link_id": "i8", "slot": "i8", "us": "i8", "tie": "i8", "speed": "f8", "volume": "f8"}
# An open batch in state. ``due_ms`` is when the stream's time ends it.
OPEN = np.dtype([("link", "i8"), ("slot", "i8"), ("first_us", "i8"), ("last_us", "i8"), ("sums", "f8", len(SUM_NAMES)), ("due_ms", "i8")])


def idle_limit_seconds(rate_micros: int, prefetch: float) -> int:
    """How long a group may be idle, from the stream's rate and prefetch setting."""
    return max(MIN_IDLE_SECONDS, int(rate_micros * prefetch))


def _sums(speed: np.ndarray, volume: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """count_rec, sum_volume, n_volume, sum_speed, n_speed of the runs of rows that begin at ``starts``."""
    out = [np.diff(starts, append=len(speed))]
    for values in (volume, speed):
        known = ~np.isnan(values)
        out += [np.add.reduceat(np.where(known, values, 0.0), starts), np.add.reduceat(known.astype(np.int64), starts)]
    return np.column_stack(out)


def _changes(link: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Where a group begins, for rows in the order of groups."""
    begins = np.ones(len(link), bool)
    begins[1:] = (link[1:] != link[:-1]) | (slot[1:] != slot[:-1])
    return begins


def open_batches(size: int, limit_us: int | None, idle_us: int | None, timers: bool) -> Callable:
    """Keeps the open batches of a bucket of links; gives those that end.

    ``limit_us`` and ``idle_us`` end a batch by time after its first and its last row: when a row comes that is beyond it, and
    with ``timers`` also when the stream's time, less its lateness, has passed it.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = np.frombuffer(bytes(state.get[0]), OPEN) if state.exists else np.zeros(0, OPEN)
        now = state.getCurrentWatermarkMs() if timers else None
        ended, left = _stepped(now, before, *of_key(rows, GIVEN))
        if len(left):
            state.update((left.tobytes(),))
            if timers:  # a time-out comes when the stream's time is beyond it
                state.setTimeoutTimestamp(int(left["due_ms"].min()) - 1)
        elif state.exists:
            state.remove()
        if len(ended):
            sums = {name: ended["sums"][:, n] if name.startswith("sum_") else whole(ended["sums"][:, n].astype(np.int64))
                    for n, name in enumerate(SUM_NAMES)}
            yield pd.DataFrame({"link_id": links(key[0], ended["link"].copy()), "hrs": whole(ended["slot"] // 60), "mins": whole(ended["slot"] % 60),
                                "first_us": whole(ended["first_us"].copy()), **sums}, copy=False)

    def _stepped(now, before, link, slot, times, tie, speed, volume) -> tuple[np.ndarray, np.ndarray]:
        """The batches that end with rows or by the stream's time, and those that are open then."""
        order = np.lexsort((tie, times, slot, link))
        link, slot, times, speed, volume = link[order], slot[order], times[order], speed[order], volume[order]
        index = np.arange(len(slot))
        begin = np.flatnonzero(_changes(link, slot))  # of each group
        length = np.diff(begin, append=len(slot))
        group = np.repeat(np.arange(len(begin)), length)
        place = index - begin[group]
        # The open batch of each group: in the order of groups and batches together it comes right before.
        both = [np.r_[before[name], new[begin]] for name, new in (("link", link), ("slot", slot))]
        mixed = np.lexsort((np.arange(len(both[0])), both[1], both[0]))
        follows = ~_changes(both[0][mixed], both[1][mixed])
        was, now_has = mixed[:-1][follows[1:]], mixed[1:][follows[1:]] - len(before)
        had = np.zeros(len(begin), bool)
        had[now_has] = True
        old = np.zeros(len(begin), OPEN)
        old[now_has] = before[was]
        # How many of a group's rows its open batch takes.
        gaps = np.diff(times, prepend=0)
        gaps[begin] = times[begin] - old["last_us"]
        wanted = (size - old["sums"][:, 0]).astype(np.int64)
        beyond = place >= wanted[group]
        if limit_us is not None:
            beyond |= times >= (old["first_us"] + limit_us)[group]
        if idle_us is not None:
            beyond |= gaps >= idle_us
        beyond[~had[group]] = True
        taken = np.minimum.reduceat(np.where(beyond, place, length[group]), begin) if len(begin) else length
        # All others are cut from the first one on.
        rest = np.flatnonzero(place >= taken[group])
        first = place[rest] == taken[group[rest]]
        if idle_us is not None:
            first |= gaps[rest] >= idle_us
        starts = rest[batch_starts(times[rest], first, size, limit_us)] if len(rest) else rest
        heads = begin[taken > 0]
        cuts = np.sort(np.r_[heads, starts])
        own = group[cuts]
        found = np.zeros(len(cuts), OPEN)
        found["link"], found["slot"], found["first_us"] = link[cuts], slot[cuts], times[cuts]
        if len(cuts):  # a time-out comes without rows
            found["last_us"] = times[np.append(cuts[1:], len(times)) - 1]
            found["sums"] = _sums(speed, volume, cuts)
        more = (place[cuts] == 0) & (taken > 0)[own]  # goes on with the open batch
        found["sums"][more] += old["sums"][own[more]]
        found["first_us"][more] = old["first_us"][own[more]]
        is_open = (np.diff(own, append=-1) != 0) & (found["sums"][:, 0] < size)  # only the last of a group
        closed = old[had & (taken == 0)]  # the first row is beyond it
        idle = np.delete(before, was)
        left = found[is_open]
        if now is not None:
            ends = [left[name] + span for name, span in (("first_us", limit_us), ("last_us", idle_us)) if span is not None]
            left["due_ms"] = np.maximum(-(-np.minimum.reduce(ends) // 1000), now + 1)
            closed, idle = np.concatenate([closed, idle[idle["due_ms"] <= now]]), idle[idle["due_ms"] > now]
        return np.concatenate([closed, found[~is_open]]), np.concatenate([idle, left])

    return step


def _place(tie: list[str], rows: DataFrame) -> Column:
    """The rows of one time come in the order of one whole number: the tie itself, or a hash of several columns."""
    if len(tie) == 1 and rows.schema[tie[0]].dataType.typeName() in ("long", "integer", "short", "byte"):
        return F.coalesce(F.col(tie[0]).cast("long"), F.lit(-(1 << 63)))
    return F.xxhash64(*tie) if tie else F.lit(0).cast("long")


def batches_of_stream(
    readings: DataFrame,
    minutes: int,
    size: int = BATCH_ROWS,
    limit_seconds: int | None = None,
    tie: str | list[str] = "event_id",
    idle_seconds: int | None = None,
    lateness: str | None = None,
) -> DataFrame:
    """The stream of batches that end.

    A batch ends with ``size`` rows, or when the next row of its group is ``limit_seconds`` or more after its first, or
    ``idle_seconds`` (see ``idle_limit_seconds``) after its last. With ``lateness`` the stream's own time, less that much, ends it
    as a next row would, and the group is forgotten; rows that come later are left out by Spark. An idle time has
    a lateness of ten minutes at least. Without either all rows count, and where micro-batches end does not show.
    ``tie`` orders rows of one time: a column of whole numbers, else any fixed order.
    """
    if lateness is not None and limit_seconds is None and idle_seconds is None:
        raise ValueError("lateness needs a limit or an idle time")
    if idle_seconds is not None and lateness is None:
        lateness = "10 minutes"
    tie = [name for name in ([tie] if isinstance(tie, str) else tie) if name not in ("ts", "speed", "volume")]
    rows = with_slot_keys(readings, minutes).where("ts is not null").select(
        link_bucket(F.col("link_id").cast(LongType())).alias("bucket"), F.coalesce(F.col("link_id").cast(LongType()), F.lit(0)).alias("link_id"),
        (F.col("hrs") * 60 + F.col("mins")).cast("long").alias("slot"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        _place(tie, readings).alias("tie"), *[F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias(x) for x in ("speed", "volume")])
    if lateness is not None:
        rows = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    spans = [None if seconds is None else seconds * 1_000_000 for seconds in (limit_seconds, idle_seconds)]
    ended = rows.groupBy("bucket").applyInPandasWithState(
        open_batches(size, *spans, timers=lateness is not None), ENDED, "open binary", "append",
        GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout)
    return batch_averages(ended.withColumn("first_ts", F.timestamp_micros("first_us").cast("timestamp_ntz")))


def length_batch_stream(readings: DataFrame, out: str, checkpoint: str, minutes: int, size: int = BATCH_ROWS, **options) -> DataFrame:
    """Runs to the end of the input; gives the batches emitted on the way. See ``batches_of_stream``.

    Time-outs move on with the time of micro-batches that have ended, so one without rows follows the last.
    """
    emitted = batches_of_stream(readings, minutes, size, **options)
    spark, name = readings.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    timed = options.get("idle_seconds") is not None or options.get("lateness") is not None
    spark.conf.set(name, "true" if timed else before)
    try:
        return run_batches(emitted, out, checkpoint, emitted.schema).drop("batch")
    finally:
        spark.conf.set(name, before)
