"""Metric periods that begin with a row.

The first row begins a period; the first row that comes ``seconds`` or more after it ends it and belongs to it, and the next
row begins another. So periods depend on all rows before them. The rows are cut into ranges of time, each by a task of its own. A range
is a function: if an open period ends with the first row at or after a time T, then its own last period is open since some other time.
As T can only be a period's length after the range before, the function is told as the steps that it makes there. Going through
the ranges' functions in order tells each range what is open before it; then all ranges are cut at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pastlane.operators.cutting import as_batch, fields, numbers
from pastlane.operators.hot import PIECE_ROWS, in_pieces
from pastlane.operators.metrics import PERIOD

RANGES = "piece int, last_us long, since long, place long, upto array<long>, since_at array<long>, place_at array<long>"
OPEN = "piece int, open_us long, from_piece int, from_place long"
PARTS = "piece int, place long, first_us long, last_us long, n long, latency_us long, closed boolean"


def _successors(times: np.ndarray, span: int) -> np.ndarray:
    """For each row that begins a period the row that begins the next; beyond the end if no row here ends it."""
    return np.minimum(np.searchsorted(times, times + span) + 1, len(times) + 1)


def _told(span: int) -> Callable:
    """Tells each range, rows in order, as the state that it leaves for each state that it may find."""
    def told(piece: int, times: np.ndarray) -> tuple:
        n = len(times)
        ahead = np.append(_successors(times, span), [n, n + 1])
        # A period that no row here ends stays open: its first row leads to itself. Row n: none is open.
        ahead = np.where(ahead > n, np.arange(n + 2), ahead)
        while True:
            further = ahead[ahead]
            if (further == ahead).all():
                break
            ahead = further
        since = np.append(times, [-1, -1])
        may_end = min(n - 1, int(np.searchsorted(times, times[0] + span)))
        left = ahead[np.arange(may_end + 1) + 1]  # after the row that ends the open period
        steps = np.append(np.flatnonzero(np.diff(left)), len(left) - 1)
        return (piece, int(times[-1]), int(since[ahead[0]]), int(ahead[0]), times[steps].tolist(),
                since[left[steps]].tolist(), left[steps].tolist())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, held in _ranges(batches, ["us"]):
            yield as_batch([told(piece, held[0])], RANGES)

    return tell


def _ranges(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each range, from rows in the order of ranges."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = numbers(batch, "_piece")
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(piece)], strict=True):  # ranges, not rows
            if now is not None and piece[start] != now:
                yield now, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            now = int(piece[start])
            held.append([numbers(batch, name)[start:stop] for name in names])
    if held:
        yield now, [np.concatenate(x) for x in zip(*held, strict=True)]


def _passed(span: int) -> Callable:
    """Goes through the ranges in order: what is open before each."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, from_piece, from_place = -1, None, None
        for batch in batches:
            done = []
            for piece, last, fresh, place, upto, since_at, place_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done.append((piece, None if since < 0 else since, from_piece, from_place))
                if since < 0:
                    since, from_piece, from_place = fresh, piece, place
                elif last >= since + span:
                    k = int(np.searchsorted(upto, since + span))
                    since, from_piece, from_place = since_at[k], piece, place_at[k]
            yield as_batch(done, OPEN)

    return go


def _cut(span: int) -> Callable:
    """The parts of periods in each range."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, (times, latency, since, from_piece, from_place) in _ranges(batches, ["us", "latency_us", "open_us", "from_piece", "from_place"]):
            n, begin, rows = len(times), 0, []
            known = lambda at: None if latency[at] == np.iinfo(np.int64).min else int(latency[at])
            if since[0] > np.iinfo(np.int64).min:
                end = int(np.searchsorted(times, since[0] + span))
                begin = min(end + 1, n)
                rows.append((int(from_piece[0]), int(from_place[0]), int(since[0]), int(times[begin - 1]), begin, known(begin - 1), end < n))
            ahead = np.append(_successors(times, span), [n, n + 1])
            starts = np.zeros(n + 2, bool)
            starts[begin] = True
            while True:  # rows that begin periods, by doubling
                reached = np.minimum(ahead[starts], n + 1)
                if starts[reached].all():
                    break
                starts[reached] = True
                ahead = ahead[ahead]
            first = np.flatnonzero(starts[:n])
            ends = np.append(first, n)[1:]
            whole = np.searchsorted(times, times[first] + span) < n
            rows += [(piece, a, int(times[a]), int(times[b - 1]), b - a, known(b - 1), bool(c))
                     for a, b, c in zip(first.tolist(), ends.tolist(), whole, strict=True)]
            yield as_batch(rows, PARTS)

    return cut


def floating_periods(
    rows: DataFrame, seconds: int = PERIOD, ts: str = "ts", tie: str = "event_id", emit_ts: str | None = None, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """(first_ts, last_ts, n, throughput, latency_us) of each period that a row has ended.

    ``throughput`` is 1000 rows by the whole milliseconds between the first and the last row, as a whole number. ``latency_us`` is the time
    from ``ts`` to ``emit_ts`` of the row that ends the period. Rows without time have no place and are left out.
    """
    span = seconds * 1_000_000
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    late = F.lit(None).cast("long") if emit_ts is None else micros(emit_ts) - micros(ts)
    placed = rows.where(F.col(ts).isNotNull()).select(micros(ts).alias("us"), F.col(tie).alias("_tie"), late.alias("latency_us"))
    whole, cut = in_pieces(placed, [], ["us", "_tie"], piece_rows)
    pieces = whole.withColumn("_piece", F.lit(0)) if cut is None else cut
    in_order = lambda frame: frame.repartition("_piece").sortWithinPartitions("_piece", "us", "_tie")
    told = in_order(pieces.select("_piece", "us", "_tie")).mapInArrow(_told(span), RANGES)
    # One row for each range goes through one task.
    passed = told.repartition(1).sortWithinPartitions("piece").mapInArrow(_passed(span), OPEN).withColumnRenamed("piece", "_of")
    known = pieces.join(passed, pieces["_piece"] == passed["_of"])
    parts = in_order(known.select("_piece", "us", "_tie", "latency_us", "open_us", "from_piece", "from_place")).mapInArrow(_cut(span), PARTS)
    periods = parts.groupBy("piece", "place").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"),
        F.max(F.when(F.col("closed"), F.struct("latency_us"))).alias("end"), F.max("closed").alias("closed")).where("closed")
    elapsed = F.call_function("div", F.col("last_us") - F.col("first_us"), F.lit(1000))
    stamp = lambda name: F.timestamp_micros(name).cast("timestamp_ntz")
    return periods.select(
        stamp("first_us").alias("first_ts"), stamp("last_us").alias("last_ts"), "n",
        F.call_function("div", 1000 * F.col("n"), elapsed).alias("throughput"), F.col("end.latency_us").alias("latency_us"))
