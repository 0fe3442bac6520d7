"""Batches that end by rows or by time.

Rows of a group in order, by time and then ``tie``: a batch is put out when it has
``size`` rows, or when the next row of its group is ``limit_seconds`` or more after its first.
Only times of rows count, so the result is the same for one frame and for any
micro-batches that bring each group's rows in order.

Where a batch begins depends on where the one before ended. Each row has a successor, the row that begins the next batch if
this one begins one: it is found by a search in the times. The rows that do begin batches are those that successors lead to from
the group's first row; they are found by doubling the successors, for all groups of an Arrow batch at once.

A group too large for one task is cut into pieces. A piece is a function: if its first batch begins at row e, then its last
one is left open with so many rows since that time. As many as ``size`` values of e are possible, so a piece
is told in a row of ``size`` numbers; going through these rows in order gives each piece its own e, and all pieces are cut at once.
Batches that go over a border come as parts and are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from pastlane.model import SLOT_KEYS
from pastlane.operators.hot import PIECE_ROWS, in_pieces, same_keys
from pastlane.operators.joins import with_slot_keys
from pastlane.operators.windows import batch_averages

KEYS = "link_id long, hrs int, mins int"
SUMS = "count_rec long, sum_volume double, n_volume long, sum_speed double, n_speed long"
PARTS = f"{KEYS}, piece int, place long, first_us long, {SUMS}, open boolean"
PIECES = f"{KEYS}, piece int, n long, head array<long>, left array<long>, since array<long>"
ENTRIES = f"{KEYS}, piece int, entry long, from_piece int, from_place long, from_us long, last boolean"

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def fields(schema: str) -> pa.Schema:
    """The Arrow form of a schema text."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (part.split(" ") for part in schema.split(", "))])


def _successors(times: np.ndarray, first: np.ndarray, size: int, limit: int | None) -> np.ndarray:
    """For each row the one that begins the next batch if it begins one; ``first`` tells where groups begin."""
    rows = np.arange(len(times))
    if limit is None:
        group = np.cumsum(first)
        ends = np.searchsorted(group, group, side="right")
    else:  # a gap counts as the limit at most, and so does the border of a group
        gaps = np.minimum(np.diff(times, prepend=times[:1]), limit)
        gaps[first] = limit
        clock = np.cumsum(gaps)
        ends = np.maximum(np.searchsorted(clock, clock + limit), rows + 1)
    return np.minimum(rows + size, ends)


def batch_starts(times: np.ndarray, first: np.ndarray, size: int, limit: int | None) -> np.ndarray:
    """The rows that begin a batch, for rows in order by group and time (microseconds)."""
    ahead = np.append(_successors(times, first, size, limit), len(times))
    begins = np.zeros(len(times) + 1, bool)
    begins[0] = True
    while True:  # rows reached by fewer than 2 ** k steps are marked; ``ahead`` goes 2 ** k steps
        reached = ahead[begins]
        if begins[reached].all():
            return np.flatnonzero(begins[:-1])
        begins[reached] = True
        ahead = ahead[ahead]


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column of whole numbers or times; null is the smallest number."""
    return batch.column(name).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def changes(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Where a row has other values than the one before it; the first row has."""
    found = np.zeros(batch.num_rows, bool)
    found[:1] = True
    for name in names:
        values = numbers(batch, name)
        found[1:] |= values[1:] != values[:-1]
    return found


def sums_of(batch: pa.RecordBatch | pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Rows, sums and counts of the runs of rows that begin at ``starts``; nulls and NaN are skipped."""
    out = {"count_rec": np.diff(starts, append=batch.num_rows)}
    for name in ("volume", "speed"):
        values = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else (
            batch.column(name).cast(pa.float64()).to_numpy())
        known = ~np.isnan(values)
        out[f"sum_{name}"] = np.add.reduceat(np.where(known, values, 0.0), starts)
        out[f"n_{name}"] = np.add.reduceat(known.astype(np.int64), starts)
    return out


def _cut(size: int, limit: int | None) -> Callable:
    """Cuts rows in order by keys, piece and time into parts of batches.

    A row knows the entry of its piece: rows before it belong to the batch that began in ``from_piece``.
    """
    names = [*SLOT_KEYS, "piece"]

    def parts(rows: pa.Table, starts: np.ndarray, place: np.ndarray, ends_here: np.ndarray) -> pa.RecordBatch:
        chosen = rows.take(pa.array(starts))
        before = numbers(rows, "entry")[starts] > place[starts]
        last = rows.column("last").to_numpy()[starts]
        columns = {
            "piece": np.where(before, numbers(rows, "from_piece")[starts], numbers(rows, "piece")[starts]).astype(np.int32),
            "place": np.where(before, numbers(rows, "from_place")[starts], place[starts]),
            "first_us": np.where(before, numbers(rows, "from_us")[starts], numbers(rows, "ts")[starts]),
            **sums_of(rows, starts), "open": last & ends_here}
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[field.name]) if field.name in columns else chosen.column(field.name).combine_chunks().cast(field.type)
             for field in fields(PARTS)], schema=fields(PARTS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = None, 0  # the rows of the last batch so far, and the first one's place in its piece
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            own = changes(rows, names)
            began = np.flatnonzero(own)
            index = np.arange(rows.num_rows)
            place = index - began[np.cumsum(own) - 1]
            place[:began[1] if len(began) > 1 else None] += base
            first = own | (place == numbers(rows, "entry"))
            starts = batch_starts(numbers(rows, "ts"), first, size, limit)
            held, base = rows.slice(starts[-1]), int(place[starts[-1]])
            if len(starts) > 1:  # the last one may go on
                done = rows.slice(0, starts[-1])
                yield parts(done, starts[:-1], place, np.append(own, True)[starts[1:]])
        if held is not None:
            held = held.combine_chunks()
            yield parts(held, np.array([0]), np.array([base]), np.array([True]))

    return cut


def _functions(size: int, limit: int | None) -> Callable:
    """Tells each piece of a group, rows in order, as a function of the row that its first batch begins at."""
    names = [*SLOT_KEYS, "piece"]

    def told(key: tuple, times: np.ndarray) -> tuple:
        n = len(times)
        first = np.arange(n) == 0
        ahead = _successors(times, first, size, limit)
        # A batch that no row of this piece ends is left open; n rows on, nothing is.
        ends = np.arange(n) + size <= n
        if limit is not None:
            ends |= np.searchsorted(times, times + limit) < n
        ahead = np.append(np.where(ends, ahead, np.arange(n)), n)
        while True:
            further = ahead[ahead]
            if (further == ahead).all():
                break
            ahead = further
        last = ahead[:min(size - 1, n) + 1]
        since = np.append(times, 0)[last]
        return (*key, n, times[:size - 1].tolist(), (n - last).tolist(), since.tolist())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            times = numbers(batch, "ts")
            began = np.flatnonzero(changes(batch, names))
            for start, stop in zip(began, np.append(began[1:], batch.num_rows), strict=True):  # pieces, not rows
                now = tuple(batch.column(name)[int(start)].as_py() for name in names)
                if now != key:
                    if held:
                        done.append(told(key, np.concatenate(held)))
                    key, held = now, []
                held.append(times[start:stop])
            if done:
                yield as_batch(done, PIECES)
                done = []
        if held:
            yield as_batch([told(key, np.concatenate(held))], PIECES)

    return tell


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields(schema))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, fields(schema), strict=True)], schema=fields(schema))


def _entries(size: int, limit: int | None) -> Callable:
    """Goes through the pieces of a group in order: each gets the row its first own batch begins at, and what is open before it."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, None
        done = []
        n_open, piece_open, place_open, since_open = 0, None, None, None
        for batch in batches:
            for link, hrs, mins, piece, n, head, left, since in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (link, hrs, mins) != key:
                    key, n_open = (link, hrs, mins), 0
                    if waiting:
                        done.append((*waiting, True))
                        waiting = None
                if waiting:
                    done.append((*waiting, False))
                wanted = size - n_open if n_open else 0
                taken = min(wanted, n)
                if n_open and limit is not None:
                    taken = min(taken, int(np.searchsorted(head, since_open + limit)) if head else 0)
                waiting = (*key, piece, taken, piece_open if n_open else None, place_open if n_open else None, since_open if n_open else None)
                if n_open and taken == n < wanted:
                    n_open += n  # the whole piece belongs to the open batch
                else:
                    n_open, since_open = left[taken], since[taken]
                    piece_open, place_open = piece, n - n_open
            if done:
                yield as_batch(done, ENTRIES)
                done = []
        yield as_batch([(*waiting, True)] if waiting else [], ENTRIES)

    return go


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Sorted in Spark, which spills; one piece of a group is in one task."""
    names = [*SLOT_KEYS, "piece"]
    return rows.repartition(*names).sortWithinPartitions(*names, *order)


def _ended(parts: DataFrame, size: int, partial: bool) -> DataFrame:
    """What is put out of the batches."""
    kept = parts if partial else parts.where((F.col("count_rec") == size) | ~F.col("open"))
    return batch_averages(kept.withColumn("first_ts", F.timestamp_micros("first_us").cast("timestamp_ntz")))


def time_length_batch(
    readings: DataFrame, minutes: int, size: int, limit_seconds: int | None, tie: list[str], partial: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The batches of each link and time of day; ``partial`` also gives those still open at the end.

    Rows without time have no place and are left out.
    """
    limit = None if limit_seconds is None else limit_seconds * 1_000_000
    own = [name for name in tie if name not in ("ts", "speed", "volume", *SLOT_KEYS)]
    keyed = with_slot_keys(readings, minutes).where("ts is not null").select(
        F.col("link_id").cast(LongType()).alias("link_id"), "hrs", "mins", "ts", "speed", "volume", *own)
    order = ["ts", *own]
    whole, cut = in_pieces(keyed, SLOT_KEYS, order, piece_rows)
    needed = [*SLOT_KEYS, "piece", "ts", "speed", "volume", "entry", "from_piece", "from_place", "from_us", "last", *own]
    nowhere = F.lit(None).cast("long")
    alone = whole.withColumns({
        "piece": F.lit(0), "entry": F.lit(0).cast("long"), "from_piece": nowhere.cast("int"), "from_place": nowhere,
        "from_us": nowhere, "last": F.lit(True)})
    parts = _in_order(alone.select(*needed), order).mapInArrow(_cut(size, limit), PARTS)
    if cut is not None:
        pieces = cut.withColumnRenamed("_piece", "piece")
        told = _in_order(pieces.select(*SLOT_KEYS, "piece", "ts", *own), order).mapInArrow(_functions(size, limit), PIECES)
        entries = told.repartition(*SLOT_KEYS).sortWithinPartitions(*SLOT_KEYS, "piece").mapInArrow(_entries(size, limit), ENTRIES)
        entries = entries.withColumnsRenamed({name: f"_{name}" for name in [*SLOT_KEYS, "piece"]})
        known = pieces.join(entries, same_keys(pieces, entries, [*SLOT_KEYS, "piece"], "_"))
        over = _in_order(known.select(*needed), order).mapInArrow(_cut(size, limit), PARTS)
        merged = over.groupBy(*SLOT_KEYS, "piece", "place").agg(
            F.min("first_us").alias("first_us"), *[F.sum(part.split()[0]).alias(part.split()[0]) for part in SUMS.split(", ")],
            F.max("open").alias("open"))
        parts = parts.unionByName(merged)
    return _ended(parts, size, partial)
