"""Live rows with an archive side that arrives while they do.

Both come as one stream of tagged rows. The latest averages of a bucket of links (see ``keyed``) are one value of keyed state, a record for each link and time of day: an average
replaces the one before it, a live row is put out with the average that stands when it arrives. Averages never make output, and one that comes
after a live row does not reach it any more, be it in the same micro-batch or in a later one.

Live rows of a link are dealt to ``parts``, each of which has the averages: a link with most rows is not one task's. A bucket's rows of
a micro-batch are joined for all links and times of day at once, without a loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pastlane.model import JOINED_COLUMNS
from pastlane.operators.joins import with_slot_keys
from pastlane.streaming.keyed import link_bucket, links, of_key, whole
from pastlane.streaming.run import run_batches

PARTS = 2  # of the live rows of one link

# The average of a link and time of day that arrived last; NaN stands for null.
LATEST = np.dtype([("link_id", "i8"), ("slot", "i8"), ("speed", "f8"), ("volume", "f8")])
JOINED = "link_id long, hrs int, mins int, arrival long, speed double, volume double, us long, avg_speed double, avg_volume double"
GIVEN = {"link_id": "i8", "slot": "i8", "live": "i8", "arrival": "i8", "speed": "f8", "volume": "f8", "us": "i8"}


def latest_average(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the averages that arrived last; puts live rows out with them. Rows of a micro-batch count in the order of ``arrival``."""
    before = np.frombuffer(bytes(state.get[0]), LATEST) if state.exists else np.zeros(0, LATEST)
    kept = [before[name] if name in LATEST.names else np.zeros(len(before), kind) for name, kind in GIVEN.items()]
    given = of_key(rows, GIVEN)
    is_new = np.repeat([False, True], [len(before), len(given[0])])
    link, slot, live, arrival, speed, volume, us = (np.r_[old, new] for old, new in zip(kept, given, strict=True))
    # Of one arrival live rows come first: an average counts for what arrives after it. Those kept come before all.
    order = np.lexsort((-live, arrival, is_new, slot, link))
    link, slot, live, arrival, speed, volume, us = (x[order] for x in (link, slot, live, arrival, speed, volume, us))
    index = np.arange(len(slot))
    begins = np.ones(len(slot), bool)
    begins[1:] = (link[1:] != link[:-1]) | (slot[1:] != slot[:-1])
    latest = np.maximum.accumulate(np.where(live == 0, index, -1))
    begin = np.maximum.accumulate(np.where(begins, index, 0))
    has = latest >= begin  # else the last average is one of another time of day
    last = np.flatnonzero(np.append(begins[1:], True))
    kept = latest[last[has[last]]]
    if len(kept):
        after = np.zeros(len(kept), LATEST)
        after["link_id"], after["slot"], after["speed"], after["volume"] = link[kept], slot[kept], speed[kept], volume[kept]
        state.update((after.tobytes(),))
    out = np.flatnonzero((live == 1) & has)
    if len(out):
        known = latest[out]
        yield pd.DataFrame({
            "link_id": links(key[0], link[out]), "hrs": whole(slot[out] // 60), "mins": whole(slot[out] % 60), "arrival": whole(arrival[out]),
            "speed": speed[out], "volume": volume[out], "us": whole(us[out]), "avg_speed": speed[known], "avg_volume": volume[known]}, copy=False)


def moving_archive_join(live: DataFrame, averages: DataFrame, minutes: int, arrival: str = "event_id", parts: int = PARTS) -> DataFrame:
    """The stream of live rows, each with the average of its link and time of day that arrived last before it.

    ``averages`` is a stream of link, time of day, ``avg_speed``, ``avg_volume`` and ``arrival``, a whole number that both sides share.
    Live rows without an average up to then make no output, then or later.
    """
    number = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))
    link = F.col("link_id").cast("long")
    keys = [link_bucket(link).alias("bucket"), F.coalesce(link, F.lit(0)).alias("link_id"),
            (F.col("hrs") * 60 + F.col("mins")).cast("long").alias("slot")]
    rows = with_slot_keys(live, minutes).where("ts is not null").select(
        *keys, F.pmod(F.xxhash64(arrival), F.lit(parts)).cast("int").alias("part"), F.lit(1).cast("byte").alias("live"),
        F.col(arrival).cast("long").alias("arrival"), number("speed").alias("speed"), number("volume").alias("volume"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    known = averages.select(
        *keys, F.explode(F.array(*map(F.lit, range(parts)))).alias("part"), F.lit(0).cast("byte").alias("live"),
        F.col(arrival).cast("long").alias("arrival"), number("avg_speed").alias("speed"), number("avg_volume").alias("volume"),
        F.lit(0).cast("long").alias("us"))
    joined = rows.unionByName(known).groupBy("bucket", "part").applyInPandasWithState(
        latest_average, JOINED, "latest binary", "append", GroupStateTimeout.NoTimeout)
    return joined.withColumns({
        **{name: F.nanvl(name, F.lit(None).cast("double")) for name in ("speed", "volume", "avg_speed", "avg_volume")},
        "hist_link_id": F.col("link_id"), "ts": F.timestamp_micros("us").cast("timestamp_ntz"),
    }).select("arrival", *JOINED_COLUMNS)


def moving_join_stream(live: DataFrame, averages: DataFrame, out: str, checkpoint: str, minutes: int, **options) -> DataFrame:
    """Runs ``moving_archive_join`` to the end of both inputs and reads its rows back."""
    joined = moving_archive_join(live, averages, minutes, **options)
    return run_batches(joined, out, checkpoint, joined.schema).drop("batch")
