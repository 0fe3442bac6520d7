"""Live readings with the archive.

Every join here looks up one row per key, so all go through ``keyed_join``.
Only a live row makes output; an average without a live row never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pastlane.functions.numeric import bucket_of
from pastlane.functions.time import slot_of_day
from pastlane.model import JOINED_COLUMNS, SLOT_KEYS
from pastlane.operators.hot import keyed_join


def with_slot_keys(live: DataFrame, minutes: int) -> DataFrame:
    return live.select("*", *slot_of_day("ts", minutes))


def live_archive_join(
    live: DataFrame,
    averages: DataFrame,
    minutes: int,
    how: str = "inner",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Each live row with the average of its link and time of day.

    ``how="left"`` keeps live rows without history, with nulls for it.
    ``extra`` names live columns to carry along.
    """
    # The link of the average is a column of its own: null where nothing matched.
    history = averages.select(
        *SLOT_KEYS, F.col("link_id").alias("hist_link_id"), "avg_speed", "avg_volume"
    )
    needed = live.select("link_id", "speed", "volume", "ts", *extra)
    joined = keyed_join(with_slot_keys(needed, minutes), history, SLOT_KEYS, how)
    return joined.select(*JOINED_COLUMNS, *extra)


def live_history_lookup(live: DataFrame, history: DataFrame) -> DataFrame:
    """Each live row with the average of its link; no live row is lost.

    Averaging before the join stands for one query per live row.
    """
    keyed = history.select("link_id", F.col("link_id").alias("hist_link"), "hist_avg")
    needed = live.select("link_id", "speed", "ts")
    joined = keyed_join(needed, keyed, ["link_id"], "left")
    return joined.select("link_id", "hist_link", "speed", "hist_avg", "ts")


def bucketed_join_counts(joined: DataFrame, buckets: int) -> DataFrame:
    """Rows and mean speeds of the join by bucket of links."""
    return joined.groupBy(bucket_of("link_id", buckets).cast("int").alias("bucket")).agg(
        F.count("*").alias("n"),
        F.avg("speed").alias("mean_speed"),
        F.avg("avg_speed").alias("mean_hist_speed"),
    )
