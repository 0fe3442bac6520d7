"""Region, parity and null filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pastlane.functions.spatial import polygon_contains
from pastlane.operators.hot import keyed_join
from pastlane.sources.links import unique_links


def region_links(links: DataFrame, wkt: str) -> DataFrame:
    """Links strictly inside the polygon; decided once per link, not per reading."""
    return links.where(polygon_contains(wkt, "x", "y"))


def in_region(
    readings: DataFrame, links: DataFrame, wkt: str, latest_by: str | None = None
) -> DataFrame:
    """Readings of the links inside the polygon, with their coordinates.

    A link that the dimension does not know has no place and is dropped. A link that it
    has twice is an error, or takes the place with the largest ``latest_by``.
    """
    return keyed_join(readings, region_links(unique_links(links, latest_by), wkt), ["link_id"])


def of_region(
    readings: DataFrame, links: DataFrame, wkt: str, latest_by: str | None = None
) -> DataFrame:
    """As ``in_region`` without the coordinates: a look at the ids of the links inside."""
    inside = region_links(unique_links(links, latest_by), wkt).select("link_id")
    return readings.join(inside, "link_id", "left_semi").select(*readings.columns)


def parity_live(live: DataFrame, ts: str = "ts") -> DataFrame:
    """Sheds half of the load: a link passes when its parity is that of the minute."""
    return live.where(F.col("link_id") % 2 == F.minute(ts) % 2)


def slot_index(slot: str | Column, first: Column, minutes: int) -> Column:
    """Number of slots between ``first`` and ``slot``."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    seconds = F.unix_timestamp(slot.cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))
    return F.floor(seconds / (60 * minutes)).cast("long")


def parity_archive(archive: DataFrame, first: Column, minutes: int, slot: str = "slot") -> DataFrame:
    """Every other slot gives the even links, the slots between them the odd ones."""
    return archive.where(F.col("link_id") % 2 == slot_index(slot, first, minutes) % 2)


def without_null_averages(averages: DataFrame) -> DataFrame:
    """Averages that exist; a group of nulls only is not passed on."""
    return averages.dropna(subset=["avg_speed", "avg_volume"])


def without_empty_groups(averages: DataFrame) -> DataFrame:
    return averages.where(F.col("count_rec") > 0)
