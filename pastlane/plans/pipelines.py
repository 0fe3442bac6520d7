"""The ways to run the join of live readings with their archive.

All take readings and links as DataFrames, so they serve any source.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from pastlane.functions.time import day_aligned_instants, ntz, slot_start
from pastlane.operators.averages import (
    all_slots_average,
    averages_of,
    day_aligned_average,
    link_history,
    slot_aggregate,
)
from pastlane.operators.filters import of_region, parity_archive, parity_live, without_null_averages
from pastlane.operators.joins import live_archive_join, live_history_lookup
from pastlane.operators.needed import link_bits, of_links
from pastlane.sources.archive import day_aligned_scan


def archive_profile(archive: DataFrame, minutes: int) -> DataFrame:
    """One average per link and time of day, over the days given."""
    return averages_of(without_null_averages(slot_aggregate(archive, minutes)))


def live_with_archive(
    live: DataFrame,
    archive: DataFrame,
    links: DataFrame,
    wkt: str,
    minutes: int,
    how: str = "inner",
    extra: tuple[str, ...] = (),
    latest_by: str | None = None,
) -> DataFrame:
    """Readings of the region with the average of their link and time of day.

    The region is taken on both sides, so links outside are not averaged. A link given twice
    is an error, or takes its place with the largest ``latest_by``.
    """
    profile = archive_profile(of_region(archive, links, wkt, latest_by), minutes)
    inside = of_region(live, links, wkt, latest_by)
    return live_archive_join(inside, profile, minutes, how, extra)


def live_with_fetched_slot(
    live: DataFrame,
    archive: DataFrame,
    links: DataFrame,
    wkt: str,
    first: datetime,
    days: int,
    width: timedelta | None = None,
    day: str | None = None,
    latest_by: str | None = None,
) -> DataFrame:
    """As above for one slot of the day, fetched at its instants on ``days`` days.

    ``day`` names the date column that both inputs are partitioned by, if they are.
    """
    minutes = int((width or timedelta(minutes=1)).total_seconds() // 60)
    rows = day_aligned_scan(archive, day_aligned_instants(first, days), width, day)
    profile = day_aligned_average(of_region(rows, links, wkt, latest_by), first)
    today = day_aligned_scan(live, [first + timedelta(days=days)], width, day)
    return live_archive_join(of_region(today, links, wkt, latest_by), profile, minutes)


def default_run(
    live: DataFrame,
    archive: DataFrame,
    links: DataFrame,
    wkt: str,
    first: datetime,
    minutes: int,
    latest_by: str | None = None,
) -> DataFrame:
    """Day-aligned averages, region and load shedding together.

    The live side passes links by the parity of the minute, the archive by that of its
    slot, counted from ``first``; both are in the region.
    """
    slotted = archive.withColumn("slot", slot_start("ts", minutes))
    kept = parity_archive(of_region(slotted, links, wkt, latest_by), ntz(first), minutes)
    profile = without_null_averages(all_slots_average(kept, minutes))
    inside = of_region(parity_live(live), links, wkt, latest_by)
    return live_archive_join(inside, profile, minutes)


def live_with_archive_by_parity(
    live: DataFrame,
    archive: DataFrame,
    first: datetime,
    minutes: int,
    by_parity: bool = True,
) -> DataFrame:
    """The join with half of the load shed on both sides, if ``by_parity``."""
    if by_parity:
        live, archive = (
            parity_archive(
                rows.withColumn("slot", slot_start("ts", minutes)), ntz(first), minutes
            ).drop("slot")
            for rows in (live, archive)
        )
    return live_archive_join(live, all_slots_average(archive, minutes), minutes)


def live_with_lookup(
    live: DataFrame, archive: DataFrame, instants: list[datetime], width: timedelta | None = None, day: str | None = None
) -> DataFrame:
    """Each live row with the average of its link at the instants."""
    return live_history_lookup(live, link_history(day_aligned_scan(archive, instants, width, day)))


def with_emit_time(joined: DataFrame, minutes: int) -> DataFrame:
    """Joined rows as if put out at the end of their slot."""
    end = slot_start("ts", minutes) + F.expr(f"INTERVAL {minutes} MINUTES")
    return joined.withColumn("emit_ts", end)


def live_with_needed_archive(live: DataFrame, archive: DataFrame, links: DataFrame, wkt: str, minutes: int) -> DataFrame:
    """As ``live_with_archive``: only links that have live rows in the region are averaged."""
    inside = of_region(live, links, wkt)
    profile = archive_profile(of_links(archive, link_bits(inside)), minutes)
    return live_archive_join(inside, profile, minutes)
