"""Numeric forms of averages, and buckets of links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def narrowed_speed(average: Column) -> Column:
    """A four-digit average that passed through single precision."""
    return F.round(average, 4).cast("float").cast("double")


def whole_volume(average: Column) -> Column:
    """An average without its fraction (truncated, not rounded)."""
    return average.cast("int")


def bucket_of(link: str, buckets: int) -> Column:
    """Bucket of a link; never negative, unlike ``%`` on a negative link."""
    return F.pmod(F.col(link), F.lit(buckets))
