"""The archive of the live links only.

Averages are made before the join, so a join alone lets all links be averaged. The live links are gathered as bitmaps of
32,768 ids each, and the archive is looked up in them below its average. Bitmaps are exact: no link is lost, none is averaged in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def link_bits(rows: DataFrame) -> DataFrame:
    """(bits_of, bits): which ids each block of 32,768 has; a row for each block that has any."""
    link = F.col("link_id").cast("long")
    return rows.where(link.isNotNull()).groupBy(F.bitmap_bucket_number(link).alias("bits_of")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(link)).alias("bits"))


def _has_bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1


def of_links(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose link is in the bitmaps; Spark broadcasts these if they are small."""
    link = F.col("link_id").cast("long")
    block = rows.withColumn("_block", F.bitmap_bucket_number(link)).join(bits, F.col("_block") == F.col("bits_of"))
    return block.where(_has_bit(F.col("bits"), F.bitmap_bit_position(link))).select(*rows.columns)
