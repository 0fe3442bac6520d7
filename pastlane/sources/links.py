"""The link dimension: where each link is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pastlane.model import LINK_SCHEMA


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """``id,x,y`` lines without header; further columns are ignored."""
    return spark.read.schema(LINK_SCHEMA).option("enforceSchema", "true").csv(path)


def unique_links(links: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per link.

    Files have no order to take "the last line" by. With ``order_by`` the row
    with its largest value wins; without it a link given twice is an error.
    """
    if order_by:
        place = F.max_by(F.struct("x", "y"), order_by).alias("place")
        return links.groupBy("link_id").agg(place).select("link_id", "place.*")
    message = F.concat(F.lit("link given twice: "), F.col("link_id").cast("string"))
    place = F.first(F.struct("x", "y")).alias("place")
    once = links.groupBy("link_id").agg(F.count("*").alias("n"), place)
    checked = F.when(F.col("n") > 1, F.raise_error(message)).otherwise(F.col("place"))
    return once.select("link_id", checked.alias("place")).select("link_id", "place.*")
