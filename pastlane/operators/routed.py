"""Live rows and averages routed to join instances.

Both sides are kept as tables in the same number of buckets by link and time of day, sorted by them: a row is routed when it is
written, once, and every later join reads bucket against bucket. Spark then plans no exchange above the scans, however often
they are joined. The time of day is part of the route, so the rows of one busy link go to many instances.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pastlane.model import JOINED_COLUMNS, SLOT_KEYS
from pastlane.session import fresh_dir


def route(rows: DataFrame, instances: int, name: str) -> DataFrame:
    """Rows with link and time of day as a table of ``instances`` sorted buckets; ``drop_routed`` takes it out of the catalog.

    Rows are dealt before they are written, so that a bucket is one file.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = rows.repartition(instances, *SLOT_KEYS)
    dealt.write.bucketBy(instances, *SLOT_KEYS).sortBy(*SLOT_KEYS).option("path", fresh_dir(rows.sparkSession, name)).saveAsTable(table)
    return rows.sparkSession.table(table)


def routed_join(live: DataFrame, averages: DataFrame, how: str = "inner") -> DataFrame:
    """As ``live_archive_join`` for two sides of ``route`` with as many instances; the live one has ``hrs`` and ``mins``."""
    history = averages.select(*SLOT_KEYS, F.col("link_id").alias("hist_link_id"), "avg_speed", "avg_volume")
    needed = live.select(*SLOT_KEYS, "speed", "volume", "ts")
    return needed.join(history.hint("merge"), SLOT_KEYS, how).select(*JOINED_COLUMNS)


def drop_routed(spark: SparkSession, prefix: str) -> None:
    """Takes the tables of ``route`` with this name out of the catalog; their files belong to the folder's owner."""
    for table in spark.catalog.listTables():
        if table.name.startswith(f"{prefix}_"):
            spark.sql(f"DROP TABLE {table.name}")
