"""The running clock and the expiry of averages on a stream.

The clock is the time of the live row that arrived last. Averages carry the date of their slot, so midnight is no border. Those behind the
clock are dropped for good: a clock that a late row turns back brings nothing back.

Averages are kept by the day of their slot. A micro-batch adds its own, moves the clock, and deletes the days that are behind it as
folders; nothing that is kept is read or written again. Of the day that the clock stands in, readers leave out what is behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pastlane.streaming.run import delete_folders, folders_below, start_query

CLOCK = "batch long, arrival long, ts timestamp_ntz, cutoff timestamp_ntz"


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd")


def _clock_path(out: str) -> str:
    return f"{out.rstrip('/')}/clock"


def _kept_path(out: str) -> str:
    return f"{out.rstrip('/')}/kept"


def read_clock(spark: SparkSession, out: str) -> DataFrame:
    """One row for each micro-batch: the row that had arrived last by its end, and how far averages had expired."""
    return spark.read.schema(CLOCK).parquet(_clock_path(out)).select("batch", "arrival", "ts", "cutoff")


def _moved(rows: DataFrame, out: str, batch_id: int) -> DataFrame:
    """The clock after a micro-batch: from its rows and the clock before it."""
    before = read_clock(rows.sparkSession, out).where(F.col("batch") < batch_id).orderBy(F.desc("batch")).limit(1)
    own = rows.where("live and ts is not null").agg(F.max(F.struct("arrival", "ts")).alias("last")).where("last is not null")
    seen = own.select("last.arrival", "last.ts", F.lit(None).cast("timestamp_ntz").alias("cutoff")).unionByName(before.drop("batch"))
    moved = seen.agg(F.max(F.struct("arrival", "ts")).alias("last"), F.max("cutoff").alias("cutoff"))
    minute = F.date_trunc("minute", F.col("last.ts")).cast("timestamp_ntz")
    return moved.select(
        F.lit(batch_id).cast("long").alias("batch"), "last.arrival", "last.ts", F.greatest(minute, "cutoff").alias("cutoff"))


def start_expiry(live: DataFrame, averages: DataFrame, out: str, checkpoint: str, arrival: str = "event_id", once: bool = True) -> StreamingQuery:
    """Keeps the averages (with ``slot``, the time their slot begins) that are not behind the clock of the live rows.

    A micro-batch that is repeated replaces what it wrote before.
    """
    spark = live.sparkSession
    names = averages.columns
    given = F.struct(*[F.col(name) for name in names])
    nothing = F.lit(None).cast(averages.select(given.alias("x")).schema["x"].dataType)
    rows = live.select(F.lit(True).alias("live"), F.col(arrival).cast("long").alias("arrival"), F.col("ts").cast("timestamp_ntz").alias("ts"), nothing.alias("given"))
    rows = rows.unionByName(averages.select(
        F.lit(False).alias("live"), F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("timestamp_ntz").alias("ts"), given.alias("given")))
    spark.createDataFrame([], CLOCK).write.mode("overwrite").parquet(f"{_clock_path(out)}/of=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            added = kept.where("not live").select("given.*").withColumn("slot_day", _day(F.col("slot"))).where("slot is not null")
            folder = f"{_kept_path(out)}/batch={batch_id}"
            added.hint("rebalance", "slot_day").write.mode("overwrite").partitionBy("slot_day").parquet(folder)
            _moved(kept, out, batch_id).coalesce(1).write.mode("overwrite").parquet(f"{_clock_path(out)}/of={batch_id}")
        finally:
            kept.unpersist()
        evict(spark, out)

    return start_query(rows, step, checkpoint, once=once)


def _cutoff(spark: SparkSession, out: str):
    return read_clock(spark, out).agg(F.max("cutoff")).first()[0]


def evict(spark: SparkSession, out: str) -> int:
    """Deletes the days behind the clock; gives the number of folders that went."""
    cutoff = _cutoff(spark, out)
    if cutoff is None:
        return 0
    day = cutoff.strftime("%Y%m%d")
    behind = [path for batch in folders_below(spark, _kept_path(out)) for path in folders_below(spark, batch)
              if path.rsplit("slot_day=", 1)[-1] < day]
    return delete_folders(spark, behind)


def kept_averages(spark: SparkSession, out: str, schema) -> DataFrame:
    """The averages that are not behind the clock now."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(_kept_path(out))
    cutoff = _cutoff(spark, out)
    return rows if cutoff is None else rows.where(F.col("slot") >= F.lit(cutoff).cast("timestamp_ntz"))


def expiry_stream(live: DataFrame, averages: DataFrame, out: str, checkpoint: str, arrival: str = "event_id") -> DataFrame:
    """Runs to the end of both inputs; gives the averages that are left."""
    start_expiry(live, averages, out, checkpoint, arrival).awaitTermination()
    return kept_averages(live.sparkSession, out, averages.schema)
