"""Running a streaming frame into a folder, and reading the folder back.

Every micro-batch owns the folder ``batch=<id>`` and replaces it. A batch that is
repeated after a failure therefore leaves its rows once.

A running total needs no state in the stream: each micro-batch leaves its own
partial results, and a reader merges them. So late rows are counted like all others,
and nothing is kept for groups that have ended. Every ``COMPACT_EVERY``-th batch merges the
results of the batches since the last such one with its own, every ``COMPACT_EVERY`` ** 2-th those that have been merged once, and
so on: only results of like size are merged, and a row is written again as often as there are levels. What
has been merged is deleted when the batch after that has begun, as a batch may be repeated until then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

BATCH_FIELD = StructField("batch", LongType())
COMPACT_EVERY = 16

BatchFunction = Callable[[DataFrame, int], DataFrame]
MergeFunction = Callable[[DataFrame], DataFrame]


def batch_path(out: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/batch={batch_id}"


def start_batches(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    transform: BatchFunction | None = None,
    schema: StructType | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Writes every micro-batch, or what ``transform(batch, id)`` makes of it.

    ``once`` takes what there is and ends; otherwise the query goes on. A batch to
    transform is kept meanwhile, as it may be read several times. The folder is made at
    the start, so that it can be read before the first micro-batch ends.
    """
    none = stream.sparkSession.createDataFrame([], schema or stream.schema)
    none.write.mode("overwrite").parquet(batch_path(out, -1))

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(batch_path(out, batch_id))

    def write_transformed(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            write(transform(kept, batch_id), batch_id)
        finally:
            kept.unpersist()

    return start_query(stream, write_transformed if transform else write, checkpoint, once=once)


def start_query(
    stream: DataFrame,
    subscriber: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    once: bool = True,
) -> StreamingQuery:
    """Hands every micro-batch and its id to ``subscriber``."""
    writer = (
        stream.writeStream.foreachBatch(subscriber)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """All rows written, with the column ``batch``; none if nothing came yet."""
    return spark.read.schema(StructType([*schema, BATCH_FIELD])).parquet(out)


def run_batches(
    stream: DataFrame, out: str, checkpoint: str, schema: StructType, transform: BatchFunction | None = None
) -> DataFrame:
    """Runs to the end of the input and reads the rows back."""
    start_batches(stream, out, checkpoint, transform, schema).awaitTermination()
    return read_batches(stream.sparkSession, out, schema)


def folders_below(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path, in any file system that Spark reaches; none if the path is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return [status.getPath().toString() for status in files.listStatus(folder) if status.isDirectory()]


def delete_folders(spark: SparkSession, paths: list[str]) -> int:
    """Deletes folders with what is in them; gives the number that were there."""
    gone = 0
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def _span(batch_id: int, every: int) -> int:
    """How many micro-batches the folder of one covers: the largest power of ``every`` that divides its number from 1."""
    span = 1
    while every > 1 and (batch_id + 1) % (span * every) == 0:
        span *= every
    return span


def covering(last: int, every: int) -> list[int]:
    """The batches whose folders cover all micro-batches up to ``last``, each once."""
    found = []
    while last >= 0:
        found.append(last)
        last -= _span(last, every)
    return found


def start_totals(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    partial: MergeFunction,
    merge: MergeFunction,
    schema: StructType,
    once: bool = True,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Writes ``partial(batch)`` of every micro-batch; ``merge`` adds partial results up."""

    def transform(rows: DataFrame, batch_id: int) -> DataFrame:
        own, spark = partial(rows).select(*schema.names), rows.sparkSession
        merged = range(batch_id - _span(batch_id - 1, compact_every), batch_id - 1) if batch_id else []
        delete_folders(spark, [batch_path(out, old) for old in merged])
        first = batch_id + 1 - _span(batch_id, compact_every)
        parts = [batch_path(out, part) for part in covering(batch_id - 1, compact_every) if part >= first]
        if not parts:
            return own
        return merge(spark.read.schema(schema).parquet(*parts).unionByName(own)).select(*schema.names)

    return start_batches(stream, out, checkpoint, transform, schema, once)


def read_totals(
    spark: SparkSession, out: str, schema: StructType, merge: MergeFunction, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """The totals of all micro-batches up to now."""
    last = max((int(path.rsplit("batch=", 1)[1]) for path in folders_below(spark, out)), default=-1)
    parts = [batch_path(out, part) for part in covering(last, compact_every)] or [batch_path(out, -1)]
    return merge(spark.read.schema(schema).parquet(*parts))


def run_totals(
    stream: DataFrame, out: str, checkpoint: str, partial: MergeFunction, merge: MergeFunction, schema: StructType,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Runs to the end of the input and gives the totals."""
    start_totals(stream, out, checkpoint, partial, merge, schema, True, compact_every).awaitTermination()
    return read_totals(stream.sparkSession, out, schema, merge, compact_every)
