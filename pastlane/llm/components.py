"""Connected components of a graph of links, as joins and groupings of Spark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastlane.session import fresh_dir


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Python ``rows`` rows at a time, so that large values do not fill its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have: ``name``, or that with lines after it."""
    taken = {x.lower() for x in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame's rows from the shared folder: what follows does not repeat the work before."""
    folder = fresh_dir(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) reaches.

    Large-star and small-star alternate until every edge leads to the least node of its
    component. Each round is a shuffle of the edges; the rounds grow with the logarithm of the nodes.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "links")


def marked(ids: DataFrame, column: str, bits: int = 22) -> bytes:
    """A bitmap of the ids modulo 2 ** bits: its size is fixed whatever the data.

    It says surely which rows are not among the ids, so that they need not be shuffled to be found out.
    """
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    rows = ids.groupBy(F.shiftright(slot, 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))).alias("on")).collect()
    words = bytearray((1 << bits) // 8)
    for row in rows:  # 2 ** (bits - 5) at most
        words[4 * row.word:4 * row.word + 4] = row.on.to_bytes(4, "little")
    return bytes(words)


def in_bitmap(bitmap: bytes, number: int) -> bool:
    """False for a number that is surely not among those marked."""
    slot = number & (8 * len(bitmap) - 1)
    return bool(bitmap[slot >> 3] >> (slot & 7) & 1)
