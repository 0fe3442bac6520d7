"""Groups that hold a large share of the rows: joins and numbering that split them.

A sensor can send far more than the others. Averages are safe, since Spark
aggregates before it shuffles; joins and row numbers bring all rows of a key to
one task unless they are planned otherwise: groups that one task can hold are dealt whole,
larger ones in as many pieces as their rows need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pastlane.session import fresh_dir

# A group with more rows is cut into pieces of about so many.
PIECE_ROWS = 1 << 16


def _require_same_types(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> None:
    """Equal values of different types have different hashes."""
    for key in keys:
        left, right = rows.schema[key].dataType, keyed.schema[key].dataType
        if left != right:
            raise ValueError(f"{key} is {left.simpleString()} and {right.simpleString()}")


def keyed_join(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins ``rows`` with ``keyed``, which has one row per key.

    Spark broadcasts a side whose size, known from its files or measured after its
    shuffle, is below the session's threshold. Otherwise both sides are shuffled by
    key, and adaptive execution cuts a partition that is much larger than the
    others into pieces, each with a copy of the rows it looks up. It does so only where a
    shuffle stands right below each side, so averages, which come already
    dealt by their keys, are rebalanced first; they are the small side.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"inner or left, not {how!r}")
    _require_same_types(rows, keyed, keys)
    return rows.join(keyed.hint("rebalance"), keys, how)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Equal keys, nulls too; those of the right side have ``prefix`` before their names."""
    return reduce(lambda a, b: a & b, [left[key].eqNullSafe(right[f"{prefix}{key}"]) for key in keys])


def in_pieces(
    rows: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``piece_rows``, and those of larger groups, cut.

    The larger groups have the column ``_piece``: their rows are dealt by ranges of ``order``, as many as their number needs, and
    written, so that a row's piece stays the same. A piece has about ``piece_rows`` rows of all groups together, also when
    one group holds most rows or all rows have one time. Without keys all rows are one group.
    """
    spark = rows.sparkSession
    if keys:
        folder = fresh_dir(spark, "large-groups")
        counts = rows.groupBy(*[F.col(key).alias(f"_large_{key}") for key in keys]).agg(F.count("*").alias("_n"))
        counts.where(F.col("_n") > piece_rows).write.parquet(folder)
        large = spark.read.schema(counts.schema).parquet(folder)
        total = large.agg(F.sum("_n")).first()[0] or 0
    else:
        total = rows.count()
    if total <= piece_rows:
        return rows, None
    whole, cut = rows.limit(0), rows
    if keys:
        same = same_keys(rows, large, keys, "_large_")
        whole, cut = rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")
    folder = fresh_dir(spark, "pieces")
    dealt = cut.repartitionByRange(-(-total // piece_rows), *order).withColumn("_piece", F.spark_partition_id())
    dealt.write.parquet(folder)
    return whole, spark.read.schema(dealt.schema).parquet(folder)


def with_position(
    rows: DataFrame, keys: list[str], ts: str = "ts", tie: str | list[str] = "event_id", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Adds ``position``: 0, 1, 2, ... within ``keys`` by (``ts``, ``tie``).

    Groups too large for one task are numbered piece by piece: the numbers of a piece start after the group's rows
    in the pieces before. No task sorts more of a group than a piece has.
    """
    order = [ts, *([tie] if isinstance(tie, str) else tie)]
    whole, cut = in_pieces(rows, keys, order, piece_rows)
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    numbered = whole.withColumn("position", number)
    if cut is None:
        return numbered
    names = [*keys, "_piece"]
    counts = cut.groupBy(*[F.col(name).alias(f"_at_{name}") for name in names]).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_at_{key}" for key in keys]).orderBy("_at__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    placed = cut.withColumn("_number", inside)
    joined = placed.join(starts, same_keys(placed, starts, names, "_at_"))
    position = (F.col("_start") + F.col("_number") - 1).cast("long")
    return numbered.unionByName(joined.select(*rows.columns, position.alias("position")))
