"""Fixity audit of archived records with Merkle trees (operator 3).

A record is hashed with all its columns. The records at one offset of a file make a leaf: their
number and the sums of the parts of their digests, so copies and order of repeated rows do not
matter and no group is gathered. Sixteen neighbouring ranges of offsets make the node above.
Two replicas are compared from their roots down: children are looked at only where parents
differ, and only those of the leaves that differ are reported.

Built from Spark's own functions. Nulls are hashed as such and differ from empty values. Records
without offset stand at offset 0 of a file of their own, ``<file>?``. An empty replica misses everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastlane.session import fresh_dir

FAN_BITS = 4  # sixteen children
PARTS = (1, 16, 31, 46)  # where the four parts of a digest begin, 15 hex digits each


def record_digest(*columns: Column) -> Column:
    """SHA-256 of a record's columns; lengths keep the borders, null is not empty."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
              for c in columns]
    return F.sha2(F.concat_ws(",", *fields), 256)


def leaves(records: DataFrame, offset: Column, digest: Column, file: Column | None = None) -> DataFrame:
    """(file, node, hash, n): one row for each offset of a file."""
    name = F.lit("records") if file is None else F.coalesce(file.cast("string"), F.lit(""))
    rows = records.select(
        F.when(offset.isNull(), F.concat(name, F.lit("?"))).otherwise(name).alias("file"),
        F.coalesce(offset.cast("long"), F.lit(0)).alias("node"), digest.alias("digest"))
    sums = [F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")).alias(f"part{at}") for at in PARTS]
    found = rows.groupBy("file", "node").agg(F.count(F.lit(1)).alias("n"), *sums)
    return found.select("file", "node", F.sha2(F.concat_ws(
        ",", "node", "n", *[F.col(f"part{at}").cast("string") for at in PARTS]), 256).alias("hash"), "n")


def above(nodes: DataFrame) -> DataFrame:
    """The level above: the hash of at most sixteen children in order."""
    return nodes.groupBy("file", F.shiftright("node", FAN_BITS).alias("node")).agg(
        F.sha2(F.concat_ws(",", F.transform(
            F.array_sort(F.collect_list(F.struct("node", "hash"))),
            lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))), 256).alias("hash"), F.sum("n").alias("n"))


def merkle_tree(records: DataFrame, offset: Column, digest: Column, file: Column | None = None,
                levels: int | None = None) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first, each read from where it was written."""
    spark = records.sparkSession
    folder = fresh_dir(spark, "merkle")

    def written(nodes: DataFrame, level: int) -> DataFrame:
        nodes.write.parquet(f"{folder}/level-{level}")
        return spark.read.parquet(f"{folder}/level-{level}")

    tree = [written(leaves(records, offset, digest, file), 0)]
    while levels is None or len(tree) < levels:
        if levels is None:
            ends = tree[-1].agg(F.max("node"), F.min("node")).first()
            if ends[0] is None or ends[0] <= 0 and ends[1] >= -1:
                break
        tree.append(written(above(tree[-1]), len(tree)))
    return tree


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """(file, node, state, n_primary, n_replica) of the leaves where two trees of one height differ."""
    if len(primary) != len(replica):
        raise ValueError("trees of one height are compared: build the lower one with levels=")
    parents = None
    for left, right in zip(reversed(primary), reversed(replica), strict=True):
        if parents is not None:  # only the children of nodes that differ
            left, right = (x.join(parents, (x["file"] == parents["up_file"]) & (
                F.shiftright(x["node"], FAN_BITS) == parents["up_node"]), "left_semi") for x in (left, right))
        differing = left.alias("a").join(right.alias("b"), ["file", "node"], "full").where(
            ~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        parents = differing.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    return differing.select(
        "file", "node",
        F.when(F.col("a.hash").isNull(), "extra").when(F.col("b.hash").isNull(), "missing").otherwise("changed").alias("state"),
        F.coalesce("a.n", F.lit(0)).alias("n_primary"), F.coalesce("b.n", F.lit(0)).alias("n_replica"))


def audit_records(primary: DataFrame, replica: DataFrame, offset: str, columns: list[str], file: str | None = None) -> DataFrame:
    """Builds both trees to one height and compares them."""
    def build(records, levels=None):
        return merkle_tree(records, F.col(offset), record_digest(*map(F.col, columns)),
                           None if file is None else F.col(file), levels)

    first, second = build(primary), build(replica)
    height = max(len(first), len(second))
    for tree in (first, second):
        while len(tree) < height:
            tree.append(above(tree[-1]))
    return audit(first, second)
