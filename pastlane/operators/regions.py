"""Regions of very many vertices.

One expression over all edges is too long for generated code at some thousand vertices, and every point would be held against
every edge. Here the edges are a table by horizontal strips, and a point looks at those of its strip alone. There are as many strips as
make the table at most four times as long as the edges. The tests are those of ``polygon_contains``, so points on edges and vertices are out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pastlane.functions.spatial import parse_polygon

EDGES = "ax double, ay double, bx double, by double"


def region_strips(spark: SparkSession, wkt: str) -> tuple[DataFrame, Column, Column]:
    """(_strip_of, _edges) of a polygon; the strip of ``y``, and whether a point (x, y) is in the box of the shell."""
    rings = parse_polygon(wkt)
    edges = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:]) if a != b]
    xs, ys = zip(*rings[0])
    low, height = min(ys), max(ys) - min(ys)
    climbed = sum(abs(by - ay) for _, ay, _, by in edges)
    strips = max(1, int(3 * len(edges) * height / climbed)) if climbed else 1
    width = height / strips or 1.0

    def strip(y: Column) -> Column:
        return F.floor((y - F.lit(low)) / F.lit(width)).cast("long")

    lowest, highest = strip(F.least("ay", "by")), strip(F.greatest("ay", "by"))
    table = spark.createDataFrame(edges, EDGES).select(
        F.explode(F.sequence(lowest, highest)).alias("_strip_of"), F.struct("ax", "ay", "bx", "by").alias("edge"))
    x, y = F.col("x"), F.col("y")
    inside_box = (x > min(xs)) & (x < max(xs)) & (y > low) & (y < max(ys))
    return table.groupBy("_strip_of").agg(F.collect_list("edge").alias("_edges")), strip(y), inside_box


def _crossed(x: Column, y: Column, edge: Column) -> Column:
    """Does the ray from the point towards larger x cross the edge?"""
    at = F.try_divide(edge["bx"] - edge["ax"], edge["by"] - edge["ay"]) * (y - edge["ay"]) + edge["ax"]
    return ((y < edge["ay"]) != (y < edge["by"])) & (x < at)


def _on(x: Column, y: Column, edge: Column) -> Column:
    cross = (x - edge["ax"]) * (edge["by"] - edge["ay"]) - (y - edge["ay"]) * (edge["bx"] - edge["ax"])
    return (cross == 0) & x.between(F.least(edge["ax"], edge["bx"]), F.greatest(edge["ax"], edge["bx"])) & y.between(
        F.least(edge["ay"], edge["by"]), F.greatest(edge["ay"], edge["by"]))


def region_links_by_strips(links: DataFrame, wkt: str) -> DataFrame:
    """Links strictly inside the polygon, as ``region_links`` finds them, whatever its number of vertices."""
    strips, own, inside_box = region_strips(links.sparkSession, wkt)
    near = links.where(inside_box).withColumn("_strip", own).join(strips, F.col("_strip") == F.col("_strip_of"))
    x, y = F.col("x"), F.col("y")
    odd = F.size(F.filter("_edges", lambda edge: _crossed(x, y, edge))) % 2 == 1
    return near.where(odd & ~F.exists("_edges", lambda edge: _on(x, y, edge))).select(*links.columns)
