import random

import pytest
from frames import LINKS, as_set, plan_text

from pastlane.functions.spatial import parse_polygon, polygon_contains
from pastlane.operators.filters import region_links
from pyspark.sql import functions as F

SQUARE = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
WITH_HOLE = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
DART = "POLYGON((0 0, 10 5, 0 10, 4 5, 0 0))"


def inside(spark, wkt, points):
    rows = [(n, x, y) for n, (x, y) in enumerate(points)]
    kept = region_links(spark.createDataFrame(rows, LINKS), wkt)
    return {points[n] for (n,) in as_set(kept, "link_id")}


def test_interior_only(spark):
    points = [(5.0, 5.0), (0.0, 5.0), (10.0, 5.0), (5.0, 0.0), (5.0, 10.0), (0.0, 0.0),
              (10.0, 10.0), (11.0, 5.0), (-1.0, 0.0)]
    assert inside(spark, SQUARE, points) == {(5.0, 5.0)}


def test_hole_and_its_border_are_out(spark):
    points = [(5.0, 5.0), (4.0, 5.0), (4.0, 4.0), (3.0, 5.0), (7.0, 5.0), (5.0, 3.9)]
    assert inside(spark, WITH_HOLE, points) == {(3.0, 5.0), (7.0, 5.0), (5.0, 3.9)}


def test_vertex_on_the_ray_counts_once(spark):
    points = [(1.0, 5.0), (4.0, 5.0), (5.0, 5.0), (10.0, 5.0), (-1.0, 5.0)]
    assert inside(spark, DART, points) == {(5.0, 5.0)}


def test_point_without_coordinates_is_out(spark):
    rows = spark.createDataFrame([(1, None, 5.0), (2, 5.0, None), (3, 5.0, 5.0)], LINKS)
    assert as_set(region_links(rows, SQUARE), "link_id") == {(3,)}


def winding_number(ring, x, y):
    """Sunday's winding number, a different method from the one tested."""
    turns = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if ay <= y < by and side > 0:
            turns += 1
        if by <= y < ay and side < 0:
            turns -= 1
    return turns != 0


def test_random_points_against_winding_number(spark):
    chance = random.Random(7)
    points = [(chance.uniform(-1, 11), chance.uniform(-1, 11)) for _ in range(2000)]
    (ring,) = parse_polygon(DART)
    assert inside(spark, DART, points) == {p for p in points if winding_number(ring, *p)}


def test_many_edges_stay_a_flat_expression(spark):
    import math

    circle = [(math.cos(2 * math.pi * n / 500), math.sin(2 * math.pi * n / 500)) for n in range(500)]
    wkt = "POLYGON((" + ", ".join(f"{x!r} {y!r}" for x, y in [*circle, circle[0]]) + "))"
    df = spark.createDataFrame([(0.0, 0.0), (0.9, 0.0), (1.1, 0.0), (0.8, 0.8)], "x double, y double")
    got = df.select(polygon_contains(wkt, "x", "y").alias("inside"), "x").orderBy("x")
    assert [row.inside for row in got.collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    "wkt", ["POINT(1 2)", "POLYGON((0 0, 1 0, 1 1))", "POLYGON((0 0, 1 0, 1 1, 0 1))", "POLYGON()"]
)
def test_bad_polygons_are_refused(wkt):
    with pytest.raises(ValueError):
        parse_polygon(wkt)


def test_no_python_in_the_plan(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert "Python" not in plan_text(df.where(polygon_contains(SQUARE, "x", "y")))
