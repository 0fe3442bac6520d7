"""A WKT polygon as a Column expression: no UDF, and it stays in codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

Point = tuple[float, float]
Ring = list[Point]


def parse_polygon(wkt: str) -> list[Ring]:
    """Rings of ``POLYGON((x y, ...), (x y, ...))``; the first is the shell."""
    shape = re.fullmatch(r"\s*POLYGON\s*\((.*)\)\s*", wkt, re.IGNORECASE | re.DOTALL)
    if not shape:
        raise ValueError(f"not a WKT polygon: {wkt!r}")
    rings = []
    for body in re.findall(r"\(([^()]*)\)", shape.group(1)):
        ring = [(float(x), float(y)) for x, y in (pair.split() for pair in body.split(","))]
        if len(ring) < 4 or ring[0] != ring[-1]:
            raise ValueError(f"a ring needs at least four points and must be closed: {body!r}")
        rings.append(ring)
    if not rings:
        raise ValueError(f"polygon without a ring: {wkt!r}")
    return rings


def _edges(rings: list[Ring]) -> list[tuple[Point, Point]]:
    return [edge for ring in rings for edge in zip(ring, ring[1:]) if edge[0] != edge[1]]


def _number(value: float) -> str:
    return f"{value!r}D"


def _crosses(x: str, y: str, a: Point, b: Point) -> str:
    """Does the ray from the point towards larger x cross the edge a-b?"""
    (ax, ay), (bx, by) = a, b
    if ay == by:
        return "false"
    slope = _number((bx - ax) / (by - ay))
    at = f"{slope} * ({y} - {_number(ay)}) + {_number(ax)}"
    return f"(({y} < {_number(ay)}) <> ({y} < {_number(by)}) AND {x} < {at})"


def _on_edge(x: str, y: str, a: Point, b: Point) -> str:
    (ax, ay), (bx, by) = a, b
    cross = (
        f"({x} - {_number(ax)}) * {_number(by - ay)} - ({y} - {_number(ay)}) * {_number(bx - ax)}"
    )
    return (
        f"({cross} = 0D"
        f" AND {x} BETWEEN {_number(min(ax, bx))} AND {_number(max(ax, bx))}"
        f" AND {y} BETWEEN {_number(min(ay, by))} AND {_number(max(ay, by))})"
    )


def _fold(terms: list[str], operator: str) -> str:
    """Joins the terms pairwise, so a polygon of n edges is a tree of depth log n."""
    while len(terms) > 1:
        pairs = [f"({operator.join(terms[i : i + 2])})" for i in range(0, len(terms) - 1, 2)]
        terms = pairs + terms[len(pairs) * 2 :]
    return terms[0]


def polygon_contains(wkt: str, x: str, y: str) -> Column:
    """True for points strictly inside; points on an edge or in a hole are out.

    A point is inside when the ray crosses the edges of all rings an odd number
    of times. The bounding box comes first: it is cheap and can be pushed down.
    """
    rings = parse_polygon(wkt)
    edges = _edges(rings)
    xs, ys = zip(*rings[0])
    box = (
        f"{x} > {_number(min(xs))} AND {x} < {_number(max(xs))}"
        f" AND {y} > {_number(min(ys))} AND {y} < {_number(max(ys))}"
    )
    odd = _fold([_crosses(x, y, *edge) for edge in edges], " <> ")
    border = _fold([_on_edge(x, y, *edge) for edge in edges], " OR ")
    return F.expr(f"{box} AND {odd} AND NOT {border}")
