"""Planar predicates on polygons held as ``array<array<struct<x,y>>>`` rings (outer ring and holes alike).

Polygons are closed sets: a point on an edge or a corner is inside. Holes follow from the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(rings: Column) -> Column:
    """All edges of all rings as ``array<struct<x1,y1,x2,y2>>``; an unclosed ring is closed."""

    def edges(ring: Column) -> Column:
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.named_struct(
                F.lit("x1"), a["x"], F.lit("y1"), a["y"], F.lit("x2"), b["x"], F.lit("y2"), b["y"]
            ),
        )

    return F.flatten(F.transform(rings, edges))


def _low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _side(e: Column, x: Column, y: Column) -> Column:
    """Cross product: zero on the edge's line, with opposite signs on its two sides."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _in_box(e: Column, x: Column, y: Column) -> Column:
    return x.between(_low(e["x1"], e["x2"]), _high(e["x1"], e["x2"])) & y.between(
        _low(e["y1"], e["y2"]), _high(e["y1"], e["y2"])
    )


def on_edge(edges: Column, x: Column, y: Column, eps: float = 0.0) -> Column:
    """True when the point lies on an edge, with ``eps`` as tolerance on the cross product."""
    return F.exists(edges, lambda e: _in_box(e, x, y) & (F.abs(_side(e, x, y)) <= eps))


def crosses_odd(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: a ray to the right of the point meets an odd number of edges."""

    def met(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        crossing = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return straddles & F.coalesce(x < crossing, F.lit(False))

    return F.size(F.filter(edges, met)) % 2 == 1


def contains(edges: Column, x: Column, y: Column, eps: float = 0.0) -> Column:
    """Closed point-in-polygon test."""
    return crosses_odd(edges, x, y) | on_edge(edges, x, y, eps)


def edges_meet(a: Column, b: Column) -> Column:
    """Closed segment intersection, touching and collinear overlap included."""
    boxes = (
        (_low(a["x1"], a["x2"]) <= _high(b["x1"], b["x2"]))
        & (_low(b["x1"], b["x2"]) <= _high(a["x1"], a["x2"]))
        & (_low(a["y1"], a["y2"]) <= _high(b["y1"], b["y2"]))
        & (_low(b["y1"], b["y2"]) <= _high(a["y1"], a["y2"]))
    )
    b_split = F.signum(_side(a, b["x1"], b["y1"])) * F.signum(_side(a, b["x2"], b["y2"])) <= 0
    a_split = F.signum(_side(b, a["x1"], a["y1"])) * F.signum(_side(b, a["x2"], a["y2"])) <= 0
    return boxes & b_split & a_split


def meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column, slack: float = 0.0) -> Column:
    """Closed segment against closed box: their extents overlap and the box is not all on one side of the line.

    ``slack`` widens the test by that length, for callers that must not miss an edge to rounding.
    """
    boxes = (
        (_low(e["x1"], e["x2"]) <= maxx + slack)
        & (_high(e["x1"], e["x2"]) >= minx - slack)
        & (_low(e["y1"], e["y2"]) <= maxy + slack)
        & (_high(e["y1"], e["y2"]) >= miny - slack)
    )
    sides = [_side(e, x, y) for x in (minx, maxx) for y in (miny, maxy)]
    room = (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * slack
    return boxes & (F.least(*sides) <= room) & (F.greatest(*sides) >= -room)
