"""Geometry of point lists as column functions.

A shape is an ``array<struct<x,y>>`` in order, held in the row of its feature.
The list of one way comes from one source record, so working inside the row
needs no shuffle and its size is bounded by that record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clamp, norm, record

SHAPE_TYPE = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return record(x=x, y=y)


def _tail(shape: Column) -> Column:
    """All points but the first."""
    return F.slice(shape, F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0)))


def _front(shape: Column) -> Column:
    """All points but the last."""
    return F.slice(shape, F.lit(1), F.greatest(F.size(shape) - 1, F.lit(0)))


def segments(shape: Column) -> Column:
    """Open polyline -> array<struct<p,q>> of its consecutive pairs."""
    return F.zip_with(_front(shape), _tail(shape), lambda p, q: record(p=p, q=q))


def ring_segments(shape: Column) -> Column:
    """Ring -> array<struct<p,q>>, the last point joined to the first."""
    following = F.concat(_tail(shape), F.slice(shape, F.lit(1), F.lit(1)))
    return F.zip_with(shape, following, lambda p, q: record(p=p, q=q))


def ring_sides(shape: Column) -> Column:
    """Sides of a ring: its segments without the closing one when first and last point are equal."""
    repeated = F.get(shape, F.lit(0)) == F.get(shape, F.size(shape) - 1)
    return F.when(repeated, segments(shape)).otherwise(ring_segments(shape))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def signed_area(shape: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 with fewer than three points."""
    cross = F.transform(ring_segments(shape), lambda s: s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    return F.when(F.size(shape) < 3, F.lit(0.0)).otherwise(_total(cross) / F.lit(2.0))


def is_clockwise(shape: Column) -> Column:
    return signed_area(shape) < F.lit(0.0)


def counter_clockwise(shape: Column) -> Column:
    """The ring, reversed when it runs clockwise."""
    return F.when(is_clockwise(shape), F.reverse(shape)).otherwise(shape)


def clockwise(shape: Column) -> Column:
    """The ring, reversed unless it runs clockwise; so a zero-area ring is reversed too."""
    return F.when(is_clockwise(shape), shape).otherwise(F.reverse(shape))


def vertex_mean(shape: Column) -> Column:
    """Mean of the points; a repeated closing point counts twice."""
    n = F.nullif(F.size(shape), F.lit(0))
    return point(_total(F.transform(shape, lambda p: p["x"])) / n, _total(F.transform(shape, lambda p: p["y"])) / n)


def centroid(shape: Column) -> Column:
    """Area-weighted centre; mean for one or two points or no area; the origin for none."""
    start = record(a=F.lit(0.0), x=F.lit(0.0), y=F.lit(0.0))

    def add(total, s):
        p, q = s["p"], s["q"]
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return record(
            a=total["a"] + cross,
            x=total["x"] + (p["x"] + q["x"]) * cross,
            y=total["y"] + (p["y"] + q["y"]) * cross)

    sums = F.aggregate(ring_segments(shape), start, add)
    area = sums["a"] / F.lit(2.0)
    flat = (F.size(shape) < 3) | (F.abs(area) < F.lit(1e-10))
    weight = F.when(~flat, F.lit(6.0) * area)
    return (
        F.when(F.size(shape) == 0, point(F.lit(0.0), F.lit(0.0)))
        .when(flat, vertex_mean(shape))
        .otherwise(point(sums["x"] / weight, sums["y"] / weight))
    )


def line_length(shape: Column) -> Column:
    return _total(
        F.transform(segments(shape), lambda s: norm(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))
    )


def distance_to_segment(px, py, ax, ay, bx, by, degenerate: float = 1e-10) -> Column:
    """Distance from a point to a segment; a segment of no length counts as its start."""
    ex, ey = bx - ax, by - ay
    square = ex * ex + ey * ey
    t = clamp(((px - ax) * ex + (py - ay) * ey) / F.when(square >= F.lit(degenerate), square), F.lit(0.0), F.lit(1.0))
    t = F.coalesce(t, F.lit(0.0))
    return norm(px - (ax + t * ex), py - (ay + t * ey))


def clearance(shape: Column, centre: Column) -> Column:
    """Least distance from ``centre`` to a side longer than a millimetre."""

    def side(s):
        p, q = s["p"], s["q"]
        long_enough = norm(q["x"] - p["x"], q["y"] - p["y"]) > F.lit(1e-3)
        return F.when(
            long_enough,
            distance_to_segment(centre["x"], centre["y"], p["x"], p["y"], q["x"], q["y"], degenerate=1e-6),
        )

    return F.array_min(F.transform(ring_sides(shape), side))


def principal_axis(shape: Column) -> Column:
    """struct<ax,ay,cx,cy,length,width>: direction of the longest side (first of equals),
    vertex mean, and the extents along and across that direction."""
    sides = F.transform(
        ring_segments(shape),
        lambda s, i: record(
            len=norm(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]),
            rank=-i,
            dx=s["q"]["x"] - s["p"]["x"],
            dy=s["q"]["y"] - s["p"]["y"]),
    )

    def measured(axis_and_mean):
        longest, mean = axis_and_mean["longest"], axis_and_mean["mean"]
        size = F.when(longest["len"] > F.lit(0.0), longest["len"])
        ax = F.coalesce(longest["dx"] / size, F.lit(1.0))
        ay = F.coalesce(longest["dy"] / size, F.lit(0.0))
        along = F.transform(shape, lambda p: (p["x"] - mean["x"]) * ax + (p["y"] - mean["y"]) * ay)
        across = F.transform(shape, lambda p: (p["y"] - mean["y"]) * ax - (p["x"] - mean["x"]) * ay)
        return record(
            ax=ax,
            ay=ay,
            cx=mean["x"],
            cy=mean["y"],
            length=F.array_max(along) - F.array_min(along),
            width=F.array_max(across) - F.array_min(across))

    # A one-element array binds the longest side and the mean once per row.
    bound = F.array(record(longest=F.array_max(sides), mean=vertex_mean(shape)))
    return F.get(F.transform(bound, measured), F.lit(0))
