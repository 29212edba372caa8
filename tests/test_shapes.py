import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions import geodesy, shapes
from mapweave.operators import lines
from mapweave.operators.simplify import simplify

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def frame(spark, *point_lists):
    rows = [(i, [(float(x), float(y)) for x, y in pts]) for i, pts in enumerate(point_lists)]
    return spark.createDataFrame(rows, f"id int, shape {shapes.SHAPE_TYPE}")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_signed_area(spark):
    closed = SQUARE + SQUARE[:1]
    df = frame(spark, SQUARE, SQUARE[::-1], closed, [(0, 0), (1, 1), (2, 2)], [], [(1, 1)], [(0, 0), (1, 0)])
    assert values(df, shapes.signed_area(F.col("shape"))) == [1, -1, 1, 0, 0, 0, 0]


def test_centroid(spark):
    df = frame(spark, SQUARE, SQUARE + SQUARE[:1], [(0, 0), (1, 1), (2, 2)], [], [(1, 3)], [(0, 0), (1, 0)])
    got = [tuple(v) for v in values(df, shapes.centroid(F.col("shape")))]
    assert got == [(0.5, 0.5), (0.5, 0.5), (1, 1), (0, 0), (1, 3), (0.5, 0)]
    mean = values(frame(spark, SQUARE + SQUARE[:1]), shapes.vertex_mean(F.col("shape")))[0]
    assert tuple(mean) == (0.4, 0.4)


def test_winding_of_zero_area(spark):
    flat = [(0, 0), (1, 0), (2, 0)]
    df = frame(spark, flat, SQUARE, SQUARE[::-1])
    first = lambda fn: [tuple(v[0]) for v in values(df, fn(F.col("shape")))]
    assert first(shapes.counter_clockwise) == [(0, 0), (0, 0), (0, 0)]
    assert first(shapes.clockwise) == [(2, 0), (0, 1), (0, 1)]


def test_axis_and_clearance(spark):
    ring = [(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]
    df = frame(spark, ring)
    a = values(df, shapes.principal_axis(F.col("shape")))[0]
    assert (a.ax, a.ay, a.length, a.width) == (1, 0, 4, 2)
    centre = shapes.point(F.lit(2.0), F.lit(1.0))
    assert values(df, shapes.clearance(F.col("shape"), centre)) == [1]
    assert values(df, shapes.line_length(F.col("shape"))) == [12]


def test_directions(spark):
    df = frame(spark, [(0, 0), (10, 0), (10, 10)], [(0, 0), (5, 0), (0, 0)], [(1, 1)])
    got = lines.point_directions(df, "shape").orderBy("id", "i").collect()
    diagonal = math.sqrt(0.5)
    expected = [(0, 1, 0), (0, diagonal, diagonal), (0, 0, 1), (1, 1, 0), (1, 1, 0), (1, -1, 0)]
    assert [r.id for r in got] == [e[0] for e in expected]
    for row, (_, tx, ty) in zip(got, expected):
        assert (row.ptx, row.pty) == pytest.approx((tx, ty))


def test_simplify(spark):
    at_limit = [(0, 0), (5, 1), (10, 0)]
    tie = [(0, 0), (2, 3), (8, 3), (10, 0)]
    loop = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    got = values(simplify(frame(spark, at_limit, tie, loop, [(0, 0), (1, 1)]), "shape", 1.0), F.col("shape"))
    points = [[tuple(p) for p in g] for g in got]
    assert points == [[(0, 0), (10, 0)], tie, loop, [(0, 0), (1, 1)]]


def test_simplify_keeps_ends_and_tolerance(spark):
    rng = random.Random(3)
    walks = []
    for _ in range(20):
        x = y = 0.0
        walk = []
        for _ in range(40):
            x, y = x + rng.random() * 5, y + rng.uniform(-3, 3)
            walk.append((x, y))
        walks.append(walk)
    got = values(simplify(frame(spark, *walks), "shape", 2.0), F.col("shape"))
    for walk, kept in zip(walks, got):
        kept = [tuple(p) for p in kept]
        assert kept[0] == walk[0] and kept[-1] == walk[-1]
        at = [walk.index(p) for p in kept]
        for (i, a), (j, b) in zip(zip(at, kept), zip(at[1:], kept[1:])):
            for p in walk[i + 1 : j]:
                t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
                assert math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) <= 2.0 + 1e-9


def test_projection_round_trip(spark):
    df = spark.range(200).select((F.col("id") * 0.8 - 80).alias("lat"), (F.col("id") * 1.7 - 170).alias("lon"))
    back = df.select(
        F.max(F.abs(geodesy.lat_of(geodesy.mercator_y(F.col("lat"))) - F.col("lat"))),
        F.max(F.abs(geodesy.lon_of(geodesy.mercator_x(F.col("lon"))) - F.col("lon"))),
    ).first()
    assert max(back) < 1e-9
