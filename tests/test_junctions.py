import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions.shapes import SHAPE_TYPE
from mapweave.operators import proximity

POINTS = "idx long, x double, y double"


def turn(idx):
    """The order in which points are met."""
    high, low = divmod(idx + 2**61, 2**31)
    for constant in proximity._ROUNDS:
        high, low = low, (high + ((low + constant) % (2**31 - 1)) ** 2 % (2**31 - 1)) % 2**31
    return high * 2**31 + low


def by_hand(points, distance=2.0):
    """The sequential rule: in order, each free point takes all later free points near itself."""
    left, seed = sorted(points, key=lambda p: turn(p[0])), {}
    for i, (idx, x, y) in enumerate(left):
        if idx in seed:
            continue
        seed[idx] = idx
        for other, ox, oy in left[i + 1 :]:
            if other not in seed and (ox - x) ** 2 + (oy - y) ** 2 < distance**2:
                seed[other] = idx
    return seed


def grouped(spark, points):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], POINTS)
    return {r.idx: r.seed for r in proximity.greedy_groups(df, 2.0, []).collect()}


def test_chain_is_not_transitive(spark):
    a, b, c = sorted((1, 2, 3), key=turn)
    assert grouped(spark, [(a, 0, 0), (b, 1.5, 0), (c, 3, 0)]) == {a: a, b: a, c: c}
    assert grouped(spark, [(b, 0, 0), (a, 1.5, 0), (c, 3, 0)]) == {a: a, b: a, c: a}
    assert grouped(spark, [(1, 0, 0), (2, 2.0, 0)]) == {1: 1, 2: 2}


def test_mixed_numbers(spark):
    rng = random.Random(5)
    numbers = [*range(-300, 300), *(rng.randrange(-(2**61), 2**61) for _ in range(500)), 2**61 - 1, -(2**61)]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    rows = df.select("n", proximity.mixed(F.col("n")).alias("m")).select("n", "m", proximity.unmixed(F.col("m")).alias("back")).collect()
    assert [(r.n, r.m, r.back) for r in rows] == [(n, turn(n), n) for n in numbers]


@pytest.mark.parametrize("step", [1, 2, 13, -7])
def test_long_chains_settle_in_few_rounds(spark, step):
    """Numbered along the chain, in which every place waits for the one before it in an ascending order."""
    points = [(10_000 + step * k, 1.5 * k, 0.0) for k in range(200)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], POINTS)
    found, rounds = proximity.greedy_rounds(df, 2.0, [])
    assert {r.idx: r.seed for r in found.collect()} == by_hand(points)
    assert rounds <= 12


def test_same_as_sequential_rule(spark):
    rng = random.Random(11)
    crowded = [(i, rng.uniform(0, 12), rng.uniform(0, 12)) for i in rng.sample(range(1000), 120)]
    one_cell = [(1000 + i, 50 + rng.random(), 50 + rng.random()) for i in range(60)]
    line = [(2000 + i, 100 + 1.3 * i, 0.0) for i in range(12)]
    points = crowded + one_cell + line
    assert grouped(spark, points) == by_hand(points)


def test_ends_at_one_place_are_one_spot(spark):
    roads = spark.createDataFrame(
        [(1, 4.0, [(0.0, 0.0), (9.0, 0.0), (0.0, 0.0)]), (2, 10.0, [(0.0, 0.0), (50.0, 0.0)]), (3, 2.0, [(5.0, 5.0)])],
        f"osm_id long, width double, polyline {SHAPE_TYPE}",
    )
    found = proximity.junctions(roads).collect()
    assert [(r.seed, r.ends, r.x, r.y, r.radius) for r in found] == [(2, 3, 0.0, 0.0, 6.0)]  # named by the lowest end there


def test_no_product_join_in_plan(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], POINTS)
    cells = proximity.with_cells(df, 2.0)
    plan = proximity.near_pairs(cells, proximity.cell_leaders(cells, []), 2.0, [])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
