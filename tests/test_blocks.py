"""Packed raster blocks: packing and unpacking, lookups over block borders, missing cells."""

import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators import blocks


def cells(spark, width, height, keep, keys=((0,),)):
    rows = [(*k, x, z, 1000.0 * k[0] + x + z / 256) for k in keys for x in range(width) for z in range(height) if keep(x, z)]
    return spark.createDataFrame(rows, "k int, ix int, iz int, v double")


@pytest.mark.parametrize("width, height", [(1, 1), (7, 3), (64, 64), (65, 64), (130, 70)])
def test_all_cells_come_back(spark, width, height):
    df = cells(spark, width, height, lambda x, z: True, keys=((1,), (2,)))
    packed = blocks.pack(df, ["k"], "v", width, height)
    assert packed.count() == 2 * -(-width // 64) * -(-height // 64)
    back = blocks.unpack(packed, ["k"], "v", width, height)
    assert {tuple(r) for r in back.where("v is not null").collect()} == {tuple(r) for r in df.collect()}


def test_missing_cells_are_filled_and_cells_outside_left_out(spark):
    keep = lambda x, z: (x * 7 + z * 3) % 5 == 0
    df = cells(spark, 100, 90, keep).union(spark.createDataFrame([(0, 100, 3, 9.0), (0, -1, 3, 9.0)], "k int, ix int, iz int, v double"))
    got = {(r.ix, r.iz): r.v for r in blocks.unpack(blocks.pack(df, ["k"], "v", 100, 90, fill=-1.0), ["k"], "v", 100, 90).collect()}
    assert all(got[x, z] == (x + z / 256 if keep(x, z) else -1.0) for x in range(100) for z in range(90))


def test_lookup_takes_the_four_cells_around(spark):
    width, height, rng = 130, 70, random.Random(1)
    df = cells(spark, width, height, lambda x, z: True)
    at = [(0, rng.uniform(-3, width + 3), rng.uniform(-3, height + 3)) for _ in range(300)] + [(0, 63.5, 63.5), (0, 64.0, 0.0), (0, 129.0, 69.0), (5, 1.0, 1.0)]
    points = spark.createDataFrame(at, "k int, gx double, gz double")
    rows = blocks.look_up(points, blocks.pack(df, ["k"], "v", width, height), ["k"], width, height).collect()
    assert len(rows) == len(at)
    for r in rows:
        x, z = (min(max(int(g // 1), 0), n - 1) for g, n in ((r.gx, width), (r.gz, height)))
        want = [min(x + dx, width - 1) + min(z + dz, height - 1) / 256 for dx in (0, 1) for dz in (0, 1)]
        assert [r.c00, r.c01, r.c10, r.c11] == (want if r.k == 0 else [None] * 4)
        assert r.fx == (0.0 if r.gx < 0 else pytest.approx(r.gx - r.gx // 1)) and r.fz == (0.0 if r.gz < 0 else pytest.approx(r.gz - r.gz // 1))


def test_one_join_and_no_product(spark):
    df = cells(spark, 10, 10, lambda x, z: True)
    points = spark.createDataFrame([(0, 1.5, 2.5)], "k int, gx double, gz double")
    plan = blocks.look_up(points, blocks.pack(df, ["k"], "v", 10, 10), ["k"], 10, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 1


def test_no_cells(spark):
    df = spark.createDataFrame([], "k int, ix int, iz int, v double")
    packed = blocks.pack(df, ["k"], "v", 3, 3)
    assert packed.isEmpty()
    points = spark.createDataFrame([(0, 1.5, 2.5)], "k int, gx double, gz double")
    assert blocks.look_up(points, packed, ["k"], 3, 3).where(F.col("c00").isNull()).count() == 1
