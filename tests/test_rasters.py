import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.config import SurfaceConfig, TerrainConfig, WorldConfig
from mapweave.functions import noise
from mapweave.functions.shapes import SHAPE_TYPE
from mapweave.operators import mask, raster

CELL = "cx int, cz int, ix int, iz int, x double, z double, h double"


def grid(spark, heights):
    rows = [(0, 0, i, j, float(i), float(j), float(h)) for j, line in enumerate(heights) for i, h in enumerate(line)]
    return spark.createDataFrame(rows, CELL)


def config(n):
    return TerrainConfig(resolution_x=n, resolution_z=n)


def test_seed_zero_is_seed_one():
    assert noise.permutation(0) == noise.permutation(1) != noise.permutation(2)
    assert sorted(noise.permutation(12345)) == list(range(256))


def test_steepest_and_thermal_pass(spark):
    flat = grid(spark, [[1] * 3] * 3)
    assert raster.steepest(flat, config(3)).count() == 0
    exact = grid(spark, [[1, 1, 1], [1, 1.5, 1], [1, 1, 1]])
    assert raster.steepest(exact, config(3)).count() == 0
    spike = grid(spark, [[5, 5, 5], [2, 5, 2], [5, 1, 5]])
    assert [(r.to_ix, r.to_iz, r["drop"]) for r in raster.steepest(spike, config(3)).collect()] == [(1, 2, 4)]
    tie = grid(spark, [[5, 5, 5], [2, 5, 2], [5, 5, 5]])
    moved = {(r.ix, r.iz): r.h for r in raster.thermal_pass(tie, config(3)).collect()}
    assert moved[1, 1] == pytest.approx(5 - 2.5 * 0.05) and moved[0, 1] == pytest.approx(2 + 2.5 * 0.05)
    assert sum(moved.values()) == pytest.approx(39)


def test_large_grid_in_blocks_sees_all_neighbours(spark):
    n = raster.BLOCK * 2 + 3
    t = TerrainConfig(resolution_x=n, resolution_z=n)
    cells = raster.single_grid(spark, t).withColumn("h", F.col("ix") * 1000.0 + F.col("iz"))
    near = raster.with_neighbours(cells, n, n, diagonal=True)
    wrong = near.where(
        (F.col("hl") != F.col("h") - 1000) | (F.col("hr") != F.col("h") + 1000) | (F.col("hd") != F.col("h") - 1)
        | (F.col("hu") != F.col("h") + 1) | (F.col("hru") != F.col("h") + 1001)
    )
    assert near.count() == n * n and wrong.count() == 0
    assert near.where("hl is null").count() == near.where("hu is null").count() == n


def test_bilinear_sample(spark):
    world = WorldConfig(chunk_size=2.0, world_min=(0.0, 0.0), world_max=(2.0, 2.0), terrain=config(3), base_height=-7.0)
    cells = grid(spark, [[0, 1, 2], [10, 11, 12], [20, 21, 22]])
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.999, 0.0), (4, -0.5, 0.0), (5, 2.5, 9.0)], "k int, x double, z double")
    got = {r.k: r.h for r in raster.sample_heights(points, cells, world).collect()}
    assert got == pytest.approx({1: 5.5, 2: 11, 3: 1.999, 4: -7, 5: -7})


def test_colour_modes_and_water(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (1.0, 60.0, 1.0), (1.0, 35.0, 0.35), (-1.0, 60.0, 0.5)], "h double, slope double, rel double")
    colour = lambda mode: [tuple(r.c) for r in df.select(
        raster.surface_colour(F.col("h"), F.col("slope"), F.col("rel"), SurfaceConfig(color_mode=mode)).alias("c")).collect()]
    assert colour("Solid")[0] == (0.4, 0.5, 0.3, 1.0)
    assert colour("HeightGradient")[2] == pytest.approx((0.45, 0.475, 0.375, 1.0))
    assert colour("SlopeGradient")[1] == pytest.approx((0.5, 0.45, 0.4, 1.0))
    assert colour("Biome")[2] == pytest.approx((0.475, 0.4625, 0.3875, 1.0))
    assert all(colour(m)[3] == (0.35, 0.4, 0.35, 1.0) for m in ("Solid", "Biome"))


def test_surface_triangles_by_level(spark):
    cells = grid(spark, [[0] * 5] * 5)
    count = lambda lod: raster.surface_triangles(cells, config(5), 1.0, 1.0, lod).count()
    assert [count(lod) for lod in (0, 1, 2, 3)] == [32, 8, 2, 0]


def test_custom_colour_may_be_a_pandas_function(spark):
    import pandas as pd

    @F.pandas_udf("r double, g double, b double, a double")
    def mine(x: pd.Series, z: pd.Series, height: pd.Series, slope: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"r": x, "g": z, "b": height, "a": slope})

    got = raster.surface_vertices(grid(spark, [[1, 2], [3, 4]]), config(2), 1.0, 1.0, colour=mine).collect()
    assert {(r.ix, r.iz): r.color.b for r in got} == {(0, 0): 1, (1, 0): 2, (0, 1): 3, (1, 1): 4}


WORLD = WorldConfig(chunk_size=40.0, chunk_resolution=8, world_min=(-20.0, -20.0), world_max=(20.0, 20.0), flatten_radius=2.0, blend_distance=6.0)


def cells_by_hand(world):
    width, height = mask.mask_size(world)
    return [(i, j, world.world_min[0] + i * world.mask_cell, world.world_min[1] + j * world.mask_cell) for i in range(width) for j in range(height)]


def eased(d, radius, falloff):
    if d <= radius:
        return 1.0
    t = (d - radius) / falloff
    return 1.0 - t * t * (3 - 2 * t) if t <= 1 else 0.0


def ring_by_hand(ring, world):
    out = {}
    for i, j, x, y in cells_by_hand(world):
        inside, best = False, math.inf
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
            if (qy > y) != (py > y) and x < (px - qx) * (y - qy) / (py - qy) + qx:
                inside = not inside
            square = (qx - px) ** 2 + (qy - py) ** 2
            if square >= 1e-4:
                t = max(0.0, min(1.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / square))
                best = min(best, math.dist((x, y), (px + t * (qx - px), py + t * (qy - py))))
        w = 1.0 if inside else eased(best, 0.0, world.blend_distance)
        if w > 0:
            out[i, j] = w
    return out


def line_by_hand(line, width, world):
    out, radius = {}, world.flatten_radius + width / 2
    for (px, py), (qx, qy) in zip(line, line[1:]):
        n = max(2, int(math.dist((px, py), (qx, qy)) / (world.mask_cell / 2)))
        for k in range(n + 1):
            sx, sy = px + (qx - px) * k / n, py + (qy - py) * k / n
            for i, j, x, y in cells_by_hand(world):
                w = eased(math.dist((x, y), (sx, sy)), radius, world.blend_distance)
                if w > 0:
                    out[i, j] = max(out.get((i, j), 0.0), w)
    return out


def test_mask_of_rings_and_lines(spark):
    rng = random.Random(5)
    concave = [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (0.0, -5.0), (-10.0, 10.0)]
    rings = {1: concave, 2: concave + concave[:1], 3: [(-60.0, -60.0), (60.0, -60.0), (0.0, 60.0)], 4: [(0.0, 0.0), (5.0, 5.0)]}
    for k in range(5, 15):
        rings[k] = [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(rng.randint(3, 8))]
    df = spark.createDataFrame([(k, v) for k, v in rings.items()], f"osm_id long, shape {SHAPE_TYPE}")
    got = {k: {} for k in rings}
    for r in mask.blend(mask.paint(mask.polygon_strips(df, WORLD), WORLD), "osm_id").collect():
        got[r.osm_id][r.ix, r.iz] = r.weight
    for k, ring in rings.items():
        assert got[k] == pytest.approx(ring_by_hand(ring, WORLD) if len(ring) >= 3 else {}, abs=1e-9), k
    lines = {k: [(rng.uniform(-25, 25), rng.uniform(-25, 25)) for _ in range(rng.randint(2, 5))] for k in range(8)}
    lines[8] = [(1.0, 1.0), (1.0, 1.0)]
    df = spark.createDataFrame([(k, v, 3.0) for k, v in lines.items()], f"osm_id long, shape {SHAPE_TYPE}, width double")
    got = {k: {} for k in lines}
    for r in mask.blend(mask.paint(mask.line_strips(df, WORLD), WORLD), "osm_id").collect():
        got[r.osm_id][r.ix, r.iz] = r.weight
    for k, line in lines.items():
        assert got[k] == pytest.approx(line_by_hand(line, 3.0, WORLD), abs=1e-9), k


def test_cells_of_features_are_not_shuffled(spark):
    """Each feature by itself: as blending after painting, with a shuffle of strips and none after the cells are made."""
    world = WorldConfig(world_min=(0.0, 0.0), world_max=(1000.0, 1000.0))
    ring = lambda i: [(40.0 * i, 30.0), (40.0 * i + 300.0, 80.0), (40.0 * i + 100.0, 500.0)]
    rings = spark.createDataFrame([(i, ring(i)) for i in range(5)], f"osm_id long, shape {SHAPE_TYPE}")
    strips = mask.polygon_strips(rings, world)
    got = mask.feature_cells(strips, world)
    want = mask.blend(mask.paint(strips, world), "osm_id")
    rows = lambda df: {(r.osm_id, r.ix, r.iz): r.weight for r in df.collect()}
    assert rows(got) == rows(want) and len({k[0] for k in rows(got)}) == 5
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "sequence(first" in line)
    assert not any("Exchange" in line for line in plan[:made])


def test_totals_of_features_are_added_up_where_cells_are_found(spark, monkeypatch):
    """What each ring and line covers equals its cells counted; ids of equal shapes, copies of an id, shapes of several bands
    and squares, lost points and thin rings included, and no cell leaves a task."""
    monkeypatch.setattr(mask, "BAND", 200)
    rng = random.Random(8)
    world = WorldConfig(world_min=(-1500.0, -3000.0), world_max=(1500.0, 3000.0))
    some = lambda n, x, y: [(rng.uniform(-x, x), rng.uniform(-y, y)) for _ in range(n)]
    shapes_ = [some(rng.randint(3, 9), 1700, 3300) for _ in range(6)] + [some(rng.randint(3, 6), 200, 200) for _ in range(12)]
    shapes_ += [[(0.0, 0.0), (5.0, 5.0)], [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0)], [(9000.0, 0.0), (9100.0, 0.0), (9000.0, 50.0)], [(3.0, 3.0)]]
    shapes_ += [[(20.0 * math.cos(k / 40), 2500.0 * math.sin(k / 40)) for k in range(252)]]
    shapes_ += [[(0.0, 0.0), (0.005, 0.0), (0.005, 0.005), (0.0, 0.005)], None]
    lost = [(0.0, 0.0), (100.0, 0.0), (None, 40.0), (100.0, 100.0), (0.0, 100.0)]
    rows = [(k * 100 + i, shape, 3.0 * k) for k in range(1, 4) for i, shape in enumerate(shapes_)]
    rows += [(100, shapes_[0], 9.0), (110, shapes_[10], None), (110, shapes_[10], -30.0), (999, shapes_[9], -30.0)]
    df = spark.createDataFrame(rows, f"osm_id long, shape {SHAPE_TYPE}, width double")

    def counted(strips):
        cells = mask.blend(mask.paint(strips, world), "osm_id").groupBy("osm_id")
        return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("weight") == 1.0).alias("full"), F.sum("weight").alias("weight"))

    rows_of = lambda got: {r.osm_id: (r.cells, r.full, pytest.approx(r.weight, rel=1e-9)) for r in got.collect()}
    lines = df.unionByName(spark.createDataFrame([(500, lost, 2.0)], df.schema))
    for got, strips in (
        (mask.ring_totals(df, world), mask.polygon_strips(df.select("osm_id", "shape").distinct(), world)),
        (mask.line_totals(lines, world), mask.line_strips(lines, world)),
    ):
        want = rows_of(counted(strips))
        assert {r.osm_id: (r.cells, r.full, r.weight) for r in got.collect()} == want and len(want) > 50
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "sequence(first" not in plan and got.columns == ["osm_id", "cells", "full", "weight"]


def test_mask_of_all_features_meets_copies_once(spark):
    """The highest weight over all rings and lines; copies add no piece, and of equal lines the widest counts."""
    rng = random.Random(6)
    world = WorldConfig(chunk_size=400.0, chunk_resolution=64, world_min=(-400.0, -400.0), world_max=(400.0, 400.0), flatten_radius=4.0, blend_distance=30.0)
    some = lambda n: [(rng.uniform(-450, 450), rng.uniform(-450, 450)) for _ in range(n)]
    rings = [some(rng.randint(3, 7)) for _ in range(4)] + [[(0.0, 0.0), (5.0, 5.0)]]
    lines = [some(rng.randint(2, 4)) for _ in range(6)] + [[(1.0, 1.0), (1.0, 1.0)]]

    def tables(copies):
        r = [(k * 100 + i, ring) for k in range(copies) for i, ring in enumerate(rings)]
        n = [(k * 100 + i, line, 3.0 + k) for k in range(copies) for i, line in enumerate(lines)] + [(7, lines[0], None)]
        return spark.createDataFrame(r, f"osm_id long, shape {SHAPE_TYPE}"), spark.createDataFrame(n, f"osm_id long, shape {SHAPE_TYPE}, width double")

    df = tables(3)
    got = {(r.ix, r.iz): r.weight for r in mask.flatten(*df, world).collect()}
    strips = mask.polygon_strips(df[0], world).unionByName(mask.line_strips(df[1], world))
    want = {(r.ix, r.iz): r.weight for r in mask.blend(mask.paint(strips, world)).collect()}
    assert got == pytest.approx(want, abs=1e-12) and 1.0 in got.values() and min(got.values()) < 0.1
    # More copies are wider lines as well, which may reach one block more, but no second piece in any block.
    again = mask.pieces(*tables(9), world)
    assert again.count() < 1.5 * mask.pieces(*tables(1), world).count() and again.count() == again.distinct().count()


def test_mask_sample_and_levelling(spark):
    flat = spark.createDataFrame([(0, 0, 1.0), (8, 8, 0.5)], "ix int, iz int, weight double")
    points = spark.createDataFrame([(1, -20.0, -20.0), (2, -17.5, -20.0), (3, 20.0, 20.0), (4, 30.0, 30.0), (5, 0.0, 0.0), (6, -30.0, -20.0)], "k int, x double, z double")
    got = {r.k: r.weight for r in mask.sample_mask(points, flat, WORLD).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.0, 6: 1.0})
    cell = spark.createDataFrame([(0, 0, 0, 0, -17.5, -20.0, 8.0)], CELL)
    assert mask.apply_mask(cell, flat, WORLD).first().h == pytest.approx(4.0)


def test_chunks_from_a_grouping_are_expanded_by_many_tasks(spark):
    """A grouping by chunk before the grid once took the grid's own repartition out, and one task made all cells."""
    world = WorldConfig(terrain=config(4))
    points = spark.range(64).select((F.col("id") % 8 * 500.0 - 1999.0).alias("x"), (F.floor(F.col("id") / 8) * 500.0 - 1999.0).alias("z"))
    cells = raster.chunk_grid(raster.chunks_of_points(points, world), world)
    tasks = cells.select(F.spark_partition_id().alias("task")).distinct().count()
    assert cells.count() == 64 * 16 and tasks > 4
