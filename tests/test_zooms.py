"""Interleaved keys, key intervals and the pyramid of counts."""

import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions import zkeys
from mapweave.operators import zooms


def number(x, y):
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(31))


def test_keys_and_back(spark):
    rng = random.Random(3)
    at = [(0, 0), (1, 0), (0, 1), (2**31 - 1, 2**31 - 1), (2**31 - 1, 0)] + [(rng.randrange(2 ** rng.randint(1, 31)), rng.randrange(2 ** rng.randint(1, 31))) for _ in range(300)]
    df = spark.createDataFrame(at, "tx int, ty int").select("tx", "ty", zkeys.tile_key(F.col("tx"), F.col("ty")).alias("z"))
    rows = df.select("*", zkeys.key_column(F.col("z")).alias("x"), zkeys.key_row(F.col("z")).alias("y"), zkeys.parent_key(F.col("z"), 3).alias("p")).collect()
    assert all((r.z, r.x, r.y, r.p) == (number(r.tx, r.ty), r.tx, r.ty, number(r.tx >> 3, r.ty >> 3)) for r in rows)


@pytest.mark.parametrize("box", [(0, 0, 0, 0), (0, 0, 7, 7), (1, 2, 13, 9), (5, 5, 5, 20), (3, 0, 2, 4), (6, 7, 9, 8)])
def test_intervals_hold_the_rectangle(box):
    x0, y0, x1, y1 = box
    want = {number(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    exact = zkeys.intervals(*box, most=10_000)
    assert {k for a, b in exact for k in range(a, b + 1)} == want
    assert all(a[1] + 1 < b[0] for a, b in zip(exact, exact[1:]))
    few = zkeys.intervals(*box, most=3)
    assert len(few) <= 3 and want <= {k for a, b in few for k in range(a, b + 1)}


def test_work_follows_the_border():
    assert len(zkeys.intervals(1, 1, 2**20, 2**20, most=64)) <= 64
    assert zkeys.intervals(0, 0, 2**20 - 1, 2**20 - 1) == [(0, 2**40 - 1)]


def test_pyramid_equals_counting_by_hand(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["road", "area"]), k, rng.randrange(40), rng.randrange(25)) for k in range(2000)]
    bridge = spark.createDataFrame(rows, "kind string, osm_id long, tx int, ty int")
    made = zooms.pyramid(zooms.tile_counts(bridge), 3)
    zooms.write_pyramid(made, str(tmp_path / "p"))
    for zoom in range(4):
        x, y = (3 >> zoom, 21 >> zoom), (-2, 11 >> zoom)
        want, under = {}, {}
        for kind, _, tx, ty in rows:
            at = (kind, zoom, tx >> zoom, ty >> zoom)
            if x[0] <= at[2] <= x[1] and at[3] <= y[1]:
                want[at] = want.get(at, 0) + 1
                under.setdefault(at, set()).add((tx, ty))
        for most in (1, 100):
            got = zooms.read_range(spark, str(tmp_path / "p"), zoom, x, y, most)
            assert {tuple(r)[:4]: tuple(r)[4:] for r in got.collect()} == {k: (n, len(under[k])) for k, n in want.items()}


def test_range_is_pushed_as_intervals(spark, tmp_path):
    bridge = spark.range(3000).selectExpr("'road' as kind", "id as osm_id", "cast(id % 60 as int) as tx", "cast(id div 60 as int) as ty")
    zooms.write_pyramid(zooms.pyramid(zooms.tile_counts(bridge), 2), str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    got = zooms.read_range(spark, str(tmp_path / "p"), 1, (4, 7), (8, 11))
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    low = number(4, 8)
    assert f"GreaterThanOrEqual(key,{low})" in plan and f"LessThanOrEqual(key,{low + 15})" in plan and "PartitionFilters: [isnotnull(zoom" in plan
    assert got.count() == 16


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "kind string, osm_id long, tx int, ty int")
    assert zooms.pyramid(zooms.tile_counts(empty), 2).isEmpty()
