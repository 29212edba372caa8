"""The tile store: only missing tiles are built, other files stay, a run that dies leaves the store whole."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog.tables import nodes, ways
from mapweave.operators import meshes, visibility
from mapweave.plans import tile_build
from mapweave.plans.importing import import_map, tile_faces, tile_meshes
from mapweave.plans.tile_build import TileStore, build_tiles
from mapweave.sources import tile_store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def file_times(path):
    """Modification time of every data file by folder."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(os.path.relpath(folder, path), {})[n] = os.stat(f"{folder}/{n}").st_mtime_ns
    return out


@pytest.fixture(scope="module")
def map_parts(spark, tmp_path_factory):
    """Nodes and ways; the ways of one corner apart, so that they can come later."""
    n, w = nodes(spark, SF), ways(spark, SF)
    path = tmp_path_factory.mktemp("map")
    n.write.parquet(f"{path}/n")
    w.write.parquet(f"{path}/w")
    n, w = spark.read.parquet(f"{path}/n"), spark.read.parquet(f"{path}/w")
    return n, w


def content(store):
    return {tuple(r) for r in store.meshes().select("tx", "ty", "mesh", F.size("faces"), *meshes.BOX).collect()}


def test_only_missing_tiles_are_built(spark, map_parts, tmp_path):
    n, w = map_parts
    store = TileStore(spark, str(tmp_path / "store"), span=1)
    box = store.keep_box(import_map(n, w).box)
    m = import_map(n, w, box=box)
    # The ways that lie in the first tile column alone come later.
    columns = m.bridge().groupBy("osm_id").agg(F.max("tx").alias("last"))
    late = [r["osm_id"] for r in columns.where("last = 0").orderBy("osm_id").limit(3).collect()]
    early = import_map(n, w.where(~F.col("way_id").isin(late)), box=box)
    first = {(r["tx"], r["ty"]) for r in build_tiles(store, early).collect()}
    assert first == {(r["tx"], r["ty"]) for r in early.bridge().select("tx", "ty").distinct().collect()}
    before = file_times(f"{store.path}/meshes")

    second = {(r["tx"], r["ty"]) for r in build_tiles(store, m).collect()}
    changed = {(r["tx"], r["ty"]) for r in m.bridge().where(F.col("osm_id").isin(late)).select("tx", "ty").distinct().collect()}
    assert second == changed and changed and changed != first
    after = file_times(f"{store.path}/meshes")
    assert {f for f in after if after[f] != before.get(f)} == {f"px={x}/py={y}" for x, y in changed}

    whole = TileStore(spark, str(tmp_path / "whole"), span=1)
    build_tiles(whole, m)
    assert content(store) == content(whole)
    assert {r["run"] for r in store.built().select("run").collect()} == {1, 2}
    assert build_tiles(store, m).count() == 0 and file_times(f"{store.path}/meshes") == after


def test_blocks_keep_their_other_tiles_and_lose_empty_ones(spark, map_parts, tmp_path):
    n, w = map_parts
    store = TileStore(spark, str(tmp_path / "store"), span=4)
    m = import_map(n, w)
    some = m.bridge().select("tx", "ty").distinct().where("(tx + ty) % 2 = 0")
    build_tiles(store, m, some)
    assert {(r["tx"], r["ty"]) for r in store.built().collect()} == {(r["tx"], r["ty"]) for r in some.collect()}
    build_tiles(store, m)
    full = content(store)
    assert full == {tuple(r) for r in tile_meshes(m).select("tx", "ty", "mesh", F.size("faces"), *meshes.BOX).collect()}

    # Without its roads the map has fewer tiles or smaller ones; with none it is empty.
    no_roads = replace(m, roads=m.roads.limit(0))
    build_tiles(store, no_roads)
    assert content(store) == {r for r in full if not r[2].startswith(("road", "junction"))}
    build_tiles(store, replace(no_roads, buildings=m.buildings.limit(0), areas=m.areas.limit(0)))
    assert store.built().isEmpty() and store.meshes().isEmpty()
    assert store.ledger().where("state <> 'gone'").isEmpty()


def test_a_run_that_dies_is_made_good(spark, map_parts, tmp_path, monkeypatch):
    n, w = map_parts
    m = import_map(n, w)
    store = TileStore(spark, str(tmp_path / "store"), span=2)
    near = m.bridge().select("tx", "ty").distinct().where("tx < 2")
    build_tiles(store, m, near)
    kept = content(store)

    real = tile_build._overwrite

    def dies(rows, path):
        if path.endswith("meshes"):
            raise RuntimeError("lost")
        real(rows, path)

    monkeypatch.setattr(tile_build, "_overwrite", dies)
    with pytest.raises(RuntimeError, match="lost"):
        build_tiles(store, m)
    monkeypatch.setattr(tile_build, "_overwrite", real)
    # Tiles of the blocks it had begun are not shown; all others are as they were.
    assert content(store) <= kept
    build_tiles(store, m)
    assert content(store) == {tuple(r) for r in tile_meshes(m).select("tx", "ty", "mesh", F.size("faces"), *meshes.BOX).collect()}
    assert store.ledger().where("state = 'building'").isEmpty()


def test_a_map_that_grows_keeps_its_frame(spark, map_parts, tmp_path):
    n, w = map_parts
    store = TileStore(spark, str(tmp_path / "store"))
    small = import_map(n.where("node_id < 100"), w)
    box = store.keep_box(small.box)
    again = store.keep_box(import_map(n, w).box)
    assert box.collect() == again.collect() == small.box.collect()


def test_meshes_hold_all_faces_and_their_boxes(spark, map_parts):
    m = import_map(*map_parts)
    rows = tile_meshes(m)
    assert rows.columns == meshes.COLUMNS
    back = meshes.faces_of(rows)
    made = tile_faces(m).select(back.columns)
    assert back.count() == made.count() and back.exceptAll(made).isEmpty()
    far = F.expr("exists(faces, f -> least(f.x0, f.x1, f.x2, f.x3) < min_x or greatest(f.z0, f.z1, f.z2, f.z3) > max_z)")
    assert rows.where(far).isEmpty()
    rings = rows.where("kind = 'area'")
    assert rings.where("faces is not null or ring is null or size(ring) < 4 or min_y <> max_y").isEmpty() and not rings.isEmpty()


def test_view_reads_boxes_only(spark, map_parts, tmp_path):
    """The reach of the eye is pushed to the scan, implied by the distance test, and nothing is grouped."""
    m = import_map(*map_parts)
    tile_store.write_tiles(tile_meshes(m), str(tmp_path / "s"), span=2)
    rows = tile_store.read_tiles(spark, str(tmp_path / "s"), span=2)
    eye, radius = (50.0, 0.0, 60.0), 300.0
    near = rows.where(visibility.near_flat(eye, radius))
    seen = rows.where(meshes.in_reach(eye, radius) & visibility.near_flat(eye, radius))
    assert 0 < seen.count() == near.count() < rows.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = rows.where(meshes.in_reach(eye, radius) & visibility.near_flat(eye, radius))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Aggregate" not in plan and "Join" not in plan
    assert "LessThanOrEqual(min_x" in plan and "GreaterThanOrEqual(max_z" in plan
