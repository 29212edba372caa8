"""Headline queries, timed one by one.  Prints one JSON line.

BENCH_SF_DIR   folder of the given tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from catalog import queries as q  # noqa: E402
from catalog.tables import imported, node_table, way_table  # noqa: E402
from mapweave.config import TerrainConfig, WorldConfig  # noqa: E402
from mapweave.operators import faces, features, mask, raster, tiles  # noqa: E402
from mapweave.plans import terrain_world  # noqa: E402
from mapweave.plans.importing import import_map, tile_faces  # noqa: E402
from mapweave.session import local_session  # noqa: E402


def run(df: DataFrame) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark: SparkSession = local_session(cpus, shuffle_partitions=2 * int(cpus), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.time()
        job()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("prepare_nodes_and_ways", lambda: (node_table(spark, sf_dir), way_table(spark, sf_dir)))
    nodes, ways = node_table(spark, sf_dir), way_table(spark, sf_dir)
    fresh = import_map(nodes, ways)
    timed("resolve_and_project", lambda: run(features.resolve(ways, features.local_nodes(nodes, fresh.origin))))
    timed("import_and_count_tiles", lambda: run(tiles.tile_totals(fresh.bridge())))
    timed("roads_by_tile_and_class", lambda: run(q.QUERIES["til3_tiles_by_class"](spark, sf_dir)))
    timed("store_features", lambda: imported(spark, sf_dir))
    m = imported(spark, sf_dir)
    for name in ("agg8_signed_area", "agg9_centroid", "agg12_principal_axis", "ord2_tangents", "ord4_simplify"):
        timed(name, lambda: run(q.QUERIES[name](spark, sf_dir)))
    timed("building_faces", lambda: run(faces.building_faces(m.buildings)))
    timed("road_faces", lambda: run(faces.road_faces(m.roads)))
    timed("junctions_per_tile", lambda: run(q.QUERIES["geo5_junctions"](spark, sf_dir)))
    timed("all_tile_faces", lambda: run(tile_faces(m)))
    timed("visible_faces", lambda: run(q.QUERIES["geo9_visible_faces"](spark, sf_dir)))
    # The default world: 8 x 8 chunks of 128 x 128 cells, 1 048 576 cells.
    world = WorldConfig(terrain=TerrainConfig())
    cells = terrain_world.world_cells(spark, world)
    timed("elevation_1m_cells", lambda: run(cells))
    timed("surface_1m_cells", lambda: run(raster.surface_vertices(cells, world.terrain, *terrain_world.chunk_steps(world))))
    timed("thermal_pass_1m_cells", lambda: run(raster.thermal_pass(cells, world.terrain)))
    # The world that fits the map, levelled under all its features.
    fitted = terrain_world.fitted_world(q._boxes(spark, sf_dir), WorldConfig(terrain=q.TERRAIN))
    timed("flatten_mask", lambda: run(mask.flatten_mask(m.roads, m.buildings, m.areas, fitted)))
    flat = q._mask(spark, sf_dir)
    timed("levelled_world", lambda: run(mask.apply_mask(terrain_world.world_cells(spark, fitted), flat, fitted)))
    print(json.dumps({
        "metric": "total seconds of all headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
