"""From nodes and ways to features, tiles and faces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ImportConfig, TileConfig
from ..operators import extents, faces, features, meshes, proximity, tiles


@dataclass(frozen=True)
class MapTables:
    """A map in local metres.  All tables are lazy; store those used more than once."""

    box: DataFrame
    origin: DataFrame
    grid: DataFrame
    shaped: DataFrame
    roads: DataFrame
    buildings: DataFrame
    areas: DataFrame

    def features(self) -> DataFrame:
        return features.feature_shapes(self.roads, self.buildings, self.areas)

    def bridge(self) -> DataFrame:
        """kind, osm_id, tx, ty"""
        return tiles.feature_tiles(self.features(), self.grid)


def import_map(
    nodes: DataFrame, ways: DataFrame, config: ImportConfig = ImportConfig(), tile: TileConfig = TileConfig(),
    box: DataFrame | None = None,
) -> MapTables:
    """Classify, resolve and tile.  All kinds of features share one join of references to nodes.

    Origin and grid follow from the box of all nodes; give the ``box`` of an earlier import to keep places and tile
    keys as they were while the map grows."""
    nodes = features.nodes_in_bounds(nodes, config)
    box = extents.bounds(nodes) if box is None else box
    origin = extents.origin(box)
    shaped = features.resolve(features.candidate_ways(ways, config), features.local_nodes(nodes, origin))
    return MapTables(
        box=box, origin=origin, grid=tiles.tile_grid(box, tile), shaped=shaped,
        roads=features.roads(ways, shaped, config),
        buildings=features.buildings(ways, shaped, config),
        areas=features.areas(ways, shaped, config),
    )


def tile_faces(m: MapTables, wanted: DataFrame | None = None) -> DataFrame:
    """All faces by tile: kind, mesh, tx, ty and face columns; junctions are found per tile over its roads.

    ``mesh`` names what is drawn and tested as one: a road, a building, or a junction by its seed.  A feature's tiles are
    found in its own row and its faces are made from there, so faces are not joined with tiles.  ``wanted`` (tx, ty)
    keeps to some tiles before any face is made."""

    def placed(features: DataFrame, shape: str) -> DataFrame:
        copies = tiles.with_tiles(features, shape, m.grid)
        return copies if wanted is None else copies.join(wanted.select("tx", "ty"), ["tx", "ty"], "left_semi")

    roads = placed(m.roads, "polyline")
    made = {"road": faces.road_faces(roads, "tx", "ty"), "building": faces.building_faces(placed(m.buildings, "footprint"), "tx", "ty")}
    parts = [
        rows.select("tx", "ty", F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind} "), F.col("osm_id").cast("string")).alias("mesh"), *faces.FACE_COLUMNS)
        for kind, rows in made.items()
    ]
    met = proximity.junctions(roads, "tx", "ty")
    discs = proximity.junction_faces(met, "tx", "ty").select(
        "tx", "ty", F.lit("road").alias("kind"), F.concat(F.lit("junction "), F.col("seed").cast("string")).alias("mesh"), *faces.FACE_COLUMNS
    )
    return parts[0].unionByName(parts[1]).unionByName(discs)


def tile_meshes(m: MapTables, wanted: DataFrame | None = None) -> DataFrame:
    """A row per mesh and tile (see :mod:`mapweave.operators.meshes`): roads, junctions and buildings with their faces,
    areas with their ring."""
    areas = tiles.with_tiles(m.areas, "polygon", m.grid)
    if wanted is not None:
        areas = areas.join(wanted.select("tx", "ty"), ["tx", "ty"], "left_semi")
    return meshes.face_meshes(tile_faces(m, wanted)).unionByName(meshes.area_meshes(areas))
