"""What is in view: tiles by region, meshes by distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import meshes, visibility
from ..sources import tile_store


def visible_tiles(boxes: DataFrame, planes: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """Keys of the tiles that reach into the region."""
    return boxes.where(
        ((boxes.min_x < boxes.max_x) | (boxes.min_z < boxes.max_z)) & visibility.inside_region(planes)
    ).select("tx", "ty")


def near_meshes(seen: DataFrame, eye: tuple[float, float, float], radius: float) -> DataFrame:
    """Mesh rows whose box centre lies within the radius on the ground: one row predicate."""
    return seen.where(meshes.in_reach(eye, radius) & visibility.near_flat(eye, radius))


def visible_meshes(
    spark: SparkSession, path: str, boxes: DataFrame, planes: Sequence[tuple[float, float, float, float]],
    eye: tuple[float, float, float], radius: float, span: int = 16, schema: StructType | None = None,
) -> DataFrame:
    """Meshes in view from a table of mesh rows stored by tile: only the folders of visible tiles are read, and in them
    only row groups whose boxes can be near."""
    return near_meshes(tile_store.read_keys(spark, path, visible_tiles(boxes, planes), span, schema), eye, radius)
