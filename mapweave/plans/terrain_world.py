"""A chunked terrain world levelled under map features."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import WorldConfig
from ..operators import mask, raster, tiles


def fitted_world(boxes: DataFrame, world: WorldConfig) -> WorldConfig:
    """The settings with world limits around all tile boxes (one aggregated row is read).

    Limits are kept in whole millimetres: chunk counts depend on them by a ceiling,
    and should not hang on the last bit of a cosine."""
    row = tiles.fit_world(boxes, world.chunk_size).first()
    if row is None:
        return world
    mm = lambda v: math.floor(v * 1000.0 + 0.5) / 1000.0
    return replace(
        world, world_min=(mm(row.world_min_x), mm(row.world_min_z)), world_max=(mm(row.world_max_x), mm(row.world_max_z))
    )


def world_cells(spark: SparkSession, world: WorldConfig, chunks: DataFrame | None = None) -> DataFrame:
    """Cells with heights of all chunks of the world, or of the given ones, before levelling."""
    keys = raster.chunks_of_world(spark, world) if chunks is None else chunks
    cells = raster.with_elevation(raster.chunk_grid(keys, world), world.terrain)
    return raster.flatten_center(cells, world.terrain)


def levelled_cells(
    spark: SparkSession, world: WorldConfig, roads: DataFrame, buildings: DataFrame, areas: DataFrame,
    chunks: DataFrame | None = None,
) -> DataFrame:
    """World cells levelled under the features; without features nothing is changed."""
    flat = mask.flatten_mask(roads, buildings, areas, world)
    return mask.apply_mask(world_cells(spark, world, chunks), flat, world)


def chunk_steps(world: WorldConfig) -> tuple[float, float]:
    """Distance between neighbouring cells of a chunk."""
    t = world.terrain
    return world.chunk_size / (t.resolution_x - 1), world.chunk_size / (t.resolution_z - 1)
