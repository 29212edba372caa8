"""Square tiles over a map: grid, keys, boxes and the feature-to-tile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TileConfig
from ..functions.columns import clamp, one_row, record
from .extents import box_measures


def tile_grid(box: DataFrame, config: TileConfig = TileConfig()) -> DataFrame:
    """One row: tiles per side (at least one), lower corner in local metres, tile size."""
    size = F.lit(float(config.tile_size))
    count = lambda extent: F.greatest(F.ceil(extent / size), F.lit(1)).cast("int")
    return box_measures(box).where("is_valid").select(
        count(F.col("width_m")).alias("grid_width"),
        count(F.col("height_m")).alias("grid_height"),
        (-F.col("width_m") / F.lit(2.0)).alias("grid_x"),
        (-F.col("height_m") / F.lit(2.0)).alias("grid_y"),
        size.alias("tile_size"),
    )


def _key(value: Column, low: Column, size: Column, count: Column) -> Column:
    return clamp(F.floor((value - low) / size), F.lit(0), count - 1).cast("int")


def tile_x(x: Column, grid: Column) -> Column:
    """Tile column of a local x; values outside the grid go to its edge."""
    return _key(x, grid["grid_x"], grid["tile_size"], grid["grid_width"])


def tile_y(y: Column, grid: Column) -> Column:
    """Tile row of a local y; values outside the grid go to its edge."""
    return _key(y, grid["grid_y"], grid["tile_size"], grid["grid_height"])


def point_tiles(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Add ``tx, ty`` to rows with local ``x, y``."""
    g = one_row(grid)
    return points.select("*", tile_x(F.col("x"), g).alias("tx"), tile_y(F.col("y"), g).alias("ty"))


def with_tiles(features: DataFrame, shape: str, grid: DataFrame) -> DataFrame:
    """One copy of each feature row per tile it has a vertex in, with ``tx, ty``.

    A feature's tiles are made distinct inside its row, so no shuffle is needed."""
    g = F.col("__grid")
    keys = F.array_distinct(
        F.transform(shape, lambda p: record(tx=tile_x(p["x"], g), ty=tile_y(p["y"], g)))
    )
    return (
        features.select("*", one_row(grid).alias("__grid"))
        .select(*features.columns, F.inline(keys).alias("tx", "ty"))
    )


def feature_tiles(features: DataFrame, grid: DataFrame) -> DataFrame:
    """kind, osm_id, tx, ty: every tile that holds a vertex of the feature, once.

    A segment that crosses a tile without a vertex in it does not count."""
    return with_tiles(features, "shape", grid).select("kind", "osm_id", "tx", "ty")


def existing_tiles(bridge: DataFrame) -> DataFrame:
    """The tiles that hold anything."""
    return bridge.select("tx", "ty").distinct()


def tile_boxes(tiles: DataFrame, grid: DataFrame, config: TileConfig = TileConfig()) -> DataFrame:
    """3-D box of each tile: x east, y up, z south (the negated local y)."""
    g = one_row(grid)
    west = g["grid_x"] + F.col("tx") * g["tile_size"]
    south = g["grid_y"] + F.col("ty") * g["tile_size"]
    return tiles.select(
        "*",
        west.alias("min_x"), F.lit(0.0).alias("min_y"), (-(south + g["tile_size"])).alias("min_z"),
        (west + g["tile_size"]).alias("max_x"), F.lit(float(config.tile_height)).alias("max_y"),
        (-south).alias("max_z"),
    )


def has_valid_box() -> Column:
    """A tile box counts as valid when it has extent in x or in z."""
    return (F.col("min_x") < F.col("max_x")) | (F.col("min_z") < F.col("max_z"))


def tiles_in_range(
    tiles: DataFrame, grid: DataFrame, low: tuple[float, float], high: tuple[float, float]
) -> DataFrame:
    """Existing tiles inside the key rectangle of two local corners, row by row."""
    g = one_row(grid)
    at = lambda p: (tile_x(F.lit(float(p[0])), g), tile_y(F.lit(float(p[1])), g))
    (x0, y0), (x1, y1) = at(low), at(high)
    return tiles.where(F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1)).orderBy("ty", "tx")


def features_of_tile(features: DataFrame, grid: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Feature rows (with ``shape``) of the requested tiles, or of all that hold anything; a feature comes once per tile.

    The tiles of a feature are found in its own row, so features are not joined with their tiles."""
    placed = with_tiles(features, "shape", grid)
    return placed if tiles is None else placed.join(tiles.select("tx", "ty"), ["tx", "ty"], "left_semi")


def tile_totals(bridge: DataFrame) -> DataFrame:
    """Feature copies per kind over all tiles."""
    return bridge.groupBy("kind").agg(F.count(F.lit(1)).alias("copies"))


def missing_tiles(wanted: DataFrame, built: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Wanted tiles that are neither built nor being built: the work of an incremental run."""
    left = wanted.join(built.select("tx", "ty"), ["tx", "ty"], "left_anti")
    if pending is not None:
        left = left.join(pending.select("tx", "ty"), ["tx", "ty"], "left_anti")
    return left


def first_tile_center(boxes: DataFrame) -> DataFrame:
    """Centre of the first tile, by key, that has a valid box."""
    mid = lambda a, b: (F.col(a) + F.col(b)) * F.lit(0.5)
    return boxes.where(has_valid_box()).orderBy("tx", "ty").limit(1).select(
        "tx", "ty", mid("min_x", "max_x").alias("x"), mid("min_y", "max_y").alias("y"),
        mid("min_z", "max_z").alias("z"),
    )


def fit_world(boxes: DataFrame, padding: float) -> DataFrame:
    """World limits around all valid tile boxes, widened by ``padding``; z is turned back to local y."""
    pad = F.lit(float(padding))
    return boxes.where(has_valid_box()).agg(
        (F.min("min_x") - pad).alias("world_min_x"),
        (-F.max("max_z") - pad).alias("world_min_z"),
        (F.max("max_x") + pad).alias("world_max_x"),
        (-F.min("min_z") + pad).alias("world_max_z"),
    ).where(F.col("world_min_x").isNotNull())
