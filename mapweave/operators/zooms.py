"""Tiles at several zooms: counts rolled up by parent, kept in key order, fetched by key intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import zkeys


def tile_counts(bridge: DataFrame) -> DataFrame:
    """kind, tx, ty, copies of the tiles that hold anything."""
    return bridge.groupBy("kind", "tx", "ty").agg(F.count(F.lit(1)).alias("copies"))


def pyramid(counts: DataFrame, zooms: int) -> DataFrame:
    """kind, zoom, key, copies, tiles for zoom 0 up to ``zooms``: ``tiles`` is how many tiles of zoom 0 lie under one.

    All zooms come from the tiles' own counts in one grouping, which is combined before its shuffle."""
    key = zkeys.tile_key(F.col("tx"), F.col("ty"))
    placed = counts.select("kind", "copies", key.alias("z"), F.explode(F.sequence(F.lit(0), F.lit(zooms))).alias("zoom"))
    up = placed.select("kind", "zoom", zkeys.parent_key(F.col("z"), F.col("zoom")).alias("key"), "copies")
    return up.groupBy("kind", "zoom", "key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("tiles"))


def write_pyramid(rows: DataFrame, path: str) -> None:
    """A folder per zoom, rows in key order, so an interval of keys is a run of row groups."""
    rows.repartitionByRange("zoom", "key").sortWithinPartitions("zoom", "key").write.mode("overwrite").partitionBy("zoom").parquet(path)


def read_range(spark: SparkSession, path: str, zoom: int, x: tuple[int, int], y: tuple[int, int], most: int = 32) -> DataFrame:
    """kind, zoom, tx, ty, copies, tiles of one zoom inside a rectangle (inclusive) of that zoom's columns and rows."""
    low_x, low_y = max(x[0], 0), max(y[0], 0)
    ranges = zkeys.intervals(low_x, low_y, x[1], y[1], most)
    found = spark.read.parquet(path).where((F.col("zoom") == zoom) & zkeys.in_intervals(F.col("key"), ranges))
    placed = found.select("kind", F.col("zoom").cast("int").alias("zoom"), zkeys.key_column(F.col("key")).alias("tx"), zkeys.key_row(F.col("key")).alias("ty"), "copies", "tiles")
    return placed.where(F.col("tx").between(low_x, x[1]) & F.col("ty").between(low_y, y[1]))
