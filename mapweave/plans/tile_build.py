"""Tiles built once and kept: a run builds what is missing or has changed, and nothing else.

A store is a folder with two tables, both cut by blocks of ``span`` x ``span`` tiles (px, py):

- ``meshes``: the mesh rows of the tiles, each with the fingerprint of the tile it was built from;
- ``ledger``: a row per tile: fingerprint of its features, counts, the run that built it, and its state.

A fingerprint is a hash over all features with a vertex in the tile, so a tile is missing when the ledger does not know
its fingerprint.  A run rewrites the blocks of missing tiles by dynamic partition overwrite and leaves every other file
alone.  Before it touches a block it marks the block's tiles as ``building``, and it marks them ``built`` at the end; a run
that dies in between leaves tiles that the next run takes for missing.  Readers meet the ledger on key and fingerprint and
so never see a tile that is half built or of another version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meshes, tiles
from ..session import set_aside
from ..sources.tile_store import block, stored_or_none
from .importing import MapTables, tile_meshes

LEDGER = "tx int, ty int, fingerprint long, features long, meshes long, triangles long, run int, state string, px int, py int"
_TILE = ["tx", "ty"]
_VERSION = ["px", "py", "tx", "ty", "fingerprint"]


@dataclass(frozen=True)
class TileStore:
    """Where the tiles of one map lie.  ``box`` is the box that the first run fixed."""

    spark: SparkSession
    path: str
    span: int = 16

    def ledger(self) -> DataFrame:
        """All tiles the store knows, whatever their state; no rows before the first run."""
        found = stored_or_none(self.spark, f"{self.path}/ledger", LEDGER)
        return self.spark.createDataFrame([], LEDGER) if found is None else found

    def built(self) -> DataFrame:
        return self.ledger().where("state = 'built'")

    def meshes(self, keys: DataFrame | None = None) -> DataFrame:
        """Mesh rows of the built tiles, or of those among ``keys`` (tx, ty)."""
        wanted = self.built().select(*_VERSION)
        if keys is not None:
            wanted = wanted.join(keys.select(*_TILE), _TILE, "left_semi")
        rows = self.spark.read.parquet(f"{self.path}/meshes").join(wanted, _VERSION, "left_semi")
        return rows.select(*meshes.COLUMNS)

    def keep_box(self, box: DataFrame) -> DataFrame:
        """The box of the first run; later maps take it, so that places and tile keys do not move as the map grows."""
        kept = stored_or_none(self.spark, f"{self.path}/box", box.schema)
        if kept is None:
            box.coalesce(1).write.parquet(f"{self.path}/box")
            kept = self.spark.read.schema(box.schema).parquet(f"{self.path}/box")
        return kept


def tile_content(m: MapTables) -> DataFrame:
    """tx, ty, features, fingerprint of every tile that holds anything; combined before the one shuffle."""
    rows = None
    for kind, table, shape in (("road", m.roads, "polyline"), ("building", m.buildings, "footprint"), ("area", m.areas, "polygon")):
        mark = table.select(shape, F.xxhash64(F.lit(kind), *table.columns).alias("mark"))
        part = tiles.with_tiles(mark, shape, m.grid).select("tx", "ty", "mark")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("features"), F.bit_xor("mark").alias("fingerprint"))


def build_tiles(store: TileStore, m: MapTables, wanted: DataFrame | None = None) -> DataFrame:
    """Build the missing tiles of ``m``, or those among ``wanted`` (tx, ty); the ledger rows of the tiles built now.

    Without ``wanted`` tiles that no longer hold anything leave the store as well."""
    spark, span = store.spark, store.span
    before = set_aside(store.built().drop("state"), "ledger")
    now = tile_content(m)
    if wanted is not None:
        now = now.join(wanted.select(*_TILE), _TILE, "left_semi")
    now = set_aside(now.select("*", block(F.col("tx"), span).alias("px"), block(F.col("ty"), span).alias("py")), "content")
    todo = set_aside(now.join(before, _VERSION, "left_anti"), "todo")
    gone = before.limit(0) if wanted is not None else before.join(now, _TILE, "left_anti")
    folders = set_aside(todo.select("px", "py").union(gone.select("px", "py")).distinct(), "folders")
    if folders.isEmpty():
        return store.ledger().limit(0)
    run = (before.agg(F.max("run")).first()[0] or 0) + 1

    touched = before.join(folders, ["px", "py"], "left_semi")
    kept = set_aside(touched.join(todo, _TILE, "left_anti").join(gone, _TILE, "left_anti"), "kept")
    fresh = todo.select("*", F.lit(run).alias("run"))
    left = gone.select("px", "py", "tx", "ty", "fingerprint", F.lit(0).cast("long").alias("features"), F.lit(run).alias("run"))
    rows = kept.select(*left.columns).unionByName(fresh.select(*left.columns))
    unknown = F.lit(None).cast("long")
    _overwrite(rows.unionByName(left).select("*", unknown.alias("meshes"), unknown.alias("triangles"), F.lit("building").alias("state")), f"{store.path}/ledger")

    made = tile_meshes(m, todo).join(todo.select(*_VERSION), _TILE)
    old = stored_or_none(spark, f"{store.path}/meshes", made.select(*meshes.COLUMNS, "fingerprint", "px", "py").schema)
    if old is not None:
        made = made.unionByName(old.join(kept.select(*_VERSION), _VERSION, "left_semi"))
    _overwrite(made, f"{store.path}/meshes")

    here = spark.read.parquet(f"{store.path}/meshes").join(folders, ["px", "py"], "left_semi")
    counts = here.groupBy(*_VERSION).agg(F.count(F.lit(1)).alias("meshes"), F.sum(meshes.triangle_count()).alias("triangles"))
    none = F.lit(0).cast("long")
    done = rows.join(counts, _VERSION, "left").select(*left.columns, F.coalesce("meshes", none).alias("meshes"), F.coalesce("triangles", none).alias("triangles"), F.lit("built").alias("state"))
    gone_rows = left.select("*", none.alias("meshes"), none.alias("triangles"), F.lit("gone").alias("state"))
    _overwrite(set_aside(done.unionByName(gone_rows), "done"), f"{store.path}/ledger")
    return store.built().where(F.col("run") == run)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replace the blocks that the rows belong to, and no others."""
    (
        rows.hint("rebalance", F.col("px"), F.col("py"))
        .sortWithinPartitions("px", "py", "tx", "ty")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("px", "py").parquet(path)
    )
