"""Meshes as rows: what is drawn and tested as one, with its box and its faces in the row.

A mesh row has tx, ty, kind, mesh, osm_id, the box min_x .. max_z, ``ring`` with ``color`` (areas), and ``faces`` (all
others).  The box lies in plain columns, so distance and region are predicates on a scan that Parquet statistics prune;
nothing is grouped or joined to see a part of the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.columns import record
from .faces import CORNERS

BOX = [f"{side}_{axis}" for axis in "xyz" for side in ("min", "max")]
FACE_FIELDS = ["part", "face", *CORNERS, "nx", "ny", "nz", "color"]
COLUMNS = ["tx", "ty", "kind", "mesh", "osm_id", *BOX, "ring", "color", "faces"]


def face_meshes(faces: DataFrame) -> DataFrame:
    """Mesh rows of face rows with tx, ty, kind, mesh, osm_id.

    One grouping when the table is made, by tile and mesh; a group is one feature's faces, bounded by its source record."""
    limits = []
    for axis in "xyz":
        corners = [F.col(f"{axis}{i}") for i in range(4)]
        limits += [F.min(F.least(*corners)).alias(f"min_{axis}"), F.max(F.greatest(*corners)).alias(f"max_{axis}")]
    made = faces.groupBy("tx", "ty", "kind", "mesh", "osm_id").agg(*limits, F.collect_list(F.struct(*FACE_FIELDS)).alias("faces"))
    return made.select(
        "tx", "ty", "kind", "mesh", "osm_id", *BOX, F.lit(None).cast("array<struct<x:double,y:double,z:double>>").alias("ring"),
        F.lit(None).cast("struct<r:double,g:double,b:double,a:double>").alias("color"), "faces",
    )


def area_meshes(areas: DataFrame) -> DataFrame:
    """Mesh rows of area rows with tx, ty: the ring lifted to its class's height, in the class's colour.  Rings are not cut
    into triangles; ``faces`` is null."""
    lift = classify.area_lift(F.col("type"))
    ring = F.transform("polygon", lambda p: record(x=p["x"], y=lift, z=-p["y"]))
    rows = areas.select("tx", "ty", "osm_id", ring.alias("ring"), classify.area_colour(F.col("type")).alias("color"))
    end = {"min": F.array_min, "max": F.array_max}
    limits = {f"{side}_{axis}": end[side](F.col(f"ring.{axis}")) for axis in "xyz" for side in end}
    return rows.select(
        "tx", "ty", F.lit("area").alias("kind"), F.concat(F.lit("area "), F.col("osm_id").cast("string")).alias("mesh"), "osm_id",
        *[limits[c].alias(c) for c in BOX], "ring", "color", _no_faces().alias("faces"),
    )


def _no_faces() -> Column:
    kinds = {"part": "string", "face": "int", "color": "struct<r:double,g:double,b:double,a:double>"}
    return F.lit(None).cast("array<struct<" + ",".join(f"{f}:{kinds.get(f, 'double')}" for f in FACE_FIELDS) + ">>")


def faces_of(meshes: DataFrame) -> DataFrame:
    """Face rows again: tx, ty, kind, mesh, osm_id and face columns."""
    return meshes.select("tx", "ty", "kind", "mesh", "osm_id", F.inline("faces"))


def triangle_count() -> Column:
    """Triangles of a mesh row; a quad is two."""
    return F.coalesce(F.aggregate("faces", F.lit(0), lambda n, f: n + F.when(f["x3"].isNull(), 1).otherwise(2)), F.lit(0)).cast("long")


def in_reach(eye: tuple[float, float, float], radius: float) -> Column:
    """Boxes that the ground around ``eye`` can touch.  Follows from the centre being within the radius, and unlike that it
    is a filter that row groups are skipped by; boxes without extent pass."""
    keep = F.lit(True)
    for axis, at in (("x", float(eye[0])), ("z", float(eye[2]))):
        low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
        keep = keep & ((low <= F.lit(at + radius)) | low.isNull()) & ((high >= F.lit(at - radius)) | high.isNull())
    return keep
