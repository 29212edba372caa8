"""Polylines as rows: points and segments with the directions of the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import norm


def _part(shape: str, first: int, shorter: int) -> Column:
    """The points from number ``first`` on, ``shorter`` fewer than all."""
    return F.slice(shape, F.lit(first), F.greatest(F.size(shape) - shorter, F.lit(0)))


def _units(rows: DataFrame, **steps: tuple[str, str]) -> DataFrame:
    """Add for each name the unit vector ``<name>x, <name>y`` from one point column to another.

    (0, 0) for equal points and NULL where a point is missing."""
    raw = rows.select(
        "*", *[(F.col(f"{b}.{k}") - F.col(f"{a}.{k}")).alias(f"{n}d{k}") for n, (a, b) in steps.items() for k in "xy"]
    ).select("*", *[norm(F.col(f"{n}dx"), F.col(f"{n}dy")).alias(f"{n}len") for n in steps])
    return raw.select(
        "*",
        *[
            F.when(F.col(f"{n}len") > F.lit(0.0), F.col(f"{n}d{k}") / F.col(f"{n}len"))
            .when(F.col(f"{n}len") == F.lit(0.0), F.lit(0.0)).alias(f"{n}{k}")
            for n in steps for k in "xy"
        ],
    )


def _direction(rows: DataFrame, name: str, before: str, after: str) -> DataFrame:
    """Add ``<name>tx, <name>ty``: the unit direction at a point between two steps.

    At an end it is the one step, inside the sum of both units; a direction
    shorter than 1e-4 becomes (1, 0)."""
    total = lambda k: (
        F.when(F.col(f"{before}len").isNull(), F.col(f"{after}d{k}"))
        .when(F.col(f"{after}len").isNull(), F.col(f"{before}d{k}"))
        .otherwise(F.col(f"{before}{k}") + F.col(f"{after}{k}"))
    )
    summed = rows.select("*", total("x").alias("sx"), total("y").alias("sy"))
    summed = summed.select("*", norm(F.col("sx"), F.col("sy")).alias("slen"))
    short = F.col("slen") < F.lit(1e-4)
    return summed.select(
        "*",
        F.when(short, F.lit(1.0)).otherwise(F.col("sx") / F.col("slen")).alias(f"{name}tx"),
        F.when(short, F.lit(0.0)).otherwise(F.col("sy") / F.col("slen")).alias(f"{name}ty"),
    ).drop("sx", "sy", "slen")


def point_directions(features: DataFrame, shape: str) -> DataFrame:
    """One row per point of every polyline of two or more: other columns, i, px, py, ptx, pty."""
    kept = [c for c in features.columns if c != shape]
    none = F.array(F.lit(None).cast("struct<x:double,y:double>"))
    rows = (
        features.where(F.size(shape) >= 2)
        .select(
            *kept, F.concat(none, _part(shape, 1, 1)).alias("a"), F.col(shape).alias("p"),
            F.concat(_part(shape, 2, 1), none).alias("b"),
        )
        .select(*kept, F.posexplode(F.arrays_zip("a", "p", "b")).alias("i", "at"))
        .select(*kept, "i", "at.*")
    )
    found = _direction(_units(rows, u=("a", "p"), v=("p", "b")), "p", "u", "v")
    return found.select(*kept, "i", F.col("p.x").alias("px"), F.col("p.y").alias("py"), "ptx", "pty")


def segment_directions(features: DataFrame, shape: str) -> DataFrame:
    """One row per segment p-q: other columns, i, and for both ends place and direction.

    A segment needs its neighbours only, so each row takes the four points around
    it and everything after the explode is plain generated code."""
    kept = [c for c in features.columns if c != shape]
    none = F.array(F.lit(None).cast("struct<x:double,y:double>"))
    rows = (
        features.where(F.size(shape) >= 2)
        .select(
            *kept, F.concat(none, _part(shape, 1, 2)).alias("a"), _part(shape, 1, 1).alias("p"),
            _part(shape, 2, 1).alias("q"), F.concat(_part(shape, 3, 2), none).alias("b"),
        )
        .select(*kept, F.posexplode(F.arrays_zip("a", "p", "q", "b")).alias("i", "at"))
        .select(*kept, "i", "at.*")
    )
    found = _units(rows, u=("a", "p"), v=("p", "q"), w=("q", "b"))
    found = _direction(_direction(found, "p", "u", "v"), "q", "v", "w")
    return found.select(
        *kept, "i",
        *[F.col(f"{k}.{axis}").alias(f"{k}{axis}") for k in "pq" for axis in "xy"], "ptx", "pty", "qtx", "qty",
    )
