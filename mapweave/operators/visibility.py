"""Which tiles and features are in view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside_region(planes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Box test against half-spaces a*x + b*y + c*z + d >= 0.

    A box stays when its farthest corner along every plane is not outside.
    The planes are settings, so this is one filter expression, not a join."""
    keep = F.lit(True)
    for a, b, c, d in planes:
        far = sum(
            (F.lit(float(k)) * F.col(f"{'max' if k >= 0 else 'min'}_{axis}") for k, axis in ((a, "x"), (b, "y"), (c, "z"))),
            F.lit(0.0),
        )
        keep = keep & (far + F.lit(float(d)) >= F.lit(0.0))
    return keep


def _mid(axis: str) -> Column:
    return (F.col(f"min_{axis}") + F.col(f"max_{axis}")) * F.lit(0.5)


def near_flat(eye: tuple[float, float, float], radius: float) -> Column:
    """Box centre within ``radius`` on the ground; a box without extent data always passes."""
    dx, dz = _mid("x") - F.lit(float(eye[0])), _mid("z") - F.lit(float(eye[2]))
    return F.coalesce(dx * dx + dz * dz <= F.lit(float(radius) ** 2), F.lit(True))


def near(eye: tuple[float, float, float], radius: float) -> Column:
    """Box centre within ``radius`` in space."""
    away = [_mid(axis) - F.lit(float(at)) for axis, at in zip("xyz", eye)]
    return sum((d * d for d in away), F.lit(0.0)) <= F.lit(float(radius) ** 2)


def layers(*, areas: bool = True, roads: bool = True, buildings: bool = True, terrain: bool = True, water: bool = True) -> Column:
    """Rows whose ``kind`` is switched on."""
    chosen = {"area": areas, "road": roads, "building": buildings, "terrain": terrain, "water": water}
    return F.col("kind").isin([kind for kind, on in chosen.items() if on])


def visible_count(boxes: DataFrame, planes: Sequence[tuple[float, float, float, float]] | None) -> DataFrame:
    """One row: tiles in view and tiles in all; everything is in view without a region."""
    seen = F.lit(True) if planes is None else (
        ((F.col("min_x") < F.col("max_x")) | (F.col("min_z") < F.col("max_z"))) & inside_region(planes)
    )
    return boxes.agg(
        F.count_if(seen).alias("visible_tiles"), F.count(F.lit(1)).alias("tiles")
    )
