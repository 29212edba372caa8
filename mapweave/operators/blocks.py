"""Rasters packed in blocks: a row holds a square of cells as one array, with the next column and row as a border.

Looking up a value between cells then is one join on block keys and array access in the row, whatever four cells it
needs.  A block has at most (SIDE + 1) squared values, so a row stays small on any raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

SIDE = 64


def _own(index: Column) -> Column:
    return F.floor(index / SIDE).cast("int")


def _extent(n: int) -> int:
    """Values per side of a block in a raster of n cells per side."""
    return min(SIDE + 1, n)


def pack(cells: DataFrame, keys: list[str], value: str, width: int, height: int, fill: float | None = None) -> DataFrame:
    """keys, bx, bz, ``values``: row-major, missing cells as ``fill``; blocks without a cell are not there.

    A cell on the first column or row of a block also is the border of the block before.  One grouping by block; a group
    has a block's cells at most, so no block can grow."""
    stride = _extent(width)

    def near(index: str) -> Column:
        at = _own(F.col(index))
        return F.when((F.col(index) % SIDE == 0) & (F.col(index) > 0), F.array(at, at - 1)).otherwise(F.array(at))

    inside = F.col("ix").between(0, width - 1) & F.col("iz").between(0, height - 1)
    placed = cells.where(inside).select(*keys, "ix", "iz", F.col(value).cast("double").alias("v"), F.explode(near("ix")).alias("bx")).select("*", F.explode(near("iz")).alias("bz"))
    place = (F.col("iz") - F.col("bz") * SIDE) * stride + F.col("ix") - F.col("bx") * SIDE
    entries = F.sort_array(F.collect_list(F.struct(place.cast("int").alias("place"), "v")))
    grouped = placed.groupBy(*keys, "bx", "bz").agg(entries.alias("e"))
    count = stride * _extent(height)
    none = F.lit(fill).cast("double")
    gap = lambda n: F.array_repeat(none, n)
    following = F.concat(F.slice(F.col("e.place"), F.lit(2), F.size("e")), F.array(F.lit(count)))
    spread = F.flatten(F.zip_with("e", following, lambda e, after: F.concat(F.array(e["v"]), gap(after - e["place"] - 1))))
    dense = F.when(F.size("e") == count, F.col("e.v")).otherwise(F.concat(gap(F.get("e", F.lit(0))["place"]), spread))
    return grouped.select(*keys, "bx", "bz", dense.alias("values"))


def look_up(points: DataFrame, packed: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Add ``c00, c10, c01, c11`` and ``fx, fz`` to points with keys and grid coordinates ``gx, gz``: the four cells around
    each and how far it is from the first.  Indices are clamped into the grid, the fraction is not, but before the first
    cell both corners are that cell.  NULL where no block is.

    The points are the large side: a block that many of them ask for is a skewed key there alone, which adaptive
    execution splits."""
    stride = _extent(width)
    at = lambda g, n: clamp(F.floor(g), F.lit(0), F.lit(n - 1)).cast("int")
    part = lambda g: F.when(F.col(g) < F.lit(0.0), F.lit(0.0)).otherwise(F.col(g) - F.floor(g))
    placed = points.select("*", at("gx", width).alias("__x"), at("gz", height).alias("__z"))
    placed = placed.select("*", _own(F.col("__x")).alias("bx"), _own(F.col("__z")).alias("bz"))
    met = placed.join(packed, [*keys, "bx", "bz"], "left")

    def value(dx: int, dz: int) -> Column:
        x = F.least(F.col("__x") + dx, F.lit(width - 1)) - F.col("bx") * SIDE
        z = F.least(F.col("__z") + dz, F.lit(height - 1)) - F.col("bz") * SIDE
        return F.get("values", z * stride + x).alias(f"c{dx}{dz}")

    return met.select(
        *points.columns, *[value(dx, dz) for dx in (0, 1) for dz in (0, 1)], part("gx").alias("fx"), part("gz").alias("fz")
    )


def between(c00: Column, c10: Column, c01: Column, c11: Column, fx: Column, fz: Column) -> Column:
    """Bilinear mean of the four corners."""
    one = F.lit(1.0)
    return (c00 * (one - fx) + c10 * fx) * (one - fz) + (c01 * (one - fx) + c11 * fx) * fz


def unpack(packed: DataFrame, keys: list[str], value: str, width: int, height: int) -> DataFrame:
    """The cells again, each once: keys, ix, iz and the value; filled ones too."""
    stride = _extent(width)
    rows = packed.select(*keys, "bx", "bz", F.posexplode("values").alias("place", value))
    inner = rows.select("*", (F.col("place") % stride).alias("x"), F.floor(F.col("place") / stride).cast("int").alias("z")).where(F.col("x").between(0, SIDE - 1) & F.col("z").between(0, SIDE - 1))
    return inner.select(*keys, (F.col("bx") * SIDE + F.col("x")).alias("ix"), (F.col("bz") * SIDE + F.col("z")).alias("iz"), value)
