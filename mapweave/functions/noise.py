"""Seeded gradient noise as columns.

Every octave is a chain of narrow projections; the optimizer keeps a computed
column that is used more than once, so the expressions do not multiply, and no
shuffle, explode or Python worker is involved.

Each octave binds its position with an array function on purpose: such a
function ends the generated stage, so each octave is compiled as a method of its
own.  All octaves in one method pass the size that the JVM turns into machine
code, and run many times slower.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import record

_SKEW = 0.5 * (3.0**0.5 - 1.0)
_UNSKEW = (3.0 - 3.0**0.5) / 6.0
_SCALE = 70.0


@lru_cache(maxsize=32)
def permutation(seed: int) -> tuple[int, ...]:
    """The numbers 0..255 shuffled by a 32-bit xorshift generator; seed 0 acts as 1."""
    order = list(range(256))
    state = (seed & 0xFFFFFFFF) or 1
    for last in range(255, 0, -1):
        for left, by in ((True, 13), (False, 17), (True, 5)):
            state ^= (state << by) & 0xFFFFFFFF if left else state >> by
        pick = state % (last + 1)
        order[last], order[pick] = order[pick], order[last]
    return tuple(order)


def _table(values) -> str:
    """A constant integer array, folded once by the optimizer."""
    return "cast(split('{}', ',') as array<int>)".format(",".join(str(v) for v in values))


def _bind(value: Column) -> Column:
    return F.get(F.transform(F.array(value), lambda v: v), F.lit(0))


def with_noise(df: DataFrame, name: str, x: Column, y: Column, seed: int) -> DataFrame:
    """Add the column ``name``: noise in about -1..1 at (x, y).

    The plane is cut into triangles.  Each of the three corners of a triangle
    has one of the four diagonal directions, picked by the low bits of
    (permutation value mod 12)."""
    perm = permutation(seed)
    numbers, directions = _table(perm), _table([p % 12 for p in perm])
    kept = df.columns
    at, skew, unskew = f"__{name}", f"{_SKEW!r}D", f"{_UNSKEW!r}D"

    def corner(k: int) -> str:
        x_part = f"if({at}_g{k} & 1 = 0, {at}_x{k}, -{at}_x{k})"
        y_part = f"if({at}_g{k} & 2 = 0, {at}_y{k}, -{at}_y{k})"
        return f"{at}_f{k} * {at}_f{k} * {at}_f{k} * {at}_f{k} * ({x_part} + {y_part})"

    number = lambda index: f"get({numbers}, {index} & 255)"
    direction = lambda index: f"get({directions}, ({index}) & 255)"
    cell = [f"floor({at}.{v} + ({at}.x + {at}.y) * {skew}) as {at}_{n}" for v, n in (("x", "i"), ("y", "j"))]
    inside = [
        f"{at}.{v} - ({at}_{n} - cast({at}_i + {at}_j as double) * {unskew}) as {at}_{v}0" for v, n in (("x", "i"), ("y", "j"))
    ] + [f"cast({at}_{n} & 255 as int) as {at}_{n}{n}" for n in "ij"]
    half = [f"if({at}_x0 > {at}_y0, 1, 0) as {at}_i1", f"if({at}_x0 > {at}_y0, 0, 1) as {at}_j1"]
    corners = [
        f"{direction(f'{at}_ii + {number(f"{at}_jj")}')} as {at}_g0",
        f"{direction(f'{at}_ii + {at}_i1 + {number(f"({at}_jj + {at}_j1)")}')} as {at}_g1",
        f"{direction(f'{at}_ii + 1 + {number(f"({at}_jj + 1)")}')} as {at}_g2",
        f"{at}_x0 - {at}_i1 + {unskew} as {at}_x1", f"{at}_y0 - {at}_j1 + {unskew} as {at}_y1",
        f"{at}_x0 - 1D + 2D * {unskew} as {at}_x2", f"{at}_y0 - 1D + 2D * {unskew} as {at}_y2",
    ]
    falloff = [
        f"greatest(5e-1 - {at}_x{k} * {at}_x{k} - {at}_y{k} * {at}_y{k}, 0D) as {at}_f{k}" for k in range(3)
    ]
    df = df.select("*", _bind(record(x=x, y=y)).alias(at))
    for stage in (cell, inside, half, corners, falloff):
        df = df.selectExpr("*", *stage)
    total = " + ".join(corner(k) for k in range(3))
    return df.selectExpr(*[f"`{c}`" for c in kept], f"{_SCALE}D * ({total}) as `{name}`")


def _octaves(octaves: int) -> int:
    return min(max(int(octaves), 1), 16)


def with_fractal(
    df: DataFrame, name: str, x: Column, y: Column, seed: int,
    octaves: int = 6, lacunarity: float = 2.0, persistence: float = 0.5,
) -> DataFrame:
    """Add a sum of octaves, each finer and weaker, divided by the sum of weights."""
    kept, weights = df.columns, 0.0
    total, value = f"__{name}_total", f"__{name}_value"
    df = df.withColumn(total, F.lit(0.0))
    amplitude, frequency = 1.0, 1.0
    for _ in range(_octaves(octaves)):
        df = with_noise(df, value, x * F.lit(frequency), y * F.lit(frequency), seed)
        df = df.select(*kept, (F.col(total) + F.lit(amplitude) * F.col(value)).alias(total))
        weights += amplitude
        amplitude, frequency = amplitude * persistence, frequency * lacunarity
    return df.select(*kept, (F.col(total) / F.lit(weights)).alias(name))


def with_ridges(
    df: DataFrame, name: str, x: Column, y: Column, seed: int,
    octaves: int = 6, lacunarity: float = 2.0, gain: float = 0.5,
) -> DataFrame:
    """Add ridged octaves: (1 - |noise|) squared, weighted by the octave before it."""
    kept = df.columns
    total, value, before = f"__{name}_total", f"__{name}_value", f"__{name}_before"
    df = df.withColumns({total: F.lit(0.0), before: F.lit(1.0)})
    amplitude, frequency = 0.5, 1.0
    for _ in range(_octaves(octaves)):
        df = with_noise(df, value, x * F.lit(frequency), y * F.lit(frequency), seed)
        edge = F.lit(1.0) - F.abs(F.col(value))
        df = df.withColumn(value, edge * edge).select(
            *kept,
            (F.col(total) + F.col(value) * F.lit(amplitude) * F.col(before)).alias(total),
            F.col(value).alias(before),
        )
        amplitude, frequency = amplitude * gain, frequency * lacunarity
    return df.select(*kept, F.col(total).alias(name))
