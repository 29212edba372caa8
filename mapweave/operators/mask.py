"""The flatten mask: how much each mask cell is levelled under map features.

Weights are 1 inside or on a feature and ease to 0 over the blend distance.  As
the weight only falls with distance, the highest weight over all pieces of all
features is the weight of the nearest one; so pieces are handled one by one and a
single max per cell, combined before the shuffle, brings them together.

For the weights of single features (:func:`paint`, :func:`feature_cells`) a piece is
cut into strips first, one per mask row it reaches.  A strip is one short row of
numbers: a range of cells and what their weights follow from.  The strips are
shuffled, by blocks of the mask, and only then expanded to cells.  So a feature as
large as the map is filled by many tasks, cells are never shuffled before they are
combined, and the work follows the covered cells, not cells times sides.

What each feature covers (:func:`ring_totals`, :func:`line_totals`) needs no cells outside
a task: a feature's sides travel in one row per band of mask rows it reaches, the task
finds the distance to the nearest side for all cells of the band and adds their weights up.
Features of equal sides come one after another, and those distances are found once.

The mask of all features (:func:`flatten`) needs no strips: equal rings and equal
segments are met once, whatever the number of features they are in, whole segments
travel by block, and a task fills one block after the other in an array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WorldConfig
from ..functions import shapes
from ..functions.columns import clamp, norm, record, smoothstep
from . import blocks

MASK = ["ix", "iz"]
BLOCK = 64
# When the weights of single features are added up: mask rows of a band, cells per side of a square looked at together,
# and distances of cells to sides found at once.
BAND = 1024
SQUARE = 128
AT_ONCE = 1 << 15


def mask_size(world: WorldConfig) -> tuple[int, int]:
    """Mask cells in x and z."""
    return tuple(math.ceil((hi - lo) / world.mask_cell) + 1 for lo, hi in zip(world.world_min, world.world_max))


def mask_definition(limits: DataFrame, world: WorldConfig) -> DataFrame:
    """One row: cells per side, cell side and origin, for world limits given as a row."""
    cell = F.lit(world.mask_cell)
    count = lambda lo, hi: (F.ceil((F.col(hi) - F.col(lo)) / cell) + 1).cast("int")
    return limits.select(
        count("world_min_x", "world_max_x").alias("mask_width"),
        count("world_min_z", "world_max_z").alias("mask_height"),
        cell.alias("cell"), F.col("world_min_x").alias("mask_x"), F.col("world_min_z").alias("mask_z"),
    )


def _cell_x(ix: Column, world: WorldConfig) -> Column:
    return F.lit(float(world.world_min[0])) + ix * F.lit(world.mask_cell)


def _cell_z(iz: Column, world: WorldConfig) -> Column:
    return F.lit(float(world.world_min[1])) + iz * F.lit(world.mask_cell)


def _clip(low: Column, high: Column, count: int) -> list[Column]:
    """Columns ``first, last`` of an index range inside the mask."""
    return [
        F.greatest(low, F.lit(0)).cast("int").alias("first"), F.least(high, F.lit(count - 1)).cast("int").alias("last")
    ]


def _below(value: Column, origin: float, world: WorldConfig) -> Column:
    return F.floor((value - F.lit(float(origin))) / F.lit(world.mask_cell))


def _above(value: Column, origin: float, world: WorldConfig) -> Column:
    return F.ceil((value - F.lit(float(origin))) / F.lit(world.mask_cell))


def _rows(pieces: DataFrame, low: Column, high: Column, world: WorldConfig) -> DataFrame:
    """One row per mask row from just below ``low`` to just above ``high``: adds iz and its place z."""
    north = world.world_min[1]
    limits = _clip(_below(low, north, world), _above(high, north, world), mask_size(world)[1])
    return (
        pieces.select("*", *limits).where("first <= last")
        .select(*pieces.columns, F.explode(F.sequence("first", "last")).alias("iz"))
        .select("*", _cell_z(F.col("iz"), world).alias("z"))
    )


# A strip: cells first..last of mask row iz; the place of cell 0 and of the row as seen
# from the segment's start; the segment's step and 1 / its squared length; the number
# of points it is sampled with (0: none, every point of it counts); the full radius.
STRIP = ["osm_id", "iz", "first", "last", "west", "north", "ex", "ey", "inverse", "samples", "radius"]


def _segment_strips(pieces: DataFrame, world: WorldConfig) -> DataFrame:
    """Strips around segments ``osm_id, ax, ay, bx, by, radius, samples``, within radius + blend distance.

    Only the stretch of the segment that comes within reach of a mask row is
    widened, so a long slanted segment does not fill its whole box."""
    ex, ey, reach = F.col("ex"), F.col("ey"), F.col("reach")
    one, zero = F.lit(1.0), F.lit(0.0)
    stepped = pieces.select(
        "*", (F.col("bx") - F.col("ax")).alias("ex"), (F.col("by") - F.col("ay")).alias("ey"),
        (F.greatest(F.col("radius"), zero) + F.lit(float(world.blend_distance))).alias("reach"),
    )
    rows = _rows(stepped, F.least("ay", "by") - reach, F.greatest("ay", "by") + reach, world)
    # Shares of the segment inside the row's z +- reach; a level segment is inside as a whole.
    steep = F.abs(ey) > F.lit(1e-9)
    share = lambda edge: clamp((edge - F.col("ay")) / ey, zero, one)
    rows = rows.select(
        "*", F.when(steep, share(F.col("z") - reach)).otherwise(zero).alias("s1"),
        F.when(steep, share(F.col("z") + reach)).otherwise(one).alias("s2"),
    )
    rows = rows.select("*", (F.col("ax") + F.col("s1") * ex).alias("x1"), (F.col("ax") + F.col("s2") * ex).alias("x2"))
    west = world.world_min[0]
    square = ex * ex + ey * ey
    return rows.select(
        "osm_id", "iz",
        *_clip(
            _below(F.least("x1", "x2") - reach, west, world), _above(F.greatest("x1", "x2") + reach, west, world),
            mask_size(world)[0],
        ),
        (F.lit(float(west)) - F.col("ax")).alias("west"), (F.col("z") - F.col("ay")).alias("north"), "ex", "ey",
        F.when(square > zero, one / square).otherwise(zero).alias("inverse"), "samples", "radius",
    ).where("first <= last")


def _span_strips(spans: DataFrame, world: WorldConfig) -> DataFrame:
    """Strips of the cells at x_from <= x < x_to of each ``osm_id, iz``: full weight, decided by the
    cell's own place and not by the division that finds the range."""
    west = world.world_min[0]
    low, high = F.col("low"), F.col("high")
    at = lambda index: _cell_x(index, world)
    found = spans.select(
        "*", _below(F.col("x_from"), west, world).alias("low"), _above(F.col("x_to"), west, world).alias("high")
    )
    first = low + F.when(at(low) >= F.col("x_from"), 0).when(at(low + 1) >= F.col("x_from"), 1).otherwise(2)
    last = high - F.when(at(high) < F.col("x_to"), 0).when(at(high - 1) < F.col("x_to"), 1).otherwise(2)
    none = F.lit(0.0)
    return found.select(
        "osm_id", "iz", *_clip(first, last, mask_size(world)[0]),
        none.alias("west"), none.alias("north"), none.alias("ex"), none.alias("ey"), none.alias("inverse"),
        none.alias("samples"), F.lit(1e300).alias("radius"),
    ).where("first <= last")


def polygon_strips(polygons: DataFrame, world: WorldConfig) -> DataFrame:
    """Strips of ``osm_id, shape`` rings of at least three points.

    Inside: each side gives one crossing per mask row it spans; between the odd
    and the even crossing of a row all cells are inside, as in ray casting.
    Around: cells within the blend distance of a side."""
    sides = _ring_sides(polygons)
    return _span_strips(_spans(sides, world), world).unionByName(_segment_strips(_long_sides(sides), world))


def _ring_sides(polygons: DataFrame) -> DataFrame:
    return polygons.where(F.size("shape") >= 3).select(
        "osm_id", F.inline(shapes.ring_segments(F.col("shape"))).alias("p", "q")
    ).select(
        "osm_id", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")
    )


def _spans(sides: DataFrame, world: WorldConfig) -> DataFrame:
    """osm_id, iz, x_from, x_to: where a ring's inside is, per mask row."""
    crossing = (
        _rows(sides, F.least("ay", "by"), F.greatest("ay", "by"), world)
        .where((F.col("ay") > F.col("z")) != (F.col("by") > F.col("z")))
        .select(
            "osm_id", "iz",
            # Same formula as ray casting from the side's end point, so that ties fall alike.
            ((F.col("ax") - F.col("bx")) * (F.col("z") - F.col("by")) / (F.col("ay") - F.col("by")) + F.col("bx")).alias("at"),
        )
    )
    # A row of one ring holds as many crossings as the ring has sides there: bounded by the ring's own row.
    return crossing.groupBy("osm_id", "iz").agg(F.sort_array(F.collect_list("at")).alias("at")).select(
        "osm_id", "iz",
        F.inline(F.transform(
            F.sequence(F.lit(0), F.floor(F.size("at") / 2).cast("int") - 1),
            lambda k: record(x_from=F.get("at", k * 2), x_to=F.get("at", k * 2 + 1)),
        )).alias("x_from", "x_to"),
    )


def _long_sides(sides: DataFrame) -> DataFrame:
    """Sides as segments; those shorter than a centimetre are left out of the distance, as their ends belong to other sides."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return sides.where(dx * dx + dy * dy >= F.lit(1e-4)).select("*", F.lit(0.0).alias("radius"), F.lit(0.0).alias("samples"))


def line_strips(lines: DataFrame, world: WorldConfig) -> DataFrame:
    """Strips of ``osm_id, shape, width`` polylines.

    A line is a chain of points half a mask cell apart (at least three per
    segment), each levelling its surroundings.  The nearest such point of a cell
    is the one nearest to its foot on the segment, so they need not be listed."""
    return _segment_strips(_line_segments(lines, world), world)


def _line_segments(lines: DataFrame, world: WorldConfig) -> DataFrame:
    pieces = lines.select(
        "osm_id", (F.col("width") * F.lit(0.5) + F.lit(float(world.flatten_radius))).alias("radius"),
        F.inline(shapes.segments(F.col("shape"))).alias("p", "q"),
    ).select(
        "osm_id", "radius", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")
    )
    length = norm(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    samples = F.greatest(F.floor(length / F.lit(world.mask_cell * 0.5)), F.lit(2)).cast("double")
    return pieces.select("*", samples.alias("samples"))


def paint(strips: DataFrame, world: WorldConfig) -> DataFrame:
    """osm_id, ix, iz, weight of the cells of strips; a cell comes once per strip that reaches it.

    Strips are cut at blocks of the mask and travel by block, so that the pieces of a cell meet before cells are
    combined.  The rebalance hint leaves the number of tasks to the engine, which also splits a block
    that holds too many strips."""
    low = F.floor(F.col("first") / BLOCK).cast("int")
    high = F.floor(F.col("last") / BLOCK).cast("int")
    rest = [c for c in STRIP if c not in ("first", "last")]
    cut = strips.select(*STRIP, F.explode(F.sequence(low, high)).alias("bx")).select(
        *rest, F.greatest("first", F.col("bx") * BLOCK).alias("first"), F.least("last", F.col("bx") * BLOCK + (BLOCK - 1)).alias("last"),
        "bx", F.floor(F.col("iz") / BLOCK).cast("int").alias("bz"),
    )
    return _fill(cut.hint("rebalance", F.col("bx"), F.col("bz")), world)


def feature_cells(strips: DataFrame, world: WorldConfig) -> DataFrame:
    """osm_id, ix, iz, weight of each feature by itself: highest weight per cell, cells of no weight left out.

    The strips of a feature's mask row travel together, so its cells are combined where they are made; only strips
    are shuffled, never cells.  A row of a feature has as many cells as the mask is wide at most."""
    return blend(_fill(strips.select(*STRIP).repartition("osm_id", "iz"), world), "osm_id")


def ring_totals(polygons: DataFrame, world: WorldConfig) -> DataFrame:
    """osm_id, cells, full, weight of ``osm_id, shape`` rings of at least three points, each by itself: how many mask cells
    have any weight, how many full weight, and the sum of the weights.  Rings without such cells are left out."""
    rings = polygons.where(F.size("shape") >= 3)
    return _totals(
        rings.select("osm_id", shapes.ring_segments(F.col("shape")).alias("sides"), F.lit(0.0).alias("radius")), world, True
    )


def line_totals(lines: DataFrame, world: WorldConfig) -> DataFrame:
    """The same of ``osm_id, shape, width`` polylines, sampled as in :func:`line_strips`."""
    radius = F.col("width") * F.lit(0.5) + F.lit(float(world.flatten_radius))
    return _totals(lines.select("osm_id", shapes.segments(F.col("shape")).alias("sides"), radius.alias("radius")), world, False)


def _totals(features: DataFrame, world: WorldConfig, ring: bool) -> DataFrame:
    """Totals of ``osm_id, sides, radius``.

    A feature comes once per band of mask rows, with the sides that may reach it there, so a feature as large as the map is
    many rows.  The number of tasks is given outright, a few for each core: rows are short for the cells they stand for.
    An id has one shape; if it comes more than once, its widest copy covers the others."""
    spark = features.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    north, high = world.world_min[1], mask_size(world)[1]
    reach = F.greatest(F.col("radius"), F.lit(0.0)) + F.lit(float(world.blend_distance))
    south_of = lambda s: F.least(s["p"]["y"], s["q"]["y"])
    north_of = lambda s: F.greatest(s["p"]["y"], s["q"]["y"])
    whole = features.where("radius is not null and not isnan(radius)").select(
        "*", reach.alias("reach"), F.array_min(F.transform("sides", south_of)).alias("low"), F.array_max(F.transform("sides", north_of)).alias("top")
    ).where("low is not null").select("*", *_clip(
        _below(F.col("low") - F.col("reach"), north, world), _above(F.col("top") + F.col("reach"), north, world), high
    )).where("first <= last")
    band = lambda c: F.floor(F.col(c) / BAND).cast("int")
    cut = whole.select("*", (band("first") < band("last")).alias("cut"), F.explode(F.sequence(band("first"), band("last"))).alias("band")).select(
        "osm_id", "sides", "radius", "reach", "cut", "band", F.greatest("first", F.col("band") * BAND).alias("first"),
        F.least("last", F.col("band") * BAND + (BAND - 1)).alias("last"),
    )
    near = lambda s: (north_of(s) + F.col("reach") >= _cell_z(F.col("first") - 1, world)) & (
        south_of(s) - F.col("reach") <= _cell_z(F.col("last") + 1, world)
    )
    sided = cut.select(
        "osm_id", F.when(F.col("cut"), F.filter("sides", near)).otherwise(F.col("sides")).alias("sides"), "radius", "band", "first", "last"
    ).where(F.size("sides") > 0).select("*", F.xxhash64("sides", "band").alias("key"))
    ordered = sided.repartition(tasks, "key").sortWithinPartitions("key", F.desc("radius"))
    found = ordered.mapInArrow(_adder(world, ring), "osm_id long, band int, cells long, full long, weight double")
    totals = ["cells", "full", "weight"]
    once = found.repartition("osm_id").groupBy("osm_id", "band").agg(*[F.max(c).alias(c) for c in totals])
    return once.groupBy("osm_id").agg(*[F.sum(c).alias(c) for c in totals])


def _adder(world: WorldConfig, ring: bool):
    """Rows of sides to the totals of each row; one square of cells is held at a time."""
    cell, falloff = world.mask_cell, float(world.blend_distance)
    west, north = (float(v) for v in world.world_min)
    wide, high = mask_size(world)

    def reached(low: np.ndarray, top: np.ndarray, reach: np.ndarray, origin: float, count: int) -> list[np.ndarray]:
        """Mask indices from below ``low`` to above ``top``, the last one excluded."""
        limits = np.floor((low - reach - origin) / cell), np.ceil((top + reach - origin) / cell) + 1
        return [np.clip(v, 0, count).astype(np.int64) for v in limits]

    def distances(sides: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
        """From each cell to the nearest side, a few sides at a time."""
        away = np.full((len(down), len(across)), np.inf)
        some = max(AT_ONCE // away.size, 1)
        for k in range(0, sides.shape[1], some):
            ax, ay, ex, ey, along, up, samples = (v[:, None, None] for v in sides[:, k : k + some])
            x, z = across - ax, down[:, None] - ay
            t = x * along + z * up
            np.minimum(np.maximum(t, 0.0, out=t), 1.0, out=t)
            if not ring:
                t *= samples
                t += 0.5
                np.floor(t, out=t)
                t /= samples
            dx = t * ex
            np.subtract(x, dx, out=dx)
            dx *= dx
            t *= ey
            np.subtract(z, t, out=t)
            t *= t
            dx += t
            np.minimum(away, dx.min(axis=0), out=away)
        return np.sqrt(away, out=away)

    def crossings(sides: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each crossing of a side and a row of cells."""
        met, row = np.nonzero((sides[1][:, None] > down) != (sides[3][:, None] > down))
        ax, ay, bx, by = sides[:, met]
        return row, (ax - bx) * (down[row] - by) / (ay - by) + bx

    def inside(row: np.ndarray, at: np.ndarray, across: np.ndarray, rows: int) -> np.ndarray:
        """Which cells have an odd number of crossings to the east, as in ray casting."""
        to = row * (len(across) + 1) + np.searchsorted(across, at)
        count = np.bincount(to, minlength=rows * (len(across) + 1)).reshape(rows, -1)
        return np.cumsum(count[:, :0:-1], axis=1)[:, ::-1] % 2 == 1

    def weigh(away: np.ndarray, radius: float) -> tuple[int, int, float]:
        beyond = (away - radius) / falloff
        beyond = np.maximum(beyond[beyond < 1.0], 0.0)
        weight = 1.0 - beyond * beyond * (3.0 - 2.0 * beyond)
        return np.count_nonzero(weight > 0.0), np.count_nonzero(weight == 1.0), weight.sum()

    def measure(sides: np.ndarray, counted: np.ndarray, reach: np.ndarray, limits: tuple[int, int, int, int], wanted: list) -> np.ndarray:
        """cells, full and weight of each of ``wanted`` (first and last mask row, radius) within the limits."""
        left, right, first, last = limits
        totals = np.zeros((len(wanted), 3))
        whole = right - left <= SQUARE and last - first < SQUARE
        for top in range(first, last + 1, SQUARE):
            below = min(top + SQUARE, last + 1)
            down = north + np.arange(top, below) * cell
            crossed = crossings(sides, down) if ring else None
            for start in range(left, right, SQUARE):
                stop = min(start + SQUARE, right)
                across = west + np.arange(start, stop) * cell
                near = counted
                if not whole:
                    near = counted[:, (reach[0] < stop) & (reach[1] > start) & (reach[2] < below) & (reach[3] > top)]
                away = distances(near, across, down)
                if ring:
                    away[inside(*crossed, across, len(down))] = 0.0
                for k, (low, high_, radius) in enumerate(wanted):
                    totals[k] += weigh(away[max(low - top, 0) : max(high_ + 1 - top, 0)], radius)
        return totals

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            listed = batch.column("sides")
            ends = listed.offsets.to_numpy().astype(np.int64) - listed.offsets[0].as_py()
            flat = listed.flatten()
            sides = np.array([flat.field(end).field(axis).to_numpy(zero_copy_only=False) for end in "pq" for axis in "xy"])
            placed = np.isfinite(sides).all(axis=0)
            # A side without a place counts as one of no length, which no row of cells crosses.
            ax, ay, bx, by = sides = np.where(placed, sides, 0.0)
            ex, ey = bx - ax, by - ay
            square = ex * ex + ey * ey
            inverse = 1.0 / np.where(square > 0.0, square, np.inf)
            samples = np.maximum(np.floor(np.sqrt(square) / (cell * 0.5)), 2.0)
            reach = np.repeat(np.maximum(batch.column("radius").to_numpy(), 0.0) + falloff, np.diff(ends))
            left, right = reached(np.minimum(ax, bx), np.maximum(ax, bx), reach, west, wide)
            low, top = reached(np.minimum(ay, by), np.maximum(ay, by), reach, north, high)
            left[~placed], right[~placed] = wide, 0
            lefts, rights = np.minimum.reduceat(left, ends[:-1]).tolist(), np.maximum.reduceat(right, ends[:-1]).tolist()
            # Sides shorter than a centimetre belong to a ring's inside, not to its distance.
            counts = placed & ((square >= 1e-4) | (not ring))
            counted = np.array([ax, ay, ex, ey, ex * inverse, ey * inverse, samples])[:, counts]
            reaches = np.array([left, right, low, top])[:, counts]
            until = np.concatenate([[0], np.cumsum(counts)])[ends].tolist()
            # Rows of equal sides share the distances found for the first of them, which reaches farthest.
            key, first, last, radius = rows = [batch.column(c).to_numpy() for c in ("key", "first", "last", "radius")]
            length = np.repeat(np.diff(ends), np.diff(ends))
            alike = np.logical_and.reduceat((sides == sides[:, np.arange(len(length)) - length]).all(axis=0), ends[:-1])
            alike[1:] &= (key[1:] == key[:-1]) & (np.diff(ends)[1:] == np.diff(ends)[:-1])
            alike[1:] &= (first[1:] >= first[:-1]) & (last[1:] <= last[:-1]) & (radius[1:] <= radius[:-1])
            alike[0] = False
            starts = np.flatnonzero(~alike).tolist() + [batch.num_rows]
            ends, (_, first, last, radius) = ends.tolist(), [v.tolist() for v in rows]
            totals = np.zeros((batch.num_rows, 3))
            for i, j in zip(starts, starts[1:]):
                wanted: dict[tuple, int] = {}
                places = [wanted.setdefault(w, len(wanted)) for w in zip(first[i:j], last[i:j], radius[i:j])]
                own = slice(until[i], until[i + 1])
                limits = lefts[i], rights[i], first[i], last[i]
                totals[i:j] = measure(sides[:, ends[i] : ends[i + 1]], counted[:, own], reaches[:, own], limits, list(wanted))[places]
            some = totals[:, 0] > 0
            kept = pa.array(some)
            yield pa.record_batch({
                "osm_id": batch.column("osm_id").filter(kept), "band": batch.column("band").filter(kept),
                "cells": totals[some, 0].astype(np.int64), "full": totals[some, 1].astype(np.int64), "weight": totals[some, 2],
            })

    return add


def _fill(strips: DataFrame, world: WorldConfig) -> DataFrame:
    """The cells of strips, made where the strips are."""
    cell = F.lit(world.mask_cell)
    cells = strips.select(
        *[c for c in STRIP if c not in ("first", "last")], F.explode(F.sequence("first", "last")).alias("ix")
    )
    cells = cells.select("*", (F.col("west") + F.col("ix") * cell).alias("x"))
    foot = (F.col("x") * F.col("ex") + F.col("north") * F.col("ey")) * F.col("inverse")
    cells = cells.select("*", clamp(foot, F.lit(0.0), F.lit(1.0)).alias("foot"))
    nearest = F.floor(F.col("foot") * F.col("samples") + F.lit(0.5)) / F.col("samples")
    cells = cells.select("*", F.when(F.col("samples") > F.lit(0.0), nearest).otherwise(F.col("foot")).alias("t"))
    away = norm(F.col("x") - F.col("ex") * F.col("t"), F.col("north") - F.col("ey") * F.col("t"))
    falloff = F.lit(float(world.blend_distance))
    beyond = cells.select("osm_id", "ix", "iz", ((away - F.col("radius")) / falloff).alias("beyond")).where("beyond < 1")
    eased = F.lit(1.0) - smoothstep(F.col("beyond"))
    return beyond.select(
        "osm_id", "ix", "iz", F.when(F.col("beyond") <= F.lit(0.0), F.lit(1.0)).otherwise(eased).alias("weight")
    )


def blend(pieces: DataFrame, *keys: str) -> DataFrame:
    """Highest weight per cell, kept within 0..1; cells of no weight are not stored."""
    return pieces.groupBy(*keys, *MASK).agg(
        clamp(F.max("weight"), F.lit(0.0), F.lit(1.0)).alias("weight")
    ).where("weight > 0")


def flatten_mask(roads: DataFrame, buildings: DataFrame, areas: DataFrame, world: WorldConfig) -> DataFrame:
    """ix, iz, weight of all roads, buildings and areas other than water."""
    rings = buildings.select("osm_id", F.col("footprint").alias("shape")).unionByName(
        areas.where(F.col("type") != "Water").select("osm_id", F.col("polygon").alias("shape"))
    )
    lines = roads.select("osm_id", F.col("polyline").alias("shape"), "width")
    return flatten(rings, lines, world)


SEGMENT = ["ax", "ay", "ex", "ey", "inverse", "samples", "radius"]


def flatten(rings: DataFrame, lines: DataFrame | None, world: WorldConfig) -> DataFrame:
    """ix, iz, weight of rings (``osm_id, shape``) and lines (``osm_id, shape, width``) together.

    Pieces travel by block of the mask; the rebalance hint lets the engine split a block that holds too many, whose cells
    then come from several tasks and are combined by the last grouping.  Insides and wide pieces come first in a block, as
    a piece that finds full weight wherever it reaches has nothing to add."""
    placed = pieces(rings, lines, world).hint("rebalance", F.col("qx"), F.col("qz"))
    ordered = placed.sortWithinPartitions("qx", "qz", F.col("iz").isNull(), F.desc("radius"))
    return blend(ordered.mapInArrow(_filler(world), "ix int, iz int, weight double"))


def pieces(rings: DataFrame, lines: DataFrame | None, world: WorldConfig) -> DataFrame:
    """Per block (``qx, qz``) the stretches inside rings (``iz, first, last``) and the segments that may reach it.

    Copies of a ring or of a segment level the same cells, so each is kept once; of equal segments the one of the largest
    radius reaches farthest everywhere."""
    once = rings.groupBy("shape").agg(F.min("osm_id").alias("osm_id"))
    sides = _ring_sides(once)
    columns = ["ax", "ay", "bx", "by", "samples", "radius"]
    segments = _long_sides(sides).select(*columns)
    if lines is not None:
        segments = segments.unionByName(_line_segments(lines, world).select(*columns))
    segments = segments.groupBy("ax", "ay", "bx", "by", "samples").agg(F.max("radius").alias("radius"))
    inside = _span_blocks(_span_strips(_spans(sides, world), world))
    found = inside.unionByName(_segment_blocks(segments, world), allowMissingColumns=True)
    return found.select("qx", "qz", "iz", "first", "last", *SEGMENT)


def _span_blocks(strips: DataFrame) -> DataFrame:
    low, high = (F.floor(F.col(c) / BLOCK).cast("int") for c in ("first", "last"))
    cut = strips.select("iz", "first", "last", F.explode(F.sequence(low, high)).alias("qx"), F.floor(F.col("iz") / BLOCK).cast("int").alias("qz"))
    return cut.select(
        "qx", "qz", "iz", F.greatest("first", F.col("qx") * BLOCK).alias("first"), F.least("last", F.col("qx") * BLOCK + (BLOCK - 1)).alias("last")
    )


def _segment_blocks(segments: DataFrame, world: WorldConfig) -> DataFrame:
    """A row per block (``qx, qz``) that a segment may reach: only the stretch of it near a row of blocks is widened, as in
    :func:`_segment_strips`."""
    ex, ey, reach = F.col("ex"), F.col("ey"), F.col("reach")
    one, zero = F.lit(1.0), F.lit(0.0)
    (west, north), (wide, high) = world.world_min, mask_size(world)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    stepped = segments.where("radius is not null").select(
        "*", (F.col("bx") - F.col("ax")).alias("ex"), (F.col("by") - F.col("ay")).alias("ey"),
        (F.greatest(F.col("radius"), zero) + F.lit(float(world.blend_distance))).alias("reach"),
    )
    rows = stepped.select("*", *_clip(
        _below(F.least("ay", "by") - reach, north, world), _above(F.greatest("ay", "by") + reach, north, world), high
    )).where("first <= last").select(*stepped.columns, F.explode(F.sequence(block("first"), block("last"))).alias("qz"))
    steep = F.abs(ey) > F.lit(1e-9)
    share = lambda edge: clamp((edge - F.col("ay")) / ey, zero, one)
    rows = rows.select(
        "*", F.when(steep, share(_cell_z(F.col("qz") * BLOCK, world) - reach)).otherwise(zero).alias("s1"),
        F.when(steep, share(_cell_z(F.col("qz") * BLOCK + (BLOCK - 1), world) + reach)).otherwise(one).alias("s2"),
    )
    rows = rows.select("*", (F.col("ax") + F.col("s1") * ex).alias("x1"), (F.col("ax") + F.col("s2") * ex).alias("x2"))
    square = ex * ex + ey * ey
    return rows.select("*", *_clip(
        _below(F.least("x1", "x2") - reach, west, world), _above(F.greatest("x1", "x2") + reach, west, world), wide
    )).where("first <= last").select(
        F.explode(F.sequence(block("first"), block("last"))).alias("qx"), "qz", "ax", "ay", "ex", "ey",
        F.when(square > zero, one / square).otherwise(zero).alias("inverse"), "samples", "radius",
    )


def _filler(world: WorldConfig):
    """Pieces in the order of their blocks to the cells of each block; one block is held at a time."""
    cell, falloff = world.mask_cell, float(world.blend_distance)
    west, north = (float(v) for v in world.world_min)
    wide, high = mask_size(world)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, across, down = None, None, None, None

        def cells() -> pa.RecordBatch:
            z, x = np.nonzero(weight > 0)
            return pa.record_batch({"ix": (x + at[0] * BLOCK).astype(np.int32), "iz": (z + at[1] * BLOCK).astype(np.int32), "weight": weight[z, x]})

        def reached(low: float, high_: float, origin: float, first: int, count: int) -> slice:
            """Indices in the block of the cells from below ``low`` to above ``high_``."""
            return slice(max(math.floor((low - origin) / cell) - first, 0), max(min(math.ceil((high_ - origin) / cell) - first + 1, count), 0))

        for batch in batches:
            for qx, qz, iz, first, last, ax, ay, ex, ey, inverse, samples, radius in zip(*(c.to_pylist() for c in batch.columns)):
                if (qx, qz) != at:
                    if at is not None:
                        yield cells()
                    at = qx, qz
                    across = np.arange(qx * BLOCK, min(qx * BLOCK + BLOCK, wide)) * cell
                    down = north + np.arange(qz * BLOCK, min(qz * BLOCK + BLOCK, high))[:, None] * cell
                    weight = np.zeros((len(down), len(across)))
                if iz is not None:
                    weight[iz - qz * BLOCK, first - qx * BLOCK : last - qx * BLOCK + 1] = 1.0
                    continue
                reach = max(radius, 0.0) + falloff
                rows = reached(min(ay, ay + ey) - reach, max(ay, ay + ey) + reach, north, qz * BLOCK, len(down))
                columns = reached(min(ax, ax + ex) - reach, max(ax, ax + ex) + reach, west, qx * BLOCK, len(across))
                part = weight[rows, columns]
                if part.size == 0 or part.min() == 1.0:
                    continue
                x, z = (west - ax) + across[columns], down[rows] - ay
                t = np.clip((x * ex + z * ey) * inverse, 0.0, 1.0)
                if samples > 0:
                    t = np.floor(t * samples + 0.5) / samples
                dx, dz = x - ex * t, z - ey * t
                beyond = np.clip((np.sqrt(dx * dx + dz * dz) - radius) / falloff, 0.0, 1.0)
                np.maximum(part, 1.0 - beyond * beyond * (3.0 - 2.0 * beyond), out=part)
        if at is not None:
            yield cells()

    return fill


def pack_mask(mask: DataFrame, world: WorldConfig) -> DataFrame:
    """The mask in blocks (see :mod:`mapweave.operators.blocks`): pack once what is sampled more than once."""
    return blocks.pack(mask, [], "weight", *mask_size(world), fill=0.0)


def sample_mask(points: DataFrame, mask: DataFrame, world: WorldConfig) -> DataFrame:
    """Add ``weight`` at any ``x, z`` by bilinear lookup in a mask of cells or blocks; a missing mask cell counts as 0."""
    packed = mask if "values" in mask.columns else pack_mask(mask, world)
    gx = (F.col("x") - F.lit(float(world.world_min[0]))) / F.lit(world.mask_cell)
    gz = (F.col("z") - F.lit(float(world.world_min[1]))) / F.lit(world.mask_cell)
    met = blocks.look_up(points.select("*", gx.alias("gx"), gz.alias("gz")), packed, [], *mask_size(world))
    weight = blocks.between(*[F.col(c) for c in ("c00", "c10", "c01", "c11", "fx", "fz")])
    return met.select(*points.columns, F.coalesce(weight, F.lit(0.0)).alias("weight"))


def apply_mask(cells: DataFrame, mask: DataFrame, world: WorldConfig) -> DataFrame:
    """Level the cells towards the base height by the mask weight at their place."""
    w = F.col("weight")
    h = F.when(w > F.lit(0.0), F.col("h") * (F.lit(1.0) - w) + F.lit(world.base_height) * w).otherwise(F.col("h"))
    return sample_mask(cells, mask, world).withColumn("h", h).drop("weight")
