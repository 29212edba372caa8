"""Points near points, and the greedy grouping of road ends into junctions.

Cells of side ``distance * 0.7`` have a diagonal below ``distance``: all points of
a cell are near each other.  So a cell holds at most one seed of the greedy
grouping, and joining points to seeds over the 5 x 5 surrounding cells compares
each point with at most 25 others, however many points share a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import record, rgba
from ..functions.fixed_values import (
    JUNCTION_COLOUR, JUNCTION_DISTANCE, JUNCTION_LIFT, JUNCTION_RADIUS_PER_WIDTH, JUNCTION_SEGMENTS,
)
from ..session import set_aside

CELL_SHARE = 0.7
# Mixing of numbers: halves of 31 bits, a prime below 2**31, one constant per round.
_HALF, _PRIME, _SHIFT = 1 << 31, (1 << 31) - 1, 1 << 61
_ROUNDS = (1500450271, 1190494759, 987654319, 2038074743)
_REACH = [-2, -1, 0, 1, 2]


def _stir(half: Column, constant: int) -> Column:
    at = (half + F.lit(constant)) % F.lit(_PRIME)
    return (at * at) % F.lit(_PRIME)


def mixed(number: Column) -> Column:
    """Another whole number for each number between -2**61 and 2**61, in an order that has nothing to do with theirs.

    Whole-number arithmetic alone, so other engines can follow it; :func:`unmixed` turns it back."""
    up = number.cast("long") + F.lit(_SHIFT)
    high, low = F.shiftright(up, 31), up % F.lit(_HALF)
    for constant in _ROUNDS:
        high, low = low, (high + _stir(low, constant)) % F.lit(_HALF)
    return high * F.lit(_HALF) + low


def unmixed(number: Column) -> Column:
    high, low = F.shiftright(number, 31), number % F.lit(_HALF)
    for constant in reversed(_ROUNDS):
        high, low = F.pmod(low - _stir(high, constant), F.lit(_HALF)), high
    return high * F.lit(_HALF) + low - F.lit(_SHIFT)


def _cell(value: Column, distance: float) -> Column:
    return F.floor(value / F.lit(distance * CELL_SHARE))


def with_cells(points: DataFrame, distance: float) -> DataFrame:
    return points.withColumn("cx", _cell(F.col("x"), distance)).withColumn("cy", _cell(F.col("y"), distance))


def cell_leaders(points: DataFrame, group: list[str]) -> DataFrame:
    """The first point of each cell; combined before the shuffle, so a crowded cell costs nothing."""
    rest = [c for c in points.columns if c not in {*group, "cx", "cy", "idx"}]
    led = points.groupBy(*group, "cx", "cy").agg(F.min_by(F.struct("idx", *rest), F.col("idx")).alias("lead"))
    return led.select(*group, "cx", "cy", "lead.*")


def near_pairs(points: DataFrame, leaders: DataFrame, distance: float, group: list[str]) -> DataFrame:
    """Pairs (idx, leader) closer than ``distance`` within a group.

    ``leaders`` has at most one row per cell.  The join is on cell equality; a
    crowded cell is a skewed key on the points side only, which adaptive
    execution can split because a cell meets at most 25 leaders.  The merge hint
    keeps the 25 copies of all leaders from being broadcast: planning knows only
    the packed size of the files they come from."""
    around = F.array(
        *[record(cx=F.col("cx") + dx, cy=F.col("cy") + dy) for dx in _REACH for dy in _REACH]
    )
    spread = leaders.select(
        *group, F.col("idx").alias("leader"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.inline(around)
    )
    dx, dy = F.col("x") - F.col("lx"), F.col("y") - F.col("ly")
    return (
        points.join(spread.hint("merge"), [*group, "cx", "cy"])
        .where(dx * dx + dy * dy < F.lit(distance * distance))
        .select(*group, "idx", "leader")
    )


def road_ends(roads: DataFrame, *group: str) -> DataFrame:
    """Start and end of every road with at least two points.

    ``idx`` numbers them: by road id, start before end."""
    ends = F.array(
        record(end=F.lit(0), p=F.get("polyline", F.lit(0))),
        record(end=F.lit(1), p=F.element_at("polyline", -1)),
    )
    return roads.where(F.size("polyline") >= 2).select(*group, "osm_id", "width", F.inline(ends)).select(
        *group, (F.col("osm_id") * 2 + F.col("end")).alias("idx"), F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        "width",
    )


def spots(ends: DataFrame, group: list[str]) -> DataFrame:
    """Road ends at exactly the same place as one row with their lowest ``idx``.

    Ends at one place are always grouped alike: they follow each other in the order,
    and whoever takes the first, or it itself as a seed, is near all others.  This
    removes the heavy places before any comparison, with partial aggregation."""
    return ends.groupBy(*group, "x", "y").agg(
        F.min("idx").alias("idx"), F.count(F.lit(1)).alias("ends"), F.max("width").alias("width")
    )


def greedy_groups(points: DataFrame, distance: float, group: list[str]) -> DataFrame:
    """Assign every point its seed: (group..., idx, seed).

    In order of the mixed ``idx`` a point not yet taken becomes a seed and takes the later free points nearer than
    ``distance`` to itself.  The order is free to choose; this one has no relation to where points lie, so a row of
    points with rising numbers is no longer settled one after the other."""
    return greedy_rounds(points, distance, group)[0]


def greedy_rounds(points: DataFrame, distance: float, group: list[str]) -> tuple[DataFrame, int]:
    """:func:`greedy_groups`, and the number of rounds it took.

    The first undecided point of a cell is a seed when no undecided point before it is near; points near a new seed are
    decided.  A point waits only for near points before it, and in a mixed order such chains grow with the logarithm of the
    number of points.  Finally each point goes to its first near seed.  Lineage is cut each round."""
    keyed = set_aside(with_cells(points.select(*group, mixed(F.col("idx")).alias("idx"), "x", "y"), distance), "points")
    undecided, seeds, rounds = keyed, None, 0
    while True:
        rounds += 1
        leaders = cell_leaders(undecided, group)
        blocked = (
            near_pairs(undecided, leaders, distance, group).where(F.col("idx") < F.col("leader"))
            .select(*group, F.col("leader").alias("idx")).distinct()
        )
        found = set_aside(leaders.join(blocked, [*group, "idx"], "left_anti"), "seeds")
        seeds = found if seeds is None else seeds.unionByName(found)
        taken = near_pairs(undecided, found, distance, group).select(*group, "idx").distinct()
        undecided = set_aside(undecided.join(taken, [*group, "idx"], "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    seeded = (
        near_pairs(keyed, seeds, distance, group)
        .where(F.col("leader") <= F.col("idx"))
        .groupBy(*group, "idx")
        .agg(F.min("leader").alias("seed"))
    )
    return seeded.select(*group, unmixed(F.col("idx")).alias("idx"), unmixed(F.col("seed")).alias("seed")), rounds


def junctions(roads: DataFrame, *group: str, distance: float = JUNCTION_DISTANCE) -> DataFrame:
    """Places where at least two road ends meet: seed, ends, mean position and radius.

    With ``group`` columns (the tile of a feature copy) each group is treated by itself."""
    keys = list(group)
    places = spots(road_ends(roads, *keys), keys)
    seeded = greedy_groups(places, distance, keys)
    n = F.col("ends")
    return (
        places.join(seeded, [*keys, "idx"])
        .groupBy(*keys, "seed")
        .agg(
            F.sum(n).alias("ends"),
            (F.sum(F.col("x") * n) / F.sum(n)).alias("x"),
            (F.sum(F.col("y") * n) / F.sum(n)).alias("y"),
            (F.max("width") * F.lit(JUNCTION_RADIUS_PER_WIDTH)).alias("radius"),
        )
        .where(F.col("ends") >= 2)
    )


def junction_faces(found: DataFrame, *group: str) -> DataFrame:
    """A disc of triangles for each junction; ``osm_id`` is the seed's road."""
    step = F.lit(2.0 * 3.141592653589793 / JUNCTION_SEGMENTS)
    rows = found.select(
        *group, F.floor(F.col("seed") / 2).alias("osm_id"), "seed", "x", "y", "radius",
        F.explode(F.sequence(F.lit(0), F.lit(JUNCTION_SEGMENTS - 1))).alias("face"),
    )

    def rim(at: Column, i: int) -> list[Column]:
        return [
            (F.col("x") + F.col("radius") * F.cos(at * step)).alias(f"x{i}"),
            F.lit(JUNCTION_LIFT).alias(f"y{i}"),
            (-F.col("y") + F.col("radius") * F.sin(at * step)).alias(f"z{i}"),
        ]

    none = F.lit(None).cast("double")
    return rows.select(
        *group, "osm_id", "seed", F.lit("junction").alias("part"), "face",
        F.col("x").alias("x0"), F.lit(JUNCTION_LIFT).alias("y0"), (-F.col("y")).alias("z0"),
        *rim(F.col("face"), 1), *rim((F.col("face") + 1) % JUNCTION_SEGMENTS, 2),
        none.alias("x3"), none.alias("y3"), none.alias("z3"),
        F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"),
        rgba(JUNCTION_COLOUR).alias("color"),
    )
