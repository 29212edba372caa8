"""Elevation grids as cell tables: generate, shape, measure, sample and colour.

A cell is ``cx, cz, ix, iz, x, z, h``: chunk key, index inside the chunk, place
and height.  Chunks are independent grids that repeat their border cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SurfaceConfig, TerrainConfig, WorldConfig
from ..functions.columns import clamp, lerp_colour, norm, record, rgba, smoothstep
from ..functions.noise import with_fractal, with_ridges
from . import blocks

GRID = ["cx", "cz"]
CELL = ["cx", "cz", "ix", "iz"]
BLOCK = 128


def single_grid(spark: SparkSession, config: TerrainConfig) -> DataFrame:
    """Cells of one un-chunked grid with its corner at the origin; no heights yet."""
    n = spark.range(config.resolution_x * config.resolution_z)
    ix = F.col("id") % config.resolution_x
    iz = F.floor(F.col("id") / config.resolution_x)
    return n.select(
        F.lit(0).alias("cx"), F.lit(0).alias("cz"), ix.cast("int").alias("ix"), iz.cast("int").alias("iz"),
        (ix * F.lit(config.size_x / (config.resolution_x - 1))).alias("x"),
        (iz * F.lit(config.size_z / (config.resolution_z - 1))).alias("z"),
    )


def chunk_grid(chunks: DataFrame, world: WorldConfig) -> DataFrame:
    """Cells of the given chunks (``cx, cz``); no heights yet.

    Keys are spread over the tasks first, then each is expanded where it lands.
    The number of tasks is given outright: by size alone, adaptive execution
    would put the short list of keys into one task.  The keys are named in another
    order than a grouping by chunk has them: Spark takes a repartition out that
    repeats the grouping's own, and with it the number of tasks."""
    t = world.terrain
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    west = F.lit(float(world.world_min[0])) + F.col("cx") * F.lit(float(world.chunk_size))
    north = F.lit(float(world.world_min[1])) + F.col("cz") * F.lit(float(world.chunk_size))
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        chunks.select("cx", "cz").repartition(tasks, "cz", "cx")
        .select("cx", "cz", line(t.resolution_z).alias("iz"))
        .select("cx", "cz", line(t.resolution_x).alias("ix"), "iz")
        .select(
            "cx", "cz", "ix", "iz",
            (west + F.col("ix") * F.lit(world.chunk_size / (t.resolution_x - 1))).alias("x"),
            (north + F.col("iz") * F.lit(world.chunk_size / (t.resolution_z - 1))).alias("z"),
        )
    )


def with_elevation(cells: DataFrame, config: TerrainConfig) -> DataFrame:
    """Add ``h`` from noise at (x, z) by terrain type."""
    kept = cells.columns
    x, z = F.col("x") * F.lit(config.noise_scale), F.col("z") * F.lit(config.noise_scale)
    fine = dict(seed=config.seed, octaves=config.octaves, lacunarity=config.lacunarity)
    if config.type == "Flat":
        df = with_fractal(cells, "n", x, z, config.seed, 2, config.lacunarity, 0.3)
        level = F.col("n") * F.lit(0.1)
    elif config.type == "Rolling":
        df = with_fractal(cells, "n", x, z, persistence=config.persistence, **fine)
        level = smoothstep(F.col("n") * F.lit(0.5) + F.lit(0.5)) * F.lit(2.0) - F.lit(1.0)
    elif config.type == "Hilly":
        df = with_fractal(cells, "n", x, z, persistence=config.persistence, **fine)
        df = with_fractal(df, "d", x * F.lit(2.0), z * F.lit(2.0), config.seed, 3)
        level = F.col("n") * F.lit(0.8) + F.col("d") * F.lit(0.2)
    elif config.type == "Mountainous":
        df = with_ridges(cells, "r", x, z, gain=0.5, **fine)
        df = with_fractal(df, "n", x * F.lit(0.5), z * F.lit(0.5), config.seed, 4)
        # The mask is not below 0 in theory only; a tiny negative value would have no power.
        mask = F.pow(F.greatest((F.col("n") + F.lit(1.0)) * F.lit(0.5), F.lit(0.0)), F.lit(1.5))
        level = F.col("r") * mask * F.lit(2.0) - F.lit(1.0)
    else:
        raise ValueError(f"unknown terrain type {config.type!r}")
    return df.select(*kept, (F.lit(config.base_height) + level * F.lit(config.max_height)).alias("h"))


def flatten_center(cells: DataFrame, config: TerrainConfig) -> DataFrame:
    """Level the surroundings of the middle of (0..size), easing out over the falloff."""
    if not config.flatten_center:
        return cells
    away = norm(F.col("x") - F.lit(config.size_x * 0.5), F.col("z") - F.lit(config.size_z * 0.5))
    t = smoothstep((away - F.lit(config.flatten_radius)) / F.lit(config.flatten_falloff))
    base = F.lit(config.base_height)
    h = (
        F.when(away < F.lit(config.flatten_radius), base)
        .when(
            away < F.lit(config.flatten_radius + config.flatten_falloff),
            base * (F.lit(1.0) - t) + F.col("h") * t,
        )
        .otherwise(F.col("h"))
    )
    return cells.withColumn("h", h)


def with_neighbours(cells: DataFrame, width: int, height: int, diagonal: bool = False) -> DataFrame:
    """Add the heights of the cells before and after in x (``hl, hr``) and z (``hd, hu``).

    NULL beyond the grid.  With ``diagonal``, also ``hru``, the cell after in both.
    Work is split in blocks of at most BLOCK x BLOCK cells, each with a border of
    copied cells, so even one huge grid is spread over many tasks.  Both windows
    ask for the same partitioning, which freshly made chunks already have."""
    blocks_x, blocks_z = -(-width // BLOCK), -(-height // BLOCK)
    kept = cells.columns
    if blocks_x == blocks_z == 1:
        placed, keys, own = cells, GRID, F.lit(True)
    else:
        def near(index: str, count: int) -> Column:
            at = F.floor(F.col(index) / BLOCK).cast("int")
            inner = F.col(index) % BLOCK
            before = F.when((inner == 0) & (at > 0), at - 1)
            after = F.when((inner == BLOCK - 1) & (at < count - 1), at + 1)
            return F.array_compact(F.array(at, before, after))

        placed = cells.select("*", F.explode(near("ix", blocks_x)).alias("bx")).select(
            "*", F.explode(near("iz", blocks_z)).alias("bz")
        )
        keys = [*GRID, "bx", "bz"]
        own = (F.floor(F.col("ix") / BLOCK) == F.col("bx")) & (F.floor(F.col("iz") / BLOCK) == F.col("bz"))

    def both_sides(df: DataFrame, along: str, across: str, before: str, after: str, *more: str) -> DataFrame:
        """Add the values of the cells before and after along one index, NULL where a cell is missing."""
        window = Window.partitionBy(*keys).orderBy(across, along)
        seen = F.struct(along, across, "h", *more)
        moved = df.select("*", F.lag(seen).over(window).alias("__b"), F.lead(seen).over(window).alias("__a"))
        beside = lambda side, by: (F.col(f"{side}.{along}") == F.col(along) + by) & (F.col(f"{side}.{across}") == F.col(across))
        return moved.select(
            *df.columns, F.when(beside("__b", -1), F.col("__b.h")).alias(before), F.when(beside("__a", 1), F.col("__a.h")).alias(after),
            *[F.when(beside("__a", 1), F.col(f"__a.{m}")).alias(f"{m}u") for m in more],
        )

    found = both_sides(placed, "ix", "iz", "hl", "hr")
    found = both_sides(found, "iz", "ix", "hd", "hu", *(["hr"] if diagonal else []))
    return found.where(own).select(*kept, "hl", "hr", "hd", "hu", *(["hru"] if diagonal else []))


def steepest(cells: DataFrame, config: TerrainConfig) -> DataFrame:
    """Interior cells that stand above a neighbour by more than the talus: the target cell and the drop.

    Of equally low neighbours the first in the order x-1, x+1, z-1, z+1 is taken."""
    near = with_neighbours(cells, config.resolution_x, config.resolution_z)
    drops = F.array(*[F.col("h") - F.col(n) for n in ("hl", "hr", "hd", "hu")])
    step = F.col("step")
    return (
        near.where(F.col("hl").isNotNull() & F.col("hr").isNotNull() & F.col("hd").isNotNull() & F.col("hu").isNotNull())
        .select(*CELL, drops.alias("drops"))
        .select(*CELL, F.array_max("drops").alias("drop"), F.array_position("drops", F.array_max("drops")).alias("step"))
        .where(F.col("drop") > F.lit(config.talus))
        .select(
            *CELL,
            (F.col("ix") + F.when(step == 1, -1).when(step == 2, 1).otherwise(0)).alias("to_ix"),
            (F.col("iz") + F.when(step == 3, -1).when(step == 4, 1).otherwise(0)).alias("to_iz"),
            "drop",
        )
    )


def thermal_pass(cells: DataFrame, config: TerrainConfig) -> DataFrame:
    """One erosion pass: every steep cell gives part of its drop to its steepest neighbour.

    All gifts are computed from the old heights and added up, so order does not matter."""
    gifts = steepest(cells, config).withColumn(
        "gift", (F.col("drop") - F.lit(config.talus)) * F.lit(config.erosion_strength) * F.lit(0.5)
    )
    sides = F.array(
        F.struct("ix", "iz", (-F.col("gift")).alias("h")),
        record(ix=F.col("to_ix"), iz=F.col("to_iz"), h=F.col("gift")),
    )
    moved = gifts.select("cx", "cz", F.inline(sides)).select(*CELL, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("z"), "h")
    return (
        cells.select(*CELL, "x", "z", "h").unionByName(moved)
        .groupBy(*CELL).agg(F.max("x").alias("x"), F.max("z").alias("z"), F.sum("h").alias("h"))
    )


def height_range(cells: DataFrame, *keys: str) -> DataFrame:
    """Lowest and highest cell per key; (0, 0) for an empty table without keys."""
    ranged = cells.groupBy(*keys).agg(F.min("h").alias("min_h"), F.max("h").alias("max_h"))
    return ranged.na.fill(0.0, ["min_h", "max_h"])


def with_normals(cells: DataFrame, config: TerrainConfig, step_x: float, step_z: float) -> DataFrame:
    """Add ``nx, ny, nz`` by central difference and ``slope`` in degrees.

    At the border the missing neighbour is the cell itself, as in a clamped lookup."""
    near = with_neighbours(cells, config.resolution_x, config.resolution_z)
    gx = (F.coalesce("hl", "h") - F.coalesce("hr", "h")) / F.lit(2.0 * step_x)
    gz = (F.coalesce("hd", "h") - F.coalesce("hu", "h")) / F.lit(2.0 * step_z)
    length = F.sqrt(gx * gx + F.lit(1.0) + gz * gz)
    return near.select(
        *cells.columns, (gx / length).alias("nx"), (F.lit(1.0) / length).alias("ny"), (gz / length).alias("nz")
    ).withColumn("slope", F.degrees(F.acos(clamp(F.col("ny"), F.lit(-1.0), F.lit(1.0)))))


def with_relative_height(cells: DataFrame, config: TerrainConfig) -> DataFrame:
    """Add ``rel``: height between the lowest (0) and highest (1) cell of its chunk.

    The range is aggregated in each task first and joined back, one row per chunk, so a grid of any size is
    no group for one task."""
    ranged = cells.join(height_range(cells, *GRID), GRID)
    spread = F.col("max_h") - F.col("min_h")
    rel = (F.col("h") - F.col("min_h")) / F.when(spread < F.lit(1e-3), F.lit(1.0)).otherwise(spread)
    return ranged.withColumn("rel", rel).drop("min_h", "max_h")


def _by_height(rel: Column, s: SurfaceConfig) -> Column:
    stops = [
        (s.height_low, s.color_low), (s.height_mid, s.color_mid),
        (s.height_high, s.color_high), (s.height_peak, s.color_peak),
    ]
    colour = F.when(rel < F.lit(stops[0][0]), rgba(stops[0][1]))
    for (low, first), (high, second) in zip(stops, stops[1:]):
        t = (rel - F.lit(low)) / F.lit(high - low)
        colour = colour.when(rel < F.lit(high), lerp_colour(rgba(first), rgba(second), t))
    return colour.otherwise(rgba(stops[-1][1]))


def _steepness(slope: Column, s: SurfaceConfig) -> Column:
    """0 below the blend range around the threshold, 1 above it."""
    return clamp(
        (slope - F.lit(s.steep_threshold - s.steep_blend)) / F.lit(2.0 * s.steep_blend), F.lit(0.0), F.lit(1.0)
    )


def is_under_water(height: Column, water_level: float) -> Column:
    return height < F.lit(float(water_level))


def surface_colour(height: Column, slope: Column, rel: Column, s: SurfaceConfig = SurfaceConfig()) -> Column:
    """Colour of a cell by the mode of the settings; one fixed colour under water."""
    if s.color_mode == "Solid":
        dry = rgba(s.solid_color)
    elif s.color_mode == "HeightGradient":
        dry = _by_height(rel, s)
    elif s.color_mode == "SlopeGradient":
        dry = lerp_colour(rgba(s.color_low), rgba(s.color_steep), _steepness(slope, s))
    elif s.color_mode == "Biome":
        dry = lerp_colour(_by_height(rel, s), rgba(s.color_steep), _steepness(slope, s))
    else:
        raise ValueError(f"unknown colour mode {s.color_mode!r}")
    return F.when(is_under_water(height, s.water_level), rgba(s.underwater_color)).otherwise(dry)


ColourFunction = Callable[[Column, Column, Column, Column], Column]


def surface_vertices(
    cells: DataFrame, config: TerrainConfig, step_x: float, step_z: float,
    surface: SurfaceConfig = SurfaceConfig(), colour: ColourFunction | None = None,
) -> DataFrame:
    """A vertex per cell: place with z turned south, normal, slope and colour.

    ``colour`` is the caller's own rule from (x, z, height, slope) to a colour
    column; it may be a column expression or a pandas function."""
    shaded = with_normals(cells, config, step_x, step_z)
    if colour is None:
        shaded = with_relative_height(shaded, config)
        painted = surface_colour(F.col("h"), F.col("slope"), F.col("rel"), surface)
    else:
        painted = colour(F.col("x"), F.col("z"), F.col("h"), F.col("slope"))
    return shaded.select(
        *CELL, F.col("x").alias("vx"), F.col("h").alias("vy"), (-F.col("z")).alias("vz"),
        "nx", "ny", (-F.col("nz")).alias("nz"), "slope", painted.alias("color"),
    )


def surface_triangles(
    cells: DataFrame, config: TerrainConfig, step_x: float, step_z: float, lod_level: int = 0
) -> DataFrame:
    """Two triangles per square of every 2^lod-th cell; nothing when fewer than two cells remain.

    ``step_x, step_z`` are the distances between neighbouring cells."""
    step = 1 << lod_level
    width, height = (config.resolution_x - 1) // step + 1, (config.resolution_z - 1) // step + 1
    coarse = cells.where(
        (F.col("ix") % step == 0) & (F.col("iz") % step == 0)
        & (F.col("ix") < width * step) & (F.col("iz") < height * step)
    )
    if width < 2 or height < 2:
        coarse = coarse.where(F.lit(False))
    coarse = coarse.select(
        "cx", "cz", F.floor(F.col("ix") / step).cast("int").alias("ix"),
        F.floor(F.col("iz") / step).cast("int").alias("iz"), "x", "z", "h",
    )
    near = with_neighbours(coarse, max(width, 1), max(height, 1), diagonal=True).where(
        F.col("hr").isNotNull() & F.col("hu").isNotNull()
    )

    def corner(h: str, right: int, up: int) -> tuple[Column, Column, Column]:
        return (
            F.col("x") + F.lit(right * step * step_x), F.col(h), -(F.col("z") + F.lit(up * step * step_z))
        )

    c00, c10, c01, c11 = corner("h", 0, 0), corner("hr", 1, 0), corner("hu", 0, 1), corner("hru", 1, 1)

    def triangle(half: int, *corners) -> Column:
        return record(
            half=F.lit(half),
            **{f"{axis}{i}": v for i, c in enumerate(corners) for axis, v in zip("xyz", c)},
        )

    return near.select(
        *CELL, F.inline(F.array(triangle(0, c00, c10, c01), triangle(1, c10, c11, c01)))
    )


def water_faces(chunks: DataFrame, world: WorldConfig) -> DataFrame:
    """One level rectangle per chunk at the water level."""
    west = F.lit(float(world.world_min[0])) + F.col("cx") * F.lit(float(world.chunk_size))
    north = F.lit(float(world.world_min[1])) + F.col("cz") * F.lit(float(world.chunk_size))
    size, level = F.lit(float(world.chunk_size)), F.lit(float(world.terrain.water_level))
    corners = [(west, north), (west + size, north), (west + size, north + size), (west, north + size)]
    out = []
    for i, (x, z) in enumerate(corners):
        out += [x.alias(f"x{i}"), level.alias(f"y{i}"), (-z).alias(f"z{i}")]
    return chunks.select("cx", "cz", *out, rgba(world.surface.water_color).alias("color"))


def pack_heights(cells: DataFrame, world: WorldConfig) -> DataFrame:
    """Chunk cells in blocks (see :mod:`mapweave.operators.blocks`): pack once what is sampled more than once."""
    return blocks.pack(cells, ["cx", "cz"], "h", world.terrain.resolution_x, world.terrain.resolution_z)


def sample_heights(points: DataFrame, cells: DataFrame, world: WorldConfig) -> DataFrame:
    """Add ``h`` at any ``x, z`` by bilinear lookup in the chunk there, of cells or blocks; the base height where there is
    none.  Indices are clamped to the chunk, the fraction is not."""
    t = world.terrain
    packed = cells if "values" in cells.columns else pack_heights(cells, world)
    step_x, step_z = world.chunk_size / (t.resolution_x - 1), world.chunk_size / (t.resolution_z - 1)
    cx, cz = chunk_x(F.col("x"), world), chunk_z(F.col("z"), world)
    gx = (F.col("x") - (F.lit(float(world.world_min[0])) + F.col("cx") * F.lit(float(world.chunk_size)))) / F.lit(step_x)
    gz = (F.col("z") - (F.lit(float(world.world_min[1])) + F.col("cz") * F.lit(float(world.chunk_size)))) / F.lit(step_z)
    placed = points.select("*", cx.alias("cx"), cz.alias("cz")).select("*", gx.alias("gx"), gz.alias("gz"))
    met = blocks.look_up(placed, packed, ["cx", "cz"], t.resolution_x, t.resolution_z)
    c00, c10, c01, c11 = (F.col(f"c{k}") for k in ("00", "10", "01", "11"))
    # A missing cell takes the value of one before it.
    h = blocks.between(c00, F.coalesce(c10, c00), F.coalesce(c01, c00), F.coalesce(c11, c10, c01, c00), F.col("fx"), F.col("fz"))
    return met.select(*points.columns, F.coalesce(h, F.lit(world.base_height)).alias("h"))


def chunk_x(x: Column, world: WorldConfig) -> Column:
    """Chunk column of a world x; not clamped to the world."""
    return F.floor((x - F.lit(float(world.world_min[0]))) / F.lit(float(world.chunk_size))).cast("int")


def chunk_z(z: Column, world: WorldConfig) -> Column:
    return F.floor((z - F.lit(float(world.world_min[1]))) / F.lit(float(world.chunk_size))).cast("int")


def chunk_bounds(chunks: DataFrame, world: WorldConfig) -> DataFrame:
    west = F.lit(float(world.world_min[0])) + F.col("cx") * F.lit(float(world.chunk_size))
    north = F.lit(float(world.world_min[1])) + F.col("cz") * F.lit(float(world.chunk_size))
    size = F.lit(float(world.chunk_size))
    return chunks.select(
        "*", west.alias("min_x"), north.alias("min_z"), (west + size).alias("max_x"), (north + size).alias("max_z")
    )


def chunks_of_box(boxes: DataFrame, world: WorldConfig) -> DataFrame:
    """All chunk keys for each row's box, from floor of the low side to ceil of the high side, inclusive."""
    size = F.lit(float(world.chunk_size))
    low = lambda c, i: F.floor((F.col(c) - F.lit(float(world.world_min[i]))) / size).cast("int")
    high = lambda c, i: F.ceil((F.col(c) - F.lit(float(world.world_min[i]))) / size).cast("int")
    return boxes.select(
        "*", F.explode(F.sequence(low("min_z", 1), high("max_z", 1))).alias("cz")
    ).select("*", F.explode(F.sequence(low("min_x", 0), high("max_x", 0))).alias("cx"))


def chunks_of_world(spark: SparkSession, world: WorldConfig) -> DataFrame:
    """Every chunk key of the world."""
    import math

    across = math.ceil((world.world_max[0] - world.world_min[0]) / world.chunk_size)
    down = math.ceil((world.world_max[1] - world.world_min[1]) / world.chunk_size)
    return spark.range(max(across, 0) * max(down, 0)).select(
        (F.col("id") % max(across, 1)).cast("int").alias("cx"), F.floor(F.col("id") / max(across, 1)).cast("int").alias("cz")
    )


def chunks_of_points(points: DataFrame, world: WorldConfig) -> DataFrame:
    """Chunks of the world that hold points (``x, z``), with their number.  Counted in each task first, so a crowded
    chunk costs one row per task."""
    import math

    across, down = (math.ceil((high - low) / world.chunk_size) for low, high in zip(world.world_min, world.world_max))
    keys = points.select(chunk_x(F.col("x"), world).alias("cx"), chunk_z(F.col("z"), world).alias("cz"))
    inside = F.col("cx").between(0, across - 1) & F.col("cz").between(0, down - 1)
    return keys.where(inside).groupBy("cx", "cz").agg(F.count(F.lit(1)).alias("points"))


def with_survey(cells: DataFrame, points: DataFrame, world: WorldConfig) -> DataFrame:
    """Raise each cell by the mean ``v`` of the points (``x, z, v``) nearest to it; cells without points stay."""
    t = world.terrain
    place = points.select("*", chunk_x(F.col("x"), world).alias("cx"), chunk_z(F.col("z"), world).alias("cz"))

    def index(axis: str, key: str, side: int, steps: int) -> Column:
        corner = F.lit(float(world.world_min[side])) + F.col(key) * F.lit(float(world.chunk_size))
        return F.floor((F.col(axis) - corner) / F.lit(world.chunk_size / (steps - 1)) + F.lit(0.5)).cast("int")

    mean = place.select(
        "cx", "cz", index("x", "cx", 0, t.resolution_x).alias("ix"), index("z", "cz", 1, t.resolution_z).alias("iz"), "v"
    ).groupBy(*CELL).agg(F.avg("v").alias("mean_v"))
    raised = F.col("h") + F.coalesce("mean_v", F.lit(0.0))
    return cells.join(mean, CELL, "left").withColumn("h", raised).drop("mean_v")


def chunks_around(
    eyes: DataFrame, view_distance: float, world: WorldConfig, existing: DataFrame | None = None
) -> DataFrame:
    """Chunks to build around each ``x, z``: touching the world, and not yet existing."""
    d = F.lit(float(view_distance))
    boxes = eyes.select(
        (F.col("x") - d).alias("min_x"), (F.col("x") + d).alias("max_x"),
        (F.col("z") - d).alias("min_z"), (F.col("z") + d).alias("max_z"),
    )
    keys = chunks_of_box(boxes, world).select("cx", "cz").distinct()
    inside = (
        (F.col("max_x") >= F.lit(float(world.world_min[0]))) & (F.col("min_x") <= F.lit(float(world.world_max[0])))
        & (F.col("max_z") >= F.lit(float(world.world_min[1]))) & (F.col("min_z") <= F.lit(float(world.world_max[1])))
    )
    wanted = chunk_bounds(keys, world).where(inside).select("cx", "cz")
    return wanted if existing is None else wanted.join(existing.select("cx", "cz"), GRID, "left_anti")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """One row: chunks, chunks with heights, chunks with a surface (flags ``generated``, ``has_mesh``)."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("generated").alias("generated"),
        F.count_if("has_mesh").alias("with_mesh"),
    )
