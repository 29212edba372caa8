"""Settings of the operators.  The defaults are the values users of the desktop tool know."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ImportConfig:
    """What to take from a map and how to fill in missing measures."""

    import_buildings: bool = True
    import_roads: bool = True
    import_water: bool = True
    import_landuse: bool = True
    import_natural: bool = True
    default_building_height: float = 10.0
    metres_per_level: float = 3.0
    simplify_geometry: bool = False
    simplify_tolerance: float = 0.5
    # Off unless set: (min_lat, min_lon, max_lat, max_lon) and square metres.
    filter_bounds: tuple[float, float, float, float] | None = None
    min_area_size: float | None = None


@dataclass(frozen=True)
class TileConfig:
    """Square tiles over the map; ``store_span`` tiles per side share one folder of a tile store."""

    tile_size: float = 500.0
    tile_height: float = 200.0
    store_span: int = 16


@dataclass(frozen=True)
class TerrainConfig:
    """One elevation grid: extent, resolution, noise and flattening."""

    size_x: float = 1000.0
    size_z: float = 1000.0
    resolution_x: int = 128
    resolution_z: int = 128
    base_height: float = 0.0
    max_height: float = 50.0
    water_level: float = 0.0
    type: str = "Rolling"  # Flat, Rolling, Hilly, Mountainous
    seed: int = 12345
    noise_scale: float = 0.002
    octaves: int = 6
    lacunarity: float = 2.0
    persistence: float = 0.5
    talus: float = 0.5
    erosion_strength: float = 0.1
    flatten_center: bool = False
    flatten_radius: float = 200.0
    flatten_falloff: float = 100.0


@dataclass(frozen=True)
class SurfaceConfig:
    """Colouring and level of detail of a terrain surface."""

    color_mode: str = "Biome"  # Solid, HeightGradient, SlopeGradient, Biome
    solid_color: tuple[float, ...] = (0.4, 0.5, 0.3, 1.0)
    color_low: tuple[float, ...] = (0.35, 0.45, 0.35, 1.0)
    color_mid: tuple[float, ...] = (0.55, 0.5, 0.4, 1.0)
    color_high: tuple[float, ...] = (0.7, 0.7, 0.72, 1.0)
    color_peak: tuple[float, ...] = (0.95, 0.95, 0.98, 1.0)
    height_low: float = 0.2
    height_mid: float = 0.5
    height_high: float = 0.75
    height_peak: float = 0.9
    color_steep: tuple[float, ...] = (0.5, 0.45, 0.4, 1.0)
    steep_threshold: float = 35.0
    steep_blend: float = 10.0
    underwater_color: tuple[float, ...] = (0.35, 0.4, 0.35, 1.0)
    water_color: tuple[float, ...] = (0.2, 0.4, 0.6, 0.9)
    water_level: float = 0.0
    lod_level: int = 0


@dataclass(frozen=True)
class WorldConfig:
    """A world of square terrain chunks flattened under map features."""

    chunk_size: float = 500.0
    chunk_resolution: int = 64
    world_min: tuple[float, float] = (-2000.0, -2000.0)
    world_max: tuple[float, float] = (2000.0, 2000.0)
    terrain: TerrainConfig = field(default_factory=TerrainConfig)
    surface: SurfaceConfig = field(default_factory=SurfaceConfig)
    flatten_radius: float = 10.0
    blend_distance: float = 50.0
    base_height: float = 0.0

    @property
    def mask_cell(self) -> float:
        """Side of one flatten-mask cell in metres."""
        return self.chunk_size / self.chunk_resolution
