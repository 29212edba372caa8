"""Classes, heights, widths and default colours of map features, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import label_of, lookup, rgba
from .tags import height_text, leading_float, leading_int, without_metre_sign

UNKNOWN = "Unknown"


def road_class(highway: Column) -> Column:
    return F.coalesce(label_of(highway, V.ROAD_VALUES), F.lit(UNKNOWN))


def building_class(building: Column) -> Column:
    return F.coalesce(label_of(building, V.BUILDING_VALUES), F.lit(UNKNOWN))


def area_class(natural: Column, waterway: Column, leisure: Column, landuse: Column, amenity: Column) -> Column:
    """First tag in this order with a known value; unknown values fall through to the next tag."""
    texts = {"natural": natural, "waterway": waterway, "leisure": leisure, "landuse": landuse, "amenity": amenity}
    found = [label_of(texts[key], words) for key, words in V.AREA_VALUES.items()]
    return F.coalesce(*found, F.lit(UNKNOWN))


def roof_class(roof_shape: Column, building_roof_shape: Column) -> Column:
    shape = F.coalesce(roof_shape, building_roof_shape)
    return F.when(shape.isNull(), F.lit("Flat")).otherwise(
        F.coalesce(label_of(shape, V.ROOF_VALUES), F.lit(UNKNOWN))
    )


def building_height(height: Column, levels: Column, building: Column, metres_per_level: float, default: float) -> Column:
    by_type = None
    for metres, words in V.BUILDING_HEIGHTS.items():
        by_type = (F if by_type is None else by_type).when(building.isin(words), F.lit(metres))
    return F.coalesce(
        leading_float(height_text(height)),
        leading_int(levels).cast("double") * F.lit(metres_per_level),
        by_type,
        F.lit(default),
    )


def building_levels(levels: Column, height: Column, metres_per_level: float) -> Column:
    return F.coalesce(leading_int(levels), (height / F.lit(metres_per_level)).try_cast("int"))


def road_width(width: Column, lanes: Column, road: Column) -> Column:
    return F.coalesce(
        leading_float(without_metre_sign(width)),
        leading_int(lanes).cast("double") * F.lit(V.LANE_WIDTH),
        lookup(road, V.ROAD_WIDTH, F.lit(V.DEFAULT_ROAD_WIDTH)),
    )


def road_lanes(lanes: Column, road: Column) -> Column:
    return F.coalesce(leading_int(lanes), lookup(road, V.ROAD_LANES, F.lit(V.DEFAULT_ROAD_LANES)))


def wall_colour(building: Column) -> Column:
    return lookup(building, V.WALL_COLOURS, rgba(V.DEFAULT_WALL_COLOUR), rgba)


def roof_colour(building: Column) -> Column:
    return lookup(building, V.ROOF_COLOURS, rgba(V.DEFAULT_ROOF_COLOUR), rgba)


def road_colour(road: Column) -> Column:
    return lookup(road, V.ROAD_COLOURS, rgba(V.DEFAULT_ROAD_COLOUR), rgba)


def area_colour(area: Column) -> Column:
    return lookup(area, V.AREA_COLOURS, rgba(V.DEFAULT_AREA_COLOUR), rgba)


def area_lift(area: Column) -> Column:
    return lookup(area, V.AREA_LIFT, F.lit(V.DEFAULT_AREA_LIFT))
