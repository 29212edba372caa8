"""Roads, buildings and areas out of nodes and ways.

Tag rules run on the way rows first, so only references of ways that can become
a feature are expanded and joined to nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ImportConfig
from ..functions import classify, geodesy, shapes, tags
from ..functions.columns import one_row
from ..functions.fixed_values import AREA_VALUES, NATURAL_AREAS, ROAD_VALUES
from ..functions.tags import tag
from .simplify import simplify


def local_nodes(nodes: DataFrame, origin: DataFrame) -> DataFrame:
    """node_id with local metres; projected once per node, not once per reference."""
    at = one_row(origin)
    return nodes.select(
        "node_id", geodesy.local_x(F.col("lon"), at).alias("x"), geodesy.local_y(F.col("lat"), at).alias("y")
    )


def is_closed(node_refs: Column) -> Column:
    """More than two references, the first equal to the last; tested before nodes are looked up."""
    return (F.size(node_refs) > 2) & (F.get(node_refs, F.lit(0)) == F.get(node_refs, F.size(node_refs) - 1))


def resolve(ways: DataFrame, points: DataFrame) -> DataFrame:
    """way_id, shape: the local points of each way in order, missing nodes left out.

    One equi-join on node_id and one grouping by way.  A popular node makes a
    skewed join key on the reference side only, which adaptive execution splits
    because the node side is unique.  A group is the reference list of one
    source record, so its size is bounded by that record."""
    refs = ways.select("way_id", F.posexplode("node_refs").alias("seq", "node_id"))
    placed = refs.join(points, "node_id").select("way_id", F.struct("seq", "x", "y").alias("p"))
    return placed.groupBy("way_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).select(
        "way_id", F.transform("ps", lambda p: shapes.point(p["x"], p["y"])).alias("shape")
    )


def _with_shape(kept: DataFrame, shaped: DataFrame, minimum: int) -> DataFrame:
    """Attach shapes to way rows and drop ways with too few points."""
    return kept.drop("node_refs").join(shaped.where(F.size("shape") >= minimum), "way_id")


_ROAD_WORDS = [word for words in ROAD_VALUES.values() for word in words]


def road_ways(ways: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Ways with a known road class, with all road attributes; still without a shape."""
    chosen = ways.where(tag("highway").isin(_ROAD_WORDS) & F.lit(config.import_roads))
    road = F.col("type")
    return chosen.select("way_id", "node_refs", "tags", classify.road_class(tag("highway")).alias("type")).select(
        "way_id", "node_refs", "type",
        classify.road_width(tag("width"), tag("lanes"), road).alias("width"),
        classify.road_lanes(tag("lanes"), road).alias("lanes"),
        tags.speed_limit(tag("maxspeed")).alias("speed_limit"),
        tags.name_or_empty(tag("name")).alias("name"),
        tags.is_oneway(tag("oneway")).alias("is_oneway"),
        tags.is_marked(tag("bridge")).alias("is_bridge"),
        tags.is_marked(tag("tunnel")).alias("is_tunnel"),
    )


def building_ways(ways: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Closed ways with a building tag of any value, with all building attributes."""
    chosen = ways.where(
        tag("building").isNotNull() & is_closed(F.col("node_refs")) & F.lit(config.import_buildings)
    )
    height = classify.building_height(
        tag("height"), tag("building:levels"), tag("building"),
        config.metres_per_level, config.default_building_height,
    )
    return chosen.select("way_id", "node_refs", "tags", height.alias("height")).select(
        "way_id", "node_refs",
        classify.building_class(tag("building")).alias("type"),
        classify.roof_class(tag("roof:shape"), tag("building:roof:shape")).alias("roof_type"),
        "height",
        classify.building_levels(tag("building:levels"), F.col("height"), config.metres_per_level).alias("levels"),
        tags.name_or_empty(tag("name")).alias("name"),
        tag("roof:colour").alias("roof_color"),
        tag("building:colour").alias("building_color"),
    )


def area_imported(area: Column, config: ImportConfig) -> Column:
    """Whether the import switches let a class of area in."""
    return (
        F.when(area == "Water", F.lit(config.import_water))
        .when(area.isin(NATURAL_AREAS), F.lit(config.import_natural))
        .otherwise(F.lit(config.import_landuse))
    )


def _area_class() -> Column:
    return classify.area_class(tag("natural"), tag("waterway"), tag("leisure"), tag("landuse"), tag("amenity"))


def _is_area(config: ImportConfig) -> Column:
    """Way rows of an area class that the switches let in, closed and without a building tag.

    Class and switches only need a closer look when some switch is off."""
    known = F.lit(False)
    for key, labels in AREA_VALUES.items():
        known = known | F.coalesce(tag(key).isin([w for words in labels.values() for w in words]), F.lit(False))
    chosen = known & tag("building").isNull() & is_closed(F.col("node_refs"))
    if config.import_water and config.import_natural and config.import_landuse:
        return chosen
    return chosen & area_imported(_area_class(), config)


def area_ways(ways: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Area ways with all area attributes; still without a shape."""
    return ways.where(_is_area(config)).select(
        "way_id", "node_refs", _area_class().alias("type"), tags.name_or_empty(tag("name")).alias("name")
    )


def candidate_ways(ways: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Ways that some kind of feature can be made of: the only ones worth resolving.

    Resolving these once serves all three kinds with a single join to the nodes."""
    return ways.where(
        (F.coalesce(tag("highway").isin(_ROAD_WORDS), F.lit(False)) & F.lit(config.import_roads))
        | (tag("building").isNotNull() & is_closed(F.col("node_refs")) & F.lit(config.import_buildings))
        | _is_area(config)
    )


def roads(ways: DataFrame, shaped: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Road rows; ``shaped`` is :func:`resolve` of these ways."""
    found = _with_shape(road_ways(ways, config), shaped, 2)
    if config.simplify_geometry:
        found = simplify(found, "shape", config.simplify_tolerance)
    return found.select(
        F.col("way_id").alias("osm_id"), F.col("shape").alias("polyline"), "type", "width", "lanes",
        "speed_limit", "name", "is_oneway", "is_bridge", "is_tunnel",
    )


def buildings(ways: DataFrame, shaped: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Building rows with counter-clockwise footprints; ``shaped`` is :func:`resolve` of these ways."""
    found = _with_shape(building_ways(ways, config), shaped, 4)
    return _large_enough(found, config).select(
        F.col("way_id").alias("osm_id"), shapes.counter_clockwise(F.col("shape")).alias("footprint"),
        "height", "levels", "type", "roof_type", "name", "roof_color", "building_color",
    )


def areas(ways: DataFrame, shaped: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Area rows with counter-clockwise polygons; ``shaped`` is :func:`resolve` of these ways."""
    found = _with_shape(area_ways(ways, config), shaped, 4)
    return _large_enough(found, config).select(
        F.col("way_id").alias("osm_id"), shapes.counter_clockwise(F.col("shape")).alias("polygon"), "type", "name",
    )


def with_shapes(ways: DataFrame, shaped: DataFrame, config: ImportConfig = ImportConfig()) -> DataFrame:
    """Rows of all kinds of features in one table, made with a single join to the shapes: kind, way_id, shape and the
    columns of each kind (NULL for the others).  Rings are counter-clockwise and large enough; :func:`of_kind` reads it.

    ``shaped`` comes grouped by way, so only the attributes are shuffled for the join."""
    found = None
    for kind, made, least in (("road", road_ways, 2), ("building", building_ways, 4), ("area", area_ways, 4)):
        rows = made(ways, config).drop("node_refs").select(F.lit(kind).alias("kind"), F.lit(least).alias("least"), "*")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    is_road = F.col("kind") == "road"
    met = found.join(shaped, "way_id").where(F.size("shape") >= F.col("least")).drop("least")
    if config.min_area_size is not None:
        met = met.where(is_road | (F.abs(shapes.signed_area(F.col("shape"))) >= F.lit(config.min_area_size)))
    return met.withColumn("shape", F.when(is_road, F.col("shape")).otherwise(shapes.counter_clockwise(F.col("shape"))))


def of_kind(met: DataFrame, kind: str, config: ImportConfig = ImportConfig()) -> DataFrame:
    """The road, building or area rows of :func:`with_shapes`: what :func:`roads`, :func:`buildings` or :func:`areas` gives."""
    rows = met.where(F.col("kind") == kind)
    if kind == "road" and config.simplify_geometry:
        rows = simplify(rows, "shape", config.simplify_tolerance)
    return rows.select(F.col("way_id").alias("osm_id"), F.col("shape").alias(KINDS[kind]), *_COLUMNS[kind])


_COLUMNS = {
    "road": ["type", "width", "lanes", "speed_limit", "name", "is_oneway", "is_bridge", "is_tunnel"],
    "building": ["height", "levels", "type", "roof_type", "name", "roof_color", "building_color"],
    "area": ["type", "name"],
}


def _large_enough(found: DataFrame, config: ImportConfig) -> DataFrame:
    if config.min_area_size is None:
        return found
    return found.where(F.abs(shapes.signed_area(F.col("shape"))) >= F.lit(config.min_area_size))


def nodes_in_bounds(nodes: DataFrame, config: ImportConfig) -> DataFrame:
    """Nodes inside ``filter_bounds``; all of them when it is not set."""
    if config.filter_bounds is None:
        return nodes
    south, west, north, east = config.filter_bounds
    return nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


KINDS = {"road": "polyline", "building": "footprint", "area": "polygon"}


def feature_shapes(
    roads: DataFrame | None = None, buildings: DataFrame | None = None, areas: DataFrame | None = None
) -> DataFrame:
    """kind, osm_id, type, shape of all given features."""
    parts = [
        df.select(F.lit(kind).alias("kind"), "osm_id", "type", F.col(KINDS[kind]).alias("shape"))
        for kind, df in (("road", roads), ("building", buildings), ("area", areas))
        if df is not None
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


def count_by_type(features: DataFrame) -> DataFrame:
    return features.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def sample_features(features: DataFrame, shape: str, n: int = 5) -> DataFrame:
    """The first ``n`` features by id with their number of points."""
    kept = [c for c in features.columns if c != shape]
    return features.orderBy("osm_id").limit(n).select(*kept, F.size(shape).alias("points"))
