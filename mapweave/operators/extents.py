"""Geographic bounds, origin and statistics of a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy


def bounds(nodes: DataFrame) -> DataFrame:
    """One row with the box of all nodes, tagged or not; no row when there are none."""
    return nodes.agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    ).where(F.col("min_lat").isNotNull() & F.col("min_lon").isNotNull())


def box_measures(box: DataFrame) -> DataFrame:
    """Centre and size in metres of a box, by metres per degree at the middle latitude."""
    mid_lat = (F.col("min_lat") + F.col("max_lat")) / F.lit(2.0)
    mid_lon = (F.col("min_lon") + F.col("max_lon")) / F.lit(2.0)
    return box.select(
        "*",
        mid_lat.alias("center_lat"),
        mid_lon.alias("center_lon"),
        ((F.col("max_lon") - F.col("min_lon")) * geodesy.metres_per_degree_lon(mid_lat)).alias("width_m"),
        ((F.col("max_lat") - F.col("min_lat")) * geodesy.metres_per_degree_lat()).alias("height_m"),
        ((F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lon") <= F.col("max_lon"))).alias("is_valid"),
    )


def origin(box: DataFrame) -> DataFrame:
    """Local origin: the middle of the box in degrees, also given in Mercator metres."""
    return box_measures(box).where("is_valid").select(
        F.col("center_lat").alias("origin_lat"),
        F.col("center_lon").alias("origin_lon"),
        geodesy.mercator_x(F.col("center_lon")).alias("origin_x"),
        geodesy.mercator_y(F.col("center_lat")).alias("origin_y"),
    )


def statistics(raw: dict[str, DataFrame], features: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: ``total_<kind>`` of raw elements, ``processed_<kind>`` of features.

    The counts are taken side by side and pivoted by aggregation, so no join is needed."""
    named = [(f"total_{k}", df) for k, df in raw.items()] + [(f"processed_{k}", df) for k, df in features.items()]
    counted = None
    for name, df in named:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name, _ in named])
