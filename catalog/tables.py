"""Map tables made by formula from the given tables (see FIXTURES.md).

`part` gives the nodes, `orders` the ways; both grow with the data.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mapweave.functions.columns import one_row
from mapweave.operators import features
from mapweave.plans.importing import MapTables, import_map
from mapweave.session import scratch_path

_DX = [0, 2, 3, 3, 1, -1, -1]
_DY = [0, 0, 1, 3, 4, 3, 1]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A street grid of 40 columns; every fifth column group has ends a metre or two apart."""
    return _table(spark, sf_dir, "part").selectExpr(
        "p_partkey as node_id",
        "525e-1 + (p_partkey div 40) * 5e-4 as lat",
        "134e-1 + (p_partkey % 40 - greatest(p_partkey % 5 - 2, 0)) * 7e-4 + greatest(p_partkey % 5 - 2, 0) * 14e-6 as lon",
        "cast(map() as map<string,string>) as tags",
    )


def _pick(values: list[str | None], index: str) -> str:
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"get(array({listed}), cast({index} as int))"


_ROAD = [
    "motorway", "motorway_link", "trunk", "primary", "secondary_link", "tertiary", "residential", "living_street",
    "service", "footway", "pedestrian", "steps", "cycleway", "path", "track", "bridleway", "unclassified", "construction",
]
_BUILDING = [
    "yes", "residential", "commercial", "industrial", "retail", "office", "apartments", "dormitory", "house",
    "detached", "bungalow", "garage", "carport", "shed", "hut", "cathedral", "mosque", "university", "clinic",
    "warehouse", "no", "castle",
]
_LANDUSE = ["forest", "retail", "meadow", "vineyard", "cemetery", "reservoir", "industrial", "residential", "quarry"]
_COLOUR = [None, "Red", "#abc", "#A1B2C3", "zzz"]

_TAGS = {
    "name": "case when k % 3 = 0 then concat('way ', k) end",
    "highway": f"case when k % 5 < 2 then {_pick(_ROAD, '(k div 5) % 18')} when k % 10 = 9 then 'residential' end",
    "building": f"case when k % 5 = 2 then {_pick(_BUILDING, '(k div 5) % 22')} when k % 10 = 9 then 'no' end",
    "natural": f"case when k % 5 = 3 and (k div 5) % 5 = 0 then {_pick(['water', 'wood', 'scrub', 'peak'], '(k div 25) % 4')} end",
    "waterway": f"case when k % 5 = 3 and (k div 5) % 5 < 2 then {_pick(['riverbank', 'river'], '(k div 25) % 2')} end",
    "leisure": f"case when k % 5 = 3 and (k div 5) % 5 = 2 then {_pick(['park', 'garden', 'pitch'], '(k div 25) % 3')} end",
    "landuse": f"case when (k % 5 = 3 and (k div 5) % 5 in (2, 3)) or k % 25 = 2 then {_pick(_LANDUSE, '(k div 25) % 9')} end",
    "amenity": "case when k % 5 = 3 and (k div 5) % 5 = 4 then 'parking' end",
    "lanes": f"case when k % 5 < 2 then {_pick([None, '2', '3;4', 'x', None], '(k div 7) % 5')} end",
    "width": f"case when k % 5 < 2 then {_pick([None, None, '7.5', '12 m', ' 9', 'wide'], '(k div 11) % 6')} end",
    "maxspeed": f"case when k % 5 < 2 then {_pick(['50', '30 mph', 'walk', None], '(k div 13) % 4')} end",
    "oneway": f"case when k % 5 < 2 then {_pick(['yes', '1', '-1', 'no', None], '(k div 3) % 5')} end",
    "bridge": f"case when k % 5 < 2 then {_pick([None, None, 'yes', 'no'], '(k div 17) % 4')} end",
    "tunnel": f"case when k % 5 < 2 then {_pick([None, None, None, 'yes', 'no'], '(k div 19) % 5')} end",
    "height": f"case when k % 5 = 2 then {_pick([None, '12 m', '12.5m', ' 9', 'tall', '30M'], '(k div 7) % 6')} end",
    "building:levels": f"case when k % 5 = 2 then {_pick([None, '4', '2.5', 'n/a'], '(k div 11) % 4')} end",
    "roof:shape": f"case when k % 5 = 2 then {_pick([None, 'flat', 'gabled', 'hip', 'pyramidal', 'lean_to', 'onion', 'mansard'], '(k div 13) % 8')} end",
    "building:colour": f"case when k % 5 = 2 then {_pick(_COLOUR, '(k div 5) % 5')} end",
    "roof:colour": f"case when k % 5 = 2 then {_pick(_COLOUR, '(k div 17) % 5')} end",
}


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of 3 to 7 points around an anchor node; some closed, some reversed, some with lost nodes."""
    parts = _table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("count"))
    keyed = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), one_row(parts)["count"].alias("parts"))
    offsets = ", ".join(f"{40 * dy + dx}" for dx, dy in zip(_DX, _DY))
    outline = keyed.selectExpr(
        "k",
        f"transform(slice(array({offsets}), 1, cast(3 + k % 5 as int)), o -> (k * 17) % parts + o) as outline",
    )
    turned = outline.selectExpr("k", "if(k % 10 >= 5, reverse(outline), outline) as refs")
    closed = "k % 5 in (2, 3, 4) and k % 11 <> 0"
    # A NULL value stands for an absent tag: a plain map lets a lookup fold to its one rule.
    tags = "map({}) as tags".format(
        ", ".join(f"'{key}', {rule}" for key, rule in _TAGS.items())
    )
    return turned.selectExpr(
        "k as way_id", f"if({closed}, concat(refs, slice(refs, 1, 1)), refs) as node_refs", tags
    )


_STORED: dict[tuple[str, str, str], str] = {}
_SCHEMA: dict[tuple[str, str, str], StructType] = {}
_IMPORTED: dict[tuple[str, str], MapTables] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make, *by: str) -> DataFrame:
    """A derived table, computed by Spark once per application and kept as parquet in the shared folder (with a folder per
    value of ``by``)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        made = make()
        made.write.partitionBy(*by).parquet(path)
        _SCHEMA[key] = made.schema
        _STORED[key] = path
    return spark.read.schema(_SCHEMA[key]).parquet(_STORED[key])


def imported(spark: SparkSession, sf_dir: str) -> MapTables:
    """The whole map: nodes and ways stored, then resolved and stored as features of all kinds in one job."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _IMPORTED:
        _IMPORTED[key] = _import(spark, sf_dir)
    return _IMPORTED[key]


def _import(spark: SparkSession, sf_dir: str) -> MapTables:
    ways = way_table(spark, sf_dir)
    lazy = import_map(node_table(spark, sf_dir), ways)
    met = stored(spark, sf_dir, "features", lambda: features.with_shapes(ways, lazy.shaped), "kind")
    return replace(lazy, **{f"{kind}s": features.of_kind(met, kind) for kind in features.KINDS})


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "nodes", lambda: nodes(spark, sf_dir))


def way_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "ways", lambda: ways(spark, sf_dir))
