"""Tables kept by tile in parquet and fetched by tile.

One folder per tile would mean more folders than files can bear on a large map,
so ``span`` x ``span`` tiles share a folder.  Inside, rows are sorted by tile,
so the row-group statistics skip the other tiles of the folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def block(tile: Column, span: int) -> Column:
    """The folder key of a tile key."""
    return F.floor(tile / F.lit(float(span))).cast("int")


def write_tiles(df: DataFrame, path: str, span: int = 16, mode: str = "overwrite") -> None:
    """Store a table with columns ``tx, ty``.

    The rebalance hint gathers a folder in few files and lets adaptive
    execution split a folder that holds too much of the data."""
    keyed = df.withColumn("px", block(F.col("tx"), span)).withColumn("py", block(F.col("ty"), span))
    (
        keyed.hint("rebalance", F.col("px"), F.col("py"))
        .sortWithinPartitions("px", "py", "tx", "ty")
        .write.mode(mode)
        .partitionBy("px", "py")
        .parquet(path)
    )


def read_keys(spark: SparkSession, path: str, keys: DataFrame, span: int = 16, schema: StructType | None = None) -> DataFrame:
    """Fetch the tiles of a small table of keys (``tx, ty``).

    The folder keys are part of the join, so Spark prunes folders while it runs.  With the ``schema`` of what was stored
    (without the folder keys) a store of no rows, which has no files, is read as well."""
    wanted = keys.select("tx", "ty", block(F.col("tx"), span).alias("px"), block(F.col("ty"), span).alias("py"))
    rows = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, *wanted.select("px", "py").schema.fields]))
    return rows.parquet(path).join(wanted, ["px", "py", "tx", "ty"], "left_semi").drop("px", "py")


def read_tiles(
    spark: SparkSession, path: str, span: int = 16,
    x_range: tuple[int, int] | None = None, y_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Fetch a stored table, or only the tiles of an inclusive key range."""
    df = spark.read.parquet(path)
    for tile, folder, limits in (("tx", "px", x_range), ("ty", "py", y_range)):
        if limits is not None:
            low, high = limits
            df = df.where(F.col(folder).between(low // span, high // span) & F.col(tile).between(low, high))
    return df.drop("px", "py")


def stored_or_none(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A stored table, or None where nothing has been stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
