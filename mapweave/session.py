"""Session settings for local work, and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


# The JVM does not turn methods above 8000 bytes into machine code.  With this limit
# Spark compiles such a stage operator by operator instead, which is many times
# faster for the long arithmetic of masks and rasters.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
DEFAULTS = {"spark.sql.codegen.hugeMethodLimit": "65535"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators are made for where the session still has Spark's own defaults."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key) == DEFAULTS[key]:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark.  On a cluster, use the session it gives you."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mapweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A session of one machine (master ``local``) without that setting gets a new folder, removed when the
    program ends; any other session has to name one that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    one_machine = master == "local" or master.startswith("local[")
    if folder:
        return folder
    if not one_machine:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="mapweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/mapweave/{name}-{uuid.uuid4().hex}"


def set_aside(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder once and read back from there; what made them is forgotten."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
