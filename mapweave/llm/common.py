"""Small helpers shared by the operators."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.session import scratch_path

TOKENIZER_FOLDER = os.environ.get("MAPWEAVE_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; a path is taken as it is."""
    if os.path.sep in name:
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join(TOKENIZER_FOLDER, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut, and a lost executor loses nothing.

    The collection afterwards lets Spark's cleaner drop the shuffle files of the finished job, which otherwise stay
    until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


# Spark deletes a job's shuffle files when it ends, and gives Python this many bytes at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Like stored(), but Spark itself deletes the shuffle files when the job ends, and with a folder per value of ``by``."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing will read again."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remainder(key: str, by: int) -> F.Column:
    """crc32 of the key's text modulo a number; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def row_key() -> F.Column:
    """A number per (doc_id, text); rows that repeat both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


SLOTS = 1 << 24


def slots_of(values: DataFrame, column: str, slots: int = SLOTS) -> np.ndarray:
    """One bit per slot that a value (long) of the column falls in: slots / 8 bytes on the driver, whatever the input."""
    place = values.select((F.pmod(F.col(column), F.lit(slots)) + 1).alias("s"))
    rows = place.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(max(slots // 8, 4096), np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_slots(bits: np.ndarray, values: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Whether each value (int64 or uint64) may be one of those the bits were made of."""
    s = values.view(np.int64) & (slots - 1)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
