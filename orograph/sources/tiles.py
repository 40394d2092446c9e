"""Stored tiles: a table by zoom, its files along the Z-order curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["z", "x", "y"]


def write(tiles: DataFrame, path: str) -> None:
    """Append tiles (z, code and any others); neighbours on the curve share files."""
    tiles.repartitionByRange("z", "code").sortWithinPartitions("z", "code").write.mode("append").partitionBy("z").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("z", F.col("z").cast("long"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was ever stored there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def missing(tiles: DataFrame, path: str) -> DataFrame:
    """The tiles that aren't stored yet, each once; only keys of the zooms that are asked for are read."""
    tiles = tiles.dropDuplicates(KEY)
    if not exists(tiles.sparkSession, path):
        return tiles
    return tiles.join(read(tiles.sparkSession, path).select(*KEY), KEY, "left_anti")
