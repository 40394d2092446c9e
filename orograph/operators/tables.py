"""Tables in the folder that all executors share: for what several steps read, and what has to outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orograph-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read back: for what several steps read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str, each: int) -> DataFrame:
    """``rows`` dealt by keys to tasks of about ``each`` rows: what is made of them is far larger than they are, so Spark can't tell."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)
