"""What the text operators share: scratch tables, global numbering, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_U = np.uint64


def scratch_root(spark: SparkSession) -> str:
    """The application's folder for scratch tables under spark.checkpoint.dir; where that is unset, a temporary one, in local mode only.

    The tables stay until the application's folder is deleted: a result reads them when it is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/orograph-{spark.sparkContext.applicationId}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and fixes
    whatever depends on the physical plan (partition numbers, generated ids).
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run within read and hand Python ``rows`` rows at once: where a row is large, a task holds few of them."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, rows)
    try:
        yield
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again: all that was made from them is in files of its own.

    Spark removes the shuffle files of finished jobs when the driver collects garbage, so that is asked for too.
    """
    spark = tables[0].sparkSession
    spark._jvm.System.gc()
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, *, rows: int = 200_000) -> DataFrame:
    """``df``, marked for a broadcast join if it has at most ``rows`` rows; it is counted, so it should be a scratch table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def number_rows(df: DataFrame, order: Sequence[str], *, scope: Sequence[str] = (), spread: Sequence[str] = ()) -> DataFrame:
    """Add ``_row`` (0-based, gapless, within ``scope``) in the order ``scope + order``.

    Rows are range-partitioned on ``scope + (spread or order)``, numbered inside
    their partition and shifted by prefix sums of the partition counts, so a
    scope that holds a third of all rows is still spread over many tasks.
    ``_part`` and the scratch table's columns stay in the result.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*scope, *(spread or order)]
    parts = scratch(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part", *scope).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *scope, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part", *scope).orderBy(*order)
    numbered = parts.withColumn("_local", F.row_number().over(here) - 1)
    same = [numbered[c].eqNullSafe(offsets[c]) for c in ("_part", *scope)]
    joined = numbered.join(F.broadcast(offsets) if not scope else offsets, same)
    return joined.select(*[numbered[c] for c in parts.columns], (numbered["_local"] + offsets["_before"]).alias("_row"))


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def each_text(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    for x in batch.column(column):
        yield x.as_py() or b""


def fmix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` consecutive words; a shorter text is one run, an empty one has none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ (total >> _U(29))) * _ODD[i % 5] + hashes[i : n - k + 1 + i]
    return fmix(total)
