"""From raw documents to mixed, balanced shards: the stages and how to run them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.llm import decontamination, mixing, near_dedup, quality, sharding
from orograph.llm.common import scratch, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def _rows(docs: DataFrame) -> DataFrame:
    """The documents' columns and ``row``: a number for each row, in the order of the files and of the rows within them.

    doc_id may be null or repeated; this key is neither, and is the same however often the files are read.
    """
    place = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    files = place.select("_path").distinct()  # one row for each file
    files = files.withColumn("_file", F.row_number().over(Window.orderBy("_path")).cast("long"))
    return place.join(small(files), "_path").select(*COLUMNS, F.shiftleft("_file", 40).bitwiseOR(F.col("_index")).alias("row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; null text counts as empty, each row is scored by itself."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model, threshold=0.3)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: that with the smallest doc_id, of these the first in the files.

    Rows are told apart by their place: rows that share a doc_id, or have none,
    are compared by their texts like any others; a null doc_id comes last. Rows
    without words are in no group and stay.
    """
    rows = _rows(docs)
    classes = near_dedup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    classes = scratch(classes.select(F.col("doc_id").alias("row"), "component_id"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = rows.select("row", "doc_id").join(classes, "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a benchmark item; each row is judged by its own text, whatever its doc_id."""
    rows = _rows(docs)
    leaks = decontamination.find_leaks(rows.select(F.col("row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(leaks.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all rows into the order of the mix; the files written from this keep it. A null source is a source."""
    rows = _rows(docs)
    mixed = mixing.mix_positions(rows, key=["doc_id", "row"])
    return rows.join(mixed.select("row", "position"), "row").orderBy("position").select(*COLUMNS)


def shard_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the mix, in its order, into shards of near equal bytes: all rows with size, shard and slot."""
    rows = _rows(docs)
    cut = sharding.cut(rows.select("row", sharding.text_size(F.col("text")).alias("size")), ["row"], shards=SHARDS)
    return rows.join(cut, "row").select(*COLUMNS, "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard_mix", shard_mix),
]

#: A trained classifier has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
