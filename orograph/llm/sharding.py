"""Contiguous shards of near equal size, cut from global byte prefix sums.

Rows are range-partitioned in the chosen order. Each partition sums its sizes,
prefix sums of those totals give every row its place in the corpus's bytes, and
cuts at equal targets give the shards. Only DataFrame operations are used.

Defined results: a null text has no bytes and counts as equal to an empty one;
every row, repeated ones too, gets a shard and a slot of its own; an empty
table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.llm.common import scratch, utf8


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def cut(rows: DataFrame, order: Sequence[str], *, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with a ``size``, contiguous in ``order``.

    A row goes where its middle byte lies, so a shard misses its target by half
    of the rows that lie on its two cuts. The same rule holds for every row.
    """
    rows = scratch(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 1
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_from"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_end", F.sum("size").over(so_far)).withColumn("_local", F.row_number().over(so_far) - 1)
    placed = placed.join(F.broadcast(offsets), "_part")
    middle = 2 * (F.col("_from") + F.col("_end")) - F.col("size")
    # the quotient first, so that nothing overflows at any corpus size
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int"))
    placed = placed.withColumn("shard", shard).withColumn("_row", F.col("_first") + F.col("_local"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_shard_first"))  # one row for each shard
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_row") - F.col("_shard_first"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def shard_documents(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; copies of a text lie side by side, in one shard but where a cut falls among them."""
    text = utf8(F.col("text"))
    rows = docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = cut(rows, ["text_hash", "text_crc32", "size", "doc_id"], shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
