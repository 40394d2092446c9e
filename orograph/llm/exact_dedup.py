"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. The distinct blocks
are sorted and get integer names; then adjacent pairs of names get names, and
so on, until each text has one name. Two texts have the same (level, name)
exactly when their bytes are the same: no step trusts a hash.

A block's 128-bit key only routes it to its name. Should two different blocks
share a key, those blocks are named and joined by their contents instead.

Defined results: null text counts as empty; empty texts are equal to each
other; rows with the same doc_id and text each count in ``group_size`` and one
of them stays; a null doc_id sorts after all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import each_text, scratch, utf8

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_ROW = ("doc_id", "sha")


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    return _SPACES.sub(b" ", text)


def _squeeze_fast(text: bytes) -> bytes:
    words = text.split()  # of bytes: at ASCII white space only
    if not words:
        return b" " if text else b""
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text)), size)]


def _key(block: bytes, key_bytes: int) -> bytes:
    return xxhash.xxh3_128_digest(block)[:key_bytes]


def _references(size: int, key_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("keys", pa.list_(pa.binary()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, keys = [], []
            for text in map(_squeeze_fast, each_text(b)):
                sha.append(hashlib.sha256(text).digest())
                keys.append([_key(x, key_bytes) for x in _blocks(text, size)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sha, pa.binary()), pa.array(keys, pa.list_(pa.binary()))], schema=schema)

    return run


def _contents(size: int, key_bytes: int):
    schema = pa.schema([("key", pa.binary()), ("block", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = [x for text in map(_squeeze_fast, each_text(b)) for x in _blocks(text, size)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x, key_bytes) for x in blocks], pa.binary()), pa.array(blocks, pa.binary())], schema=schema)

    return run


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names, in sorted order within each partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(texts: DataFrame, refs: DataFrame, size: int, key_bytes: int) -> DataFrame:
    """(doc_id, sha, copies, blocks, pos, name) of every block."""
    blocks = texts.mapInArrow(_contents(size, key_bytes), "key binary, block binary").distinct()
    names = scratch(_named(blocks, "key", "block").drop("block"), "block-names")
    places = refs.select(*_ROW, "copies", F.size("keys").alias("blocks"), F.posexplode("keys").alias("pos", "key"))
    clashes = names.groupBy("key").count().where("count > 1").select("key")
    if clashes.isEmpty():
        return places.join(names, "key").drop("key")
    clashes = scratch(clashes, "clashes")
    sure = places.join(clashes, "key", "left_anti").join(names, "key").drop("key")
    by_content = (
        texts.mapInArrow(_placed_contents(size, key_bytes), "doc_id long, sha binary, pos int, key binary, block binary")
        .join(clashes, "key", "left_semi")
        .distinct()
    )
    renamed = scratch(_named(by_content.select("block").distinct(), "block").withColumn("name", -1 - F.col("name")), "clash-names")
    sizes = refs.select(F.col("doc_id").alias("_doc"), F.col("sha").alias("_sha"), "copies", F.size("keys").alias("blocks"))
    rest = by_content.join(renamed, "block").join(sizes, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("sha") == F.col("_sha")))
    return sure.unionByName(rest.select(*_ROW, "copies", "blocks", "pos", "name"))


def _placed_contents(size: int, key_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("pos", pa.int32()), ("key", pa.binary()), ("block", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (d.as_py(), hashlib.sha256(text).digest(), i, _key(x, key_bytes), x)
                for d, text in zip(b.column("doc_id"), map(_squeeze_fast, each_text(b)), strict=True)
                for i, x in enumerate(_blocks(text, size))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema, strict=True)], schema=schema)

    return run


def name_documents(docs: DataFrame, *, block_bytes: int = 4096, key_bytes: int = 16) -> DataFrame:
    """(doc_id, sha, copies, level, name): one row for each distinct (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    refs = texts.mapInArrow(_references(block_bytes, key_bytes), "doc_id long, sha binary, keys array<binary>")
    refs = scratch(refs.groupBy(*_ROW).agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")), "texts")
    current = scratch(_first_names(texts, refs, block_bytes, key_bytes), "names-0")
    longest = refs.agg(F.max(F.size("keys"))).first()[0] or 1
    done = [current.where("blocks = 1").select(*_ROW, "copies", F.lit(0).alias("level"), "name")]
    for level in range(1, (longest - 1).bit_length() + 1):
        left, right = (F.max(F.when(F.col("pos") % 2 == i, F.col("name"))) for i in (0, 1))
        pairs = (
            current.where("blocks > 1")
            .groupBy(*_ROW, "copies", F.expr("(blocks + 1) div 2").cast("int").alias("blocks"), F.expr("pos div 2").cast("int").alias("pos"))
            .agg(left.alias("a"), F.struct(right.alias("name")).alias("b"))
        )
        pairs = scratch(pairs.select(*_ROW, "copies", "blocks", "pos", "a", F.col("b.name").isNull().alias("alone"), F.coalesce("b.name", F.lit(0)).alias("b")), f"pairs-{level}")
        names = scratch(_named(pairs.select("a", "b", "alone").distinct(), "a", "b", "alone"), f"pair-names-{level}")
        current = scratch(pairs.join(names, ["a", "b", "alone"]).select(*_ROW, "copies", "blocks", "pos", "name"), f"names-{level}")
        done.append(current.where("blocks = 1").select(*_ROW, "copies", F.lit(level).alias("level"), "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, *, block_bytes: int = 4096, key_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = name_documents(docs, block_bytes=block_bytes, key_bytes=key_bytes)
    groups = named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # a table of its own, so that the join can split a name that very many documents share
    rows = named.join(scratch(groups, "groups"), ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
