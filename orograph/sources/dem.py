"""Raster files as a data source: a row for each block of pixels, with filters pushed to the reader.

A partition is a run of small files or a share of the blocks of a large one;
planning lists files and opens none. A task reads the headers of its files,
keeps the blocks that the pushed filters let pass, and reads only those blocks'
bytes, or none at all if no column needs pixels.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from orograph.sources import files, geotiff

#: Bytes of files that a partition stands for.
SPLIT_BYTES = 64 << 20
#: Pixels on a side of a tile, which give a level its zoom.
PIXELS = 256

#: What a header tells of a block; filters on these are pushed. ``z`` is the finest zoom whose tiles have pixels as coarse as the
#: level's, ``x_first`` to ``y_last`` (from the north) the tiles there that the block meets.
PLACE = {
    "path": "string",
    **dict.fromkeys(("level", "block", "row", "col", "rows", "columns", "z", "x_first", "x_last", "y_first", "y_last"), "long"),
    **dict.fromkeys(("left", "bottom", "right", "top", "pixel_x", "pixel_y"), "double"),
}
#: By rows, null without data; and why a file or a block can't be read.
CONTENT = {"heights": "array<double>", "error": "string"}
COLUMNS = PLACE | CONTENT
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
_BATCH_PIXELS = 1 << 19

_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


@dataclass
class Share(InputPartition):
    """Files of a partition; of each, share ``part`` of ``of`` of the blocks of each level."""

    paths: list[str]
    part: int = 0
    of: int = 1


def block_places(h: dict) -> dict[str, np.ndarray]:
    """The columns of ``PLACE`` (without the path) of all blocks of a level."""
    across, down = -(-h["width"] // h["block_width"]), -(-h["height"] // h["block_height"])
    block = np.arange(across * down)
    row, col = block // across * h["block_height"], block % across * h["block_width"]
    rows, columns = np.minimum(h["block_height"], h["height"] - row), np.minimum(h["block_width"], h["width"] - col)
    left, top = h["left"] + col * h["pixel_x"], h["top"] - row * h["pixel_y"]
    right, bottom = h["left"] + (col + columns) * h["pixel_x"], h["top"] - (row + rows) * h["pixel_y"]
    z = max(0, math.floor(math.log2(180.0 / PIXELS / h["pixel_x"]) + 1e-9))
    width = 180.0 / 2.0**z
    tile = lambda a, last: np.clip(np.floor(a / width), 0, last).astype(np.int64)
    nudge = 1e-11
    out = {"block": block, "row": row, "col": col, "rows": rows, "columns": columns, "left": left, "bottom": bottom, "right": right, "top": top}
    out |= {"x_first": tile(left + nudge + 180.0, 2 ** (z + 1) - 1), "x_last": tile(right - nudge + 180.0, 2 ** (z + 1) - 1)}
    out |= {"y_first": tile(90.0 - top + nudge, 2**z - 1), "y_last": tile(90.0 - bottom - nudge, 2**z - 1)}
    return out | {k: np.full(len(block), v) for k, v in (("level", h["level"]), ("z", z), ("pixel_x", h["pixel_x"]), ("pixel_y", h["pixel_y"]))}


class DemReader(DataSourceReader):
    def __init__(self, root: str, split: int, schema: StructType):
        self.root, self.split = root, split
        self.types = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in schema}
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a block's place with values are done here, all others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PLACE and (type(f) in _COMPARE or isinstance(f, In | IsNotNull)):
                self.filters.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def _passes(self, column: str, values: np.ndarray) -> np.ndarray:
        keep = np.ones(len(values), bool)
        for name, kind, wanted in self.filters:
            if name == column and kind is not IsNotNull:
                keep &= np.isin(values, list(wanted)) if kind is In else _COMPARE[kind](values, wanted)
        return keep

    def _told(self, **row: object) -> Iterator[dict]:
        """A row that has some places only, unless a filter asks for others."""
        if all(c in row and self._passes(c, np.array([row[c]], object))[0] for c, _, _ in self.filters):
            yield row

    def partitions(self) -> Sequence[InputPartition]:
        system, at = files.locate(self.root)
        found = system.get_file_info(at)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        listed = sorted((f.path, f.size) for f in listed if f.is_file and f.size and re.search(r"(?i)\.tiff?$", f.path))
        if listed:
            keep = self._passes("path", np.array([p for p, _ in listed], object))
            listed = [f for f, k in zip(listed, keep, strict=True) if k]
        out, run, held = [], [], 0
        for path, size in listed:
            if size > self.split:
                of = -(-size // self.split)
                out += [Share([path], part, of) for part in range(of)]
                continue
            if run and held + size > self.split:
                out.append(Share(run))
                run, held = [], 0
            run.append(path)
            held += size
        return [*out, Share(run)] if run or not out else out

    def chosen(self, h: dict, part: int, of: int) -> dict[str, np.ndarray]:
        """The places of a level's blocks that are in the share, stored in the file and let pass."""
        places = block_places(h)
        n = len(places["block"])
        keep = (places["block"] * of // max(1, n) == part) & (np.array(h["sizes"][:n]) > 0)
        for c, values in places.items():
            keep &= self._passes(c, values)
        return {c: v[keep] for c, v in places.items()}

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _ARROW[t]) for c, t in self.types.items()])
        pixels = not set(CONTENT).isdisjoint(self.types)
        rows, held = [], 0
        for path in partition.paths:
            for row in self._file(path, partition, pixels):
                rows.append({c: row.get(c) for c in self.types})
                held += len(row.get("heights") or ()) + 64
                if held > _BATCH_PIXELS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _file(self, path: str, share: Share, pixels: bool) -> Iterator[dict]:
        try:
            levels = geotiff.header(path)
        except (OSError, KeyError, ValueError, struct.error) as e:
            if share.part == 0:
                yield from self._told(path=path, error=f"{type(e).__name__}: {e}")
            return
        system, at = files.locate(path)
        with system.open_input_file(at) as source:
            for h in levels:
                if h.get("crs") is not None:
                    h = h | {"error": h.get("error", "blocks of projected files have no box in degrees; tile_vertices reads them")}
                if h.get("error") or "left" not in h or "pixel_x" not in h:
                    if share.part == 0:
                        yield from self._told(path=path, level=h["level"], error=h.get("error", "the file doesn't say where it lies"))
                    continue
                places = self.chosen(h, share.part, share.of)
                for values in zip(*places.values(), strict=True):
                    row = {"path": path} | {c: v.item() for c, v in zip(places, values, strict=True)}
                    yield row | (self._content(source, h, row) if pixels else {})

    def _content(self, source: pa.NativeFile, h: dict, row: dict) -> dict:
        try:
            source.seek(h["offsets"][row["block"]])
            grid = geotiff.decode(source.read(h["sizes"][row["block"]]), h)[: row["rows"], : row["columns"]]
        except (OSError, ValueError, zlib.error, zstandard.ZstdError) as e:
            return {"error": f"{type(e).__name__}: {e}"}
        empty = np.isnan(grid) if h.get("nodata") is None else np.isnan(grid) | (grid == h["nodata"])
        return {"heights": pa.array(grid.ravel(), pa.float64(), mask=empty.ravel()).to_pylist()}


class DemSource(DataSource):
    """``format("dem")``: the .tif or .tiff files under a path (or one file), a row for each block of each level.

    A schema of some of ``COLUMNS`` limits what is read: without ``heights`` and
    ``error`` no pixels are. Option ``split_bytes`` sets what a partition
    holds. Filters reach the reader where spark.sql.python.filterPushdown.enabled
    is set. A file or level that can't be read gives one row with ``error`` and
    nulls; blocks that a file leaves out give none.
    """

    @classmethod
    def name(cls) -> str:
        return "dem"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

    def reader(self, schema: StructType) -> DemReader:
        return DemReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), schema)


def register(spark: SparkSession) -> None:
    """Make ``format("dem")`` known to a session, and let filters reach Python sources there."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DemSource)


def pixels(blocks: DataFrame) -> DataFrame:
    """The blocks' columns but for the heights, with row, col (in the level), lon, lat (of the pixel's centre) and h of every pixel that has data."""
    rest = [c for c in blocks.columns if c not in ("row", "col", "columns", "heights")]
    each = blocks.select(*rest, "columns", F.col("row").alias("_r"), F.col("col").alias("_c"), F.posexplode("heights").alias("_i", "h")).where("h is not null")
    each = each.withColumns({"_j": F.expr("_i div columns"), "_i": F.expr("_i % columns")})
    at = {"row": F.col("_r") + F.col("_j"), "col": F.col("_c") + F.col("_i")}
    at |= {"lon": F.col("left") + (F.col("_i") + 0.5) * F.col("pixel_x"), "lat": F.col("top") - (F.col("_j") + 0.5) * F.col("pixel_y")}
    return each.withColumns(at).select(*rest, *at, "h")


def scan(spark: SparkSession, path: str, *, columns: Sequence[str] = tuple(COLUMNS), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The blocks of the raster files under a path, with the given columns.

    Spark 4.1 keeps one Python reader for each relation, with the filters that
    were pushed last. A scan can be used again in other queries, but within one
    query each set of filters needs a scan of its own.
    """
    register(spark)
    found = spark.read.format("dem").schema(", ".join(f"{c} {COLUMNS[c]}" for c in dict.fromkeys(["path", *columns]))).option("split_bytes", split_bytes).load(path)
    # holds for every row; with it, filters of an earlier query are never left in the reader of one without
    return found.where("path is not null").select(*columns)
