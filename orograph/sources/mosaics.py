"""Mosaic files: one JSON object with a path, an extent and its datasets in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators import catalog, raster
from orograph.sources import files, geotiff

SCHEMA = "path string, extent array<double>, datasets array<struct<path: string, extent: array<double>>>"
#: A mosaic is one object, so its datasets are bounded; keep larger catalogs as tables.
MOST = 100_000


def write(extents: DataFrame, root: str, name: str, path: str) -> None:
    """Write datasets (ordinal, name and box) as the mosaic ``name`` under the root; fails beyond MOST of them."""
    n = extents.count()
    if n > MOST:
        raise ValueError(f"{n} datasets are too many for one mosaic file ({MOST}); keep the catalog as a table")
    item = F.struct("ordinal", F.col("name").alias("path"), F.array(*catalog.BOX).alias("extent"))
    held = extents.agg(F.sort_array(F.collect_list(item)).alias("d"))
    whole = catalog.extent(extents).select(F.array(*catalog.BOX).alias("extent"))
    doc = F.to_json(F.struct(F.lit(path).alias("path"), "extent", F.expr("transform(d, e -> struct(e.path as path, e.extent as extent))").alias("datasets")))
    files.write(whole.join(held).select(F.lit(name).alias("name"), doc.cast("binary").alias("data")), root)


def read(spark: SparkSession, path: str) -> DataFrame:
    """mosaic, ordinal, name and box of each dataset of the mosaic files under a path; a broken file raises."""
    docs = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = docs.select(F.col("path").alias("mosaic"), F.posexplode("datasets").alias("ordinal", "d"))
    return rows.select("mosaic", F.col("ordinal").cast("long").alias("ordinal"), F.col("d.path").alias("name"), *(F.col("d.extent")[i].alias(c) for i, c in enumerate(catalog.BOX)))


def build(found: DataFrame, *, extent: str = "metadata", folder: str | None = None) -> DataFrame:
    """path, name and box of each raster file of ``found`` (headers): what a mosaic lists.

    ``extent`` is "metadata" (the header's box, which reads no pixel) or "valid"
    (the box of the pixels that have data; a file without any is left out).
    ``folder`` takes the place of the files' own folder in ``name``.
    """
    boxes = geotiff.box(found.where("error is null and level = 0"))
    name = F.col("path") if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract("path", r"([^/]*)$", 1))
    if extent == "metadata":
        return boxes.select("path", name.alias("name"), *catalog.BOX)
    if extent != "valid":
        raise ValueError(f"unknown extent {extent!r}")
    ends = raster.valid_extent(geotiff.pixels(found.where("level = 0")), ["path"], F.lit(True))
    rows = boxes.select("path", "left", "top", "pixel_x", "pixel_y").join(ends, "path")
    left, top = F.col("left") + F.col("min_col") * F.col("pixel_x"), F.col("top") - F.col("min_row") * F.col("pixel_y")
    right, bottom = F.col("left") + (F.col("max_col") + 1) * F.col("pixel_x"), F.col("top") - (F.col("max_row") + 1) * F.col("pixel_y")
    return rows.select("path", name.alias("name"), left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"))
