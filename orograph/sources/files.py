"""Single files in a folder that all executors share: one for each row, written whole or not at all."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from orograph.functions import tiling

#: Numbers below zero name tiles beyond the pyramid's rows or columns; they are kept like any others.
TERRAIN = r"/(\d+)/(-?\d+)/(-?\d+)\.terrain$"


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the place there."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def few_tasks(found: DataFrame) -> DataFrame:
    """Many small files in some tasks for each core, and not one for every four of them, as Spark deals them."""
    return found.coalesce(16 * found.sparkSession.sparkContext.defaultParallelism)


def write(rows: DataFrame, root: str) -> None:
    """Write ``data`` of each row to ``name`` under the root; a file that exists is replaced.

    A file gets its name when it is complete, so a task may run twice or fail halfway.
    """

    def put(part: Iterator[Row]) -> None:
        for r in part:
            system, at = locate(f"{root.rstrip('/')}/{r.name}")
            folder, _, name = at.rpartition("/")
            system.create_dir(folder, recursive=True)
            draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(bytes(r.data))
            system.move(draft, at)

    rows.select("name", "data").foreachPartition(put)


def write_tiles(tiles: DataFrame, root: str) -> None:
    """z, x, y (from the north) and data to <z>/<x>/<y from the south>.terrain; rows without data are left out."""
    south = tiling.flip_y(F.col("y"), F.col("z"))
    name = F.concat_ws("/", F.col("z").cast("string"), F.col("x").cast("string"), F.concat(south.cast("string"), F.lit(".terrain")))
    write(tiles.where("data is not null").select(name.alias("name"), "data"), root)


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """z, x, y (from the north), data of the tiles stored as files; without ``data`` only the folder is listed."""
    found = few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.terrain").load(root))
    z, x, south = (F.regexp_extract("path", TERRAIN, i).cast("long") for i in (1, 2, 3))
    return found.where(F.col("path").rlike(TERRAIN)).select(z.alias("z"), x.alias("x"), tiling.flip_y(south, z).alias("y"), F.col("content").alias("data"))
