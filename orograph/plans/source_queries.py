"""Queries on files: rasters, mosaics and single tiles, written to a shared folder first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import geometry, params, projections, tiling
from orograph.operators import catalog, encode, mesh, raster, sampling, serve, stitch, tile_read
from orograph.plans import inputs, mesh_queries
from orograph.plans.inputs import SQL_EXTENTS, SQL_MESH_TILES
from orograph.plans.registry import query
from orograph.plans.tile_queries import sql_ranges
from orograph.sources import datasets, dem, files, geotiff, mosaics, vrt
from orograph.sources import tiles as stored

#: The stand-in rasters: SIDE pixels wide with blocks of BLOCK, so that blocks at the edges are cut.
SIDE, BLOCK, NODATA, PIXEL = 40, 16, 11.0, 0.025
_NUMBER = r"(\d+)\.tif$"


def _cut_rasters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rasters with no data in the first three columns."""
    j, i = np.mgrid[:SIDE, :SIDE]
    for b in batches:
        tiles = b.column("tile").to_pylist()
        data = [geotiff.encode(np.where(i > 2, (t * 31 + i * 7 + j * 13) % 97, NODATA), float(t % 100), float(t // 100), PIXEL, nodata=NODATA, block=BLOCK) for t in tiles]
        yield pa.RecordBatch.from_arrays([pa.array([f"{t}.tif" for t in tiles], pa.string()), pa.array(data, pa.binary())], ["name", "data"])


def _rasters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    j, i = np.mgrid[:SIDE, :SIDE]
    for b in batches:
        tiles = b.column("tile").to_pylist()
        data = [geotiff.encode((t * 31 + i * 7 + j * 13) % 97, float(t % 100), float(t // 100), PIXEL, nodata=NODATA, block=BLOCK) for t in tiles]
        yield pa.RecordBatch.from_arrays([pa.array([f"{t}.tif" for t in tiles], pa.string()), pa.array(data, pa.binary())], ["name", "data"])


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a raster file for each supplier."""
    root = inputs.shared_folder(spark, "rasters")
    files.write(inputs.mesh_tiles(spark, sf_dir).select("tile").mapInArrow(_rasters, "name string, data binary"), root)
    return root


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geotiff.headers(spark, _folder(spark, sf_dir))


def _tile() -> Column:
    return F.regexp_extract("path", _NUMBER, 1).cast("long").alias("tile")


SQL_PIXELS = f"""(SELECT tile, j AS "row", i AS col, ((tile * 31 + i * 7 + j * 13) % 97)::DOUBLE AS h FROM {SQL_MESH_TILES},
                 (SELECT unnest(range(0, {SIDE})) AS i), (SELECT unnest(range(0, {SIDE})) AS j) WHERE (tile * 31 + i * 7 + j * 13) % 97 <> 11)"""


@query(f"SELECT tile, \"row\", col, h FROM {SQL_PIXELS}")
def dem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel with data of the raster files."""
    return dem.pixels(dem.scan(spark, _folder(spark, sf_dir))).select(_tile(), "row", "col", "h")


@query(f"""SELECT tile, "row", col, h FROM (SELECT *, (tile % 100)::DOUBLE + (col + 0.5e0) * {PIXEL}::DOUBLE AS lon, (tile // 100)::DOUBLE - ("row" + 0.5e0) * {PIXEL}::DOUBLE AS lat FROM {SQL_PIXELS})
           WHERE lon >= 3.2e0 AND lon <= 6.71e0 AND lat >= -0.61e0 AND lat <= 0.3e0""")
def dem_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of a window: blocks away from it are not read, since zoom, level and box reach the source."""
    blocks = dem.scan(spark, _folder(spark, sf_dir)).where("z = 4 and level = 0 and right >= 3.2D and left <= 6.71D and top >= -0.61D and bottom <= 0.3D")
    return dem.pixels(blocks).where("lon >= 3.2D and lon <= 6.71D and lat >= -0.61D and lat <= 0.3D").select(_tile(), "row", "col", "h")


@query(f"""SELECT tile, "row" // {BLOCK} * 3 + col // {BLOCK} AS block, count(*) AS pixels FROM {SQL_PIXELS} GROUP BY ALL""")
def dem_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of each block have data."""
    blocks = dem.scan(spark, _folder(spark, sf_dir), columns=["path", "level", "block", "heights"])
    return blocks.select(_tile(), "block", F.size(F.filter("heights", lambda h: h.isNotNull())).cast("long").alias("pixels")).where("pixels > 0")


@query(f"SELECT tile, min(col) AS min_col, min(\"row\") AS min_row, max(col) AS max_col, max(\"row\") AS max_row FROM {SQL_PIXELS} GROUP BY tile")
def scan_valid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels with data of each file, block by block."""
    pixels = geotiff.pixels(_headers(spark, sf_dir))
    return raster.valid_extent(pixels, ["path"], F.lit(True)).select(_tile(), "min_col", "min_row", "max_col", "max_row")


@query(f"""SELECT tile, (tile % 100)::DOUBLE AS "left", (tile // 100)::DOUBLE - {SIDE} * {PIXEL}::DOUBLE AS bottom,
           (tile % 100)::DOUBLE + {SIDE} * {PIXEL}::DOUBLE AS "right", (tile // 100)::DOUBLE AS top FROM {SQL_MESH_TILES}""")
def metadata_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each raster from its header alone."""
    return geotiff.box(_headers(spark, sf_dir)).where("level = 0").select(_tile(), *catalog.BOX)


@query(f"""SELECT 'all' AS mosaic, ordinal, name, "left", bottom, "right", top FROM {SQL_EXTENTS}""")
def mosaic_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic file holds its datasets in order."""
    root = inputs.shared_folder(spark, "mosaics")
    mosaics.write(inputs.extents(spark, sf_dir), root, "all.json", "all")
    return mosaics.read(spark, f"{root}/all.json")


@query(f"SELECT z, x, y, concat(z, '/', x, '/', y) AS data FROM {SQL_MESH_TILES}")
def tile_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles stored as single files and read back."""
    root = inputs.shared_folder(spark, "terrain")
    files.write_tiles(inputs.mesh_tiles(spark, sf_dir).select("z", "x", "y", F.concat_ws("/", "z", "x", "y").cast("binary").alias("data")), root)
    return files.read_tiles(spark, root).select("z", "x", "y", F.col("data").cast("string").alias("data"))


_BUILT = f"""SELECT tile, concat('/data/', tile, '.tif') AS name, round((tile % 100) + c0 * {PIXEL}::DOUBLE, 9) AS "left", round((tile // 100) - (r1 + 1) * {PIXEL}::DOUBLE, 9) AS bottom,
             round((tile % 100) + (c1 + 1) * {PIXEL}::DOUBLE, 9) AS "right", round((tile // 100) - r0 * {PIXEL}::DOUBLE, 9) AS top"""


@query(f"""SELECT 'metadata' AS extent, * FROM ({_BUILT} FROM (SELECT tile, 0 AS c0, 0 AS r0, {SIDE - 1} AS c1, {SIDE - 1} AS r1 FROM {SQL_MESH_TILES})) UNION ALL
           SELECT 'valid' AS extent, * FROM ({_BUILT} FROM (SELECT tile, min(col) AS c0, min("row") AS r0, max(col) AS c1, max("row") AS r1 FROM {SQL_PIXELS} WHERE col > 2 GROUP BY tile))""")
def mosaic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic's list from a folder of rasters, by headers and by pixels with data (three columns without), with a folder of its own."""
    root = inputs.shared_folder(spark, "rasters")
    files.write(inputs.mesh_tiles(spark, sf_dir).select("tile").mapInArrow(_cut_rasters, "name string, data binary"), root)
    found, out = geotiff.headers(spark, root), None
    for extent in ("metadata", "valid"):
        rows = mosaics.build(found, extent=extent, folder="/data/").select(F.lit(extent).alias("extent"), _tile(), "name", *(F.round(c, 9).alias(c) for c in catalog.BOX))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- from raster files to tiles -------------------------------------------

#: The zoom of the tiles that are asked for; their grid has what the parameters say for it.
ZOOM, CELLS = 8, 18


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile around each raster's middle."""
    rows = inputs.table(spark, sf_dir, "supplier").selectExpr(f"{ZOOM}L as z", "s_suppkey % 100 + 0.5D as lon", "s_suppkey div 100 - 0.5D as lat")
    return rows.select("z", tiling.tile_x(F.col("lon"), F.col("z")).alias("x"), tiling.tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()


def _within(tiles: DataFrame) -> DataFrame:
    """Those that are in the pyramid; suppliers past number 9,100 lie north of it."""
    return tiles.where(tiling.in_matrix(F.col("z"), F.col("x"), F.col("y")))


def _mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.kept(_headers(spark, sf_dir).withColumn("ordinal", F.regexp_extract("path", _NUMBER, 1).cast("long")), "headers")


def tile_meshes(asked: DataFrame, mosaic: DataFrame, *, method: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Vertices (stitched heights, positions, averaged normals) and triangles of the tiles asked for, from raster files.

    The tiles around them are read too, since edges agree with all eight.
    """
    unset = F.lit(None).cast("string")
    tiles = stitch.around(asked).withColumn("cells", params.grid_size(F.col("z"), unset, unset))
    triangles = mesh.grid_triangles(tiles, "cells").drop("cells")
    heights = inputs.kept(tile_read.tile_vertices(tiles, mosaic, cells="cells", method=method), "heights")
    vertices = mesh_queries.grid_tiles(heights, triangles)
    return tuple(df.join(asked, ["z", "x", "y"], "left_semi") for df in (vertices, triangles))


_W = f"(180e0 / {2**ZOOM})"
SQL_ASKED = f"(SELECT DISTINCT {ZOOM}::BIGINT AS z, floor((s_suppkey % 100 + 0.5e0 + 180e0) / {_W})::BIGINT AS x, floor((90e0 - (s_suppkey // 100 - 0.5e0)) / {_W})::BIGINT AS y FROM supplier)"
_AROUND = f"(SELECT DISTINCT z, x + dx AS x, y + dy AS y FROM {SQL_ASKED}, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE x + dx BETWEEN 0 AND {2 ** (ZOOM + 1) - 1} AND y + dy BETWEEN 0 AND {2**ZOOM - 1})"
_AT = "CASE WHEN {c} = %d THEN 255 ELSE trunc({c} * (255 / %d))::BIGINT END" % (CELLS, CELLS)
SQL_RASTER_TILES = f"""WITH around AS (SELECT * FROM {_AROUND}),
    v AS (SELECT z, x, y, j * {CELLS + 1} + i AS vid, ({_AT.format(c="i")})::BIGINT AS vx, ({_AT.format(c="j")})::BIGINT AS vy
          FROM around, (SELECT unnest(range(0, {CELLS + 1})) AS i), (SELECT unnest(range(0, {CELLS + 1})) AS j)),
    p AS (SELECT *, -180e0 + x * {_W} + (vx + 0.5e0) * ({_W} / 256) AS lon, 90e0 - y * {_W} - (255 - vy + 0.5e0) * ({_W} / 256) AS lat FROM v),
    f AS (SELECT s_suppkey AS t, (s_suppkey % 100)::DOUBLE AS l, (s_suppkey // 100)::DOUBLE AS top FROM supplier),
    met AS (SELECT z, x, y, vid, t, (t * 31 + floor((lon - l) / {PIXEL}::DOUBLE)::BIGINT * 7 + floor((top - lat) / {PIXEL}::DOUBLE)::BIGINT * 13) % 97 AS h
            FROM p JOIN f ON lon >= l AND lon < l + 1e0 AND lat <= top AND lat > top - 1e0),
    h AS (SELECT z, x, y, vid, min_by(h, t)::DOUBLE AS h FROM met WHERE h <> {NODATA} GROUP BY z, x, y, vid),
    own AS (SELECT v.*, coalesce(h, 0e0) AS h FROM v LEFT JOIN h ON h.z = v.z AND h.x = v.x AND h.y = v.y AND h.vid = v.vid),
    pos AS (SELECT * FROM {mesh_queries.sql_ecef(mesh_queries.sql_placed("own", mesh.GRID))}),
    n AS (SELECT own.*, nx, ny, nz FROM own JOIN {mesh_queries.sql_normals(mesh_queries.sql_triangles("around", CELLS, "z, x, y"), "pos")} s ON s.z = own.z AND s.x = own.x AND s.y = own.y AND s.vid = own.vid),
    s AS (SELECT z, x, y, vid, vx, vy, {mesh_queries.sql_averaged("h nx ny nz")} FROM n)"""


@query(f"""{SQL_RASTER_TILES} SELECT s.z, s.x, s.y, vid, vx, vy, round(h, 6) + 0e0 AS h, round(nx, 6) + 0e0 AS nx, round(ny, 6) + 0e0 AS ny, round(nz, 6) + 0e0 AS nz
           FROM s JOIN {SQL_ASKED} a ON a.z = s.z AND a.x = s.x AND a.y = s.y""")
def raster_tile_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raster files to stitched vertices: files, levels, blocks, heights, grids by zoom, edges, normals."""
    vertices, _ = tile_meshes(_within(_asked(spark, sf_dir)), _mosaic(spark, sf_dir))
    return mesh_queries.rounded(vertices, "z, x, y, vid, vx, vy", "h nx ny nz", 6)


_SNAP = "{o} + floor(({c} - {o}) / {p} + 1e-9) * {p}", "{o} + ceil(({c} - {o}) / {p} - 1e-9) * {p}"
_P = f"{PIXEL}::DOUBLE"


@query(f"""WITH v AS (SELECT z, x, y, j * {CELLS + 1} + i AS vid, ({_AT.format(c="i")})::BIGINT AS vx, ({_AT.format(c="j")})::BIGINT AS vy
             FROM {SQL_ASKED}, (SELECT unnest(range(0, {CELLS + 1})) AS i), (SELECT unnest(range(0, {CELLS + 1})) AS j)),
           f AS (SELECT s_suppkey AS t, (s_suppkey % 100)::DOUBLE AS l, (s_suppkey // 100)::DOUBLE AS top FROM supplier),
           b AS (SELECT v.*, t, l, top, {_SNAP[0].format(o="l", c=f"(-180e0 + x * {_W})", p=_P)} AS west, {_SNAP[1].format(o="l", c=f"(-180e0 + x * {_W} + {_W})", p=_P)} AS east,
                        {_SNAP[0].format(o="top", c=f"(90e0 - y * {_W} - {_W})", p=_P)} AS south, {_SNAP[1].format(o="top", c=f"(90e0 - y * {_W})", p=_P)} AS north
                 FROM v JOIN f ON -180e0 + x * {_W} <= l + 1e0 AND -180e0 + x * {_W} + {_W} >= l AND 90e0 - y * {_W} >= top - 1e0 AND 90e0 - y * {_W} - {_W} <= top),
           p AS (SELECT *, west + (vx + 0.5e0) * ((east - west) / 256) AS lon, north - (255 - vy + 0.5e0) * ((north - south) / 256) AS lat FROM b),
           met AS (SELECT z, x, y, vid, t, (t * 31 + floor((lon - l) / {_P})::BIGINT * 7 + floor((top - lat) / {_P})::BIGINT * 13) % 97 AS h
                   FROM p WHERE lon >= l AND lon < l + {SIDE} * {_P} AND lat <= top AND lat > top - {SIDE} * {_P}),
           h AS (SELECT z, x, y, vid, min_by(h, t)::DOUBLE AS h FROM met WHERE h <> {NODATA} GROUP BY z, x, y, vid)
           SELECT v.z, v.x, v.y, v.vid, coalesce(h, 0e0) AS h FROM v LEFT JOIN h ON h.z = v.z AND h.x = v.x AND h.y = v.y AND h.vid = v.vid""")
def raster_aligned_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of tiles whose boxes are moved to each raster's own grid before it is read."""
    return tile_read.tile_vertices(_asked(spark, sf_dir), _mosaic(spark, sf_dir), cells=CELLS, aligned=True).select("z", "x", "y", "vid", "h")


#: Coarse tiles, whose pixels cover several of a raster's.
COARSE, COARSE_CELLS = 3, 64
_CW = f"(180e0 / {2**COARSE})"
_CAT = "CASE WHEN {c} = %d THEN 255 ELSE trunc({c} * (255e0 / %d))::BIGINT END" % (COARSE_CELLS, COARSE_CELLS)
_HALF = f"({_CW} / 256 / {PIXEL}::DOUBLE / 2)"
SQL_AREAS = f"""WITH t AS (SELECT DISTINCT {COARSE}::BIGINT AS z, floor((s_suppkey % 100 + 0.5e0 + 180e0) / {_CW})::BIGINT AS x, floor((90e0 - (s_suppkey // 100 - 0.5e0)) / {_CW})::BIGINT AS y FROM supplier),
    v AS (SELECT z, x, y, j * {COARSE_CELLS + 1} + i AS vid, ({_CAT.format(c="i")})::BIGINT AS vx, ({_CAT.format(c="j")})::BIGINT AS vy
          FROM t, (SELECT unnest(range(0, {COARSE_CELLS + 1})) AS i), (SELECT unnest(range(0, {COARSE_CELLS + 1})) AS j)),
    p AS (SELECT *, -180e0 + x * {_CW} + (vx + 0.5e0) * ({_CW} / 256) AS lon, 90e0 - y * {_CW} - (255 - vy + 0.5e0) * ({_CW} / 256) AS lat FROM v),
    f AS (SELECT s_suppkey AS t, (s_suppkey % 100)::DOUBLE AS l, (s_suppkey // 100)::DOUBLE AS top FROM supplier),
    c AS (SELECT p.*, t, (lon - l) / {PIXEL}::DOUBLE - 0.5e0 AS px, (top - lat) / {PIXEL}::DOUBLE - 0.5e0 AS py
          FROM p JOIN f ON lon >= l AND lon < l + {SIDE} * {PIXEL}::DOUBLE AND lat <= top AND lat > top - {SIDE} * {PIXEL}::DOUBLE),
    k AS (SELECT unnest(range(0, {SIDE})) AS k),
    met AS (SELECT c.*, a.k AS i, b.k AS j, ((t * 31 + a.k * 7 + b.k * 13) % 97)::DOUBLE AS h
            FROM c JOIN k a ON a.k >= px - {_HALF} AND a.k < px + {_HALF} JOIN k b ON b.k >= py - {_HALF} AND b.k < py + {_HALF}
            WHERE (t * 31 + a.k * 7 + b.k * 13) % 97 <> {NODATA}),
    w AS (SELECT *, exp(-((i - px) ** 2 + (j - py) ** 2) / (2 * {_HALF} ** 2)) AS w FROM met),
    sums AS (SELECT z, x, y, vid, t, avg(h) AS average, sqrt(avg(h * h)) AS rms, sum(w * h) / sum(w) AS gauss FROM w GROUP BY ALL),
    modes AS (SELECT z, x, y, vid, t, h AS mode FROM (SELECT z, x, y, vid, t, h, count(*) AS n FROM met GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY z, x, y, vid, t ORDER BY n DESC, h) = 1),
    firsts AS (SELECT * FROM sums JOIN modes USING (z, x, y, vid, t) QUALIFY row_number() OVER (PARTITION BY z, x, y, vid ORDER BY t) = 1)
    SELECT v.z, v.x, v.y, v.vid, """ + ", ".join(f"round(coalesce({m}, -1e0), 6) AS {m}" for m in ("average", "rms", "gauss", "mode")) + " FROM v LEFT JOIN firsts f ON f.z = v.z AND f.x = v.x AND f.y = v.y AND f.vid = v.vid"


@query(SQL_AREAS)
def raster_area_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of coarse tiles by all four methods that take every pixel under the tile's, from raster files."""
    rows = inputs.table(spark, sf_dir, "supplier").selectExpr(f"{COARSE}L as z", "s_suppkey % 100 + 0.5D as lon", "s_suppkey div 100 - 0.5D as lat")
    asked = rows.select("z", tiling.tile_x(F.col("lon"), F.col("z")).alias("x"), tiling.tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()
    mosaic, out = _mosaic(spark, sf_dir), None
    for method in sampling.AREAS:
        rows = tile_read.tile_vertices(asked, mosaic, cells=COARSE_CELLS, method=method, no_data=-1.0, unsafe=True).select("z", "x", "y", "vid", F.round("h", 6).alias(method))
        out = rows if out is None else out.join(rows, ["z", "x", "y", "vid"])
    return out


def seed(asked: DataFrame, mosaic: DataFrame, root: str) -> None:
    """Make the tiles that the store under ``root`` does not have, and append them.

    What is missing is fixed before anything is read, by the store's keys
    alone; if nothing is, no file is opened. A run that fails halfway leaves the
    store as it was, and the next one takes up what it had to do.
    """
    todo = inputs.kept(stored.missing(asked.select("z", "x", "y"), root), "todo")
    if not todo.isEmpty():
        tiles = encode.encode_tiles(*tile_meshes(todo, mosaic))
        stored.write(tiles.withColumn("code", tiling.morton(F.col("x"), F.col("y"))), root)


@query(f"""{SQL_RASTER_TILES} SELECT own.z, own.x, own.y, vid, h FROM own JOIN {SQL_ASKED} a ON a.z = own.z AND a.x = own.x AND a.y = own.y""")
def vrt_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of tiles from one virtual raster over all raster files."""
    root = _folder(spark, sf_dir)
    rect = "concat('<SimpleSource><SourceFilename relativeToVRT=\"1\">../', tile, '.tif</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff=\"0\" yOff=\"0\" xSize=\"{n}\" ySize=\"{n}\"/><DstRect xOff=\"', {n} * (tile % 100), '\" yOff=\"', {n} * (1000 - tile div 100), '\" xSize=\"{n}\" ySize=\"{n}\"/></SimpleSource>')".format(n=SIDE)
    head = f"<VRTDataset><GeoTransform>0.0, {PIXEL}, 0.0, 1000.0, 0.0, -{PIXEL}</GeoTransform><VRTRasterBand dataType=\"Float32\" band=\"1\"><NoDataValue>{NODATA}</NoDataValue>"
    document = inputs.mesh_tiles(spark, sf_dir).agg(F.concat(F.lit(head), F.concat_ws("", F.collect_list(F.expr(rect))), F.lit("</VRTRasterBand></VRTDataset>")).alias("text"))
    files.write(document.select(F.lit("virtual/all.vrt").alias("name"), F.col("text").cast("binary").alias("data")), root)
    found = inputs.kept(vrt.headers(spark, f"{root}/virtual"), "headers")
    return tile_read.tile_vertices(_within(_asked(spark, sf_dir)), found, cells=CELLS).select("z", "x", "y", "vid", "h")


def _generated(spark: SparkSession, asked: DataFrame, mosaic: DataFrame) -> DataFrame:
    """The tiles' bytes, by way of a new store."""
    root = inputs.shared_folder(spark, "tiles")
    seed(asked, mosaic, root)
    return stored.read(spark, root)


@query(f"SELECT z, x, y, x % 2 = 0 AS first FROM {SQL_ASKED}")
def seed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding that goes on: every other tile, then all of them; those of the first run keep its bytes."""
    root, asked, mosaic = inputs.shared_folder(spark, "tiles"), _asked(spark, sf_dir), _mosaic(spark, sf_dir)
    seed(asked.where("x % 2 = 0"), mosaic, root)
    first = inputs.kept(stored.read(spark, root).select("z", "x", "y", F.lit(True).alias("first")), "first")
    seed(asked, mosaic, root)
    return stored.read(spark, root).join(first, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("first", F.lit(False)).alias("first"))


def _smooth_rasters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slope and a bowl, which adaptive meshes can follow with few triangles."""
    j, i = np.mgrid[:SIDE, :SIDE]
    for b in batches:
        tiles = b.column("tile").to_pylist()
        data = [geotiff.encode(t % 7 * 3 + i / 9 + (j - 20) ** 2 / 40, float(t % 100), float(t // 100), PIXEL, block=BLOCK) for t in tiles]
        yield pa.RecordBatch.from_arrays([pa.array([f"{t}.tif" for t in tiles], pa.string()), pa.array(data, pa.binary())], ["name", "data"])


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile around each raster's middle, asked for with the parameters of its supplier's region; one more far from any raster."""
    suppliers = inputs.table(spark, sf_dir, "supplier").join(inputs.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tiles = suppliers.selectExpr("n_regionkey as region", f"{ZOOM}L as z", "s_suppkey % 100 + 0.5D as lon", "s_suppkey div 100 - 0.5D as lat")
    tiles = tiles.select("region", "z", tiling.tile_x(F.col("lon"), F.col("z")).alias("x"), tiling.tile_y(F.col("lat"), F.col("z")).alias("y")).distinct()
    r = F.col("r_regionkey")
    options = inputs.table(spark, sf_dir, "region").select(
        r.alias("region"),
        F.when(r == 1, "martini").when(r == 2, "delatin").when(r == 3, "other").alias("meshing"),
        F.when(r == 0, "average").when(r == 2, "bilinear").when(r == 3, "no such").alias("resampling"),
        F.when(r == 3, -5.0).alias("no_data"),
        F.when(r == 4, 9).cast("long").alias("min_zoom"),
        F.when(r == 0, 6).cast("long").alias("grid_size"),
        F.when(r == 2, 3.0).alias("max_error"),
    )
    far = options.where("region = 3").select(F.lit(ZOOM).cast("long").alias("z"), F.lit(10).cast("long").alias("x"), F.lit(10).cast("long").alias("y"), *options.columns)
    return tiles.join(options, "region").unionByName(far)


@query(f"""SELECT DISTINCT n_regionkey::BIGINT AS region, {ZOOM}::BIGINT AS z, floor((s_suppkey % 100 + 0.5e0 + 180e0) / {_W})::BIGINT AS x, floor((90e0 - (s_suppkey // 100 - 0.5e0)) / {_W})::BIGINT AS y,
             'gzip' AS encoding, CASE n_regionkey WHEN 4 THEN 'empty' WHEN 1 THEN 'martini' WHEN 2 THEN 'delatin' ELSE 'grid' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey
           UNION ALL SELECT r_regionkey, {ZOOM}, 10, 10, 'gzip', 'empty' FROM region WHERE r_regionkey = 3""")
def request_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with mixed parameters (methods, resampling, sizes, errors, empty tiles) answered in one plan, from raster files to bytes."""
    root = inputs.shared_folder(spark, "rasters")
    files.write(inputs.mesh_tiles(spark, sf_dir).select("tile").mapInArrow(_smooth_rasters, "name string, data binary"), root)
    found = inputs.kept(geotiff.headers(spark, root).withColumn("ordinal", F.regexp_extract("path", _NUMBER, 1).cast("long")), "headers")
    return serve.answer(request_rows(spark, sf_dir), found).select(F.col("region").cast("long").alias("region"), "z", "x", "y", "kind", "encoding")


@query(f"SELECT z, x, y, 'gzip' AS encoding FROM {SQL_ASKED}")
def raster_to_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request: raster files to stored tile bytes (their content is decoded in the tests)."""
    return _generated(spark, _asked(spark, sf_dir), _mosaic(spark, sf_dir)).select("z", "x", "y", "encoding")


@query(f"""SELECT 7::BIGINT AS z, x, y FROM (SELECT DISTINCT x, y FROM (SELECT (s_suppkey % 100)::DOUBLE AS l, (s_suppkey // 100)::DOUBLE AS t FROM supplier),
             (SELECT unnest(range(0, 256)) AS x), (SELECT unnest(range(0, 128)) AS y)
           WHERE x BETWEEN floor((l + 1e-11 + 180e0) / 1.40625e0) AND floor((l + 1e0 - 1e-11 + 180e0) / 1.40625e0)
             AND y BETWEEN floor((90e0 - (t - 1e-11)) / 1.40625e0) AND floor((90e0 - (t - 1e0 + 1e-11)) / 1.40625e0))""")
def seed_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding that generates: the tiles of a zoom that the mosaic's rasters meet, made and stored."""
    mosaic = _mosaic(spark, sf_dir)
    ranges = catalog.availability(geotiff.box(mosaic).where("level = 0"), ["ordinal"], max_zoom=7, first=7)
    seeds = catalog.seed_tiles(ranges).select(F.col("z").cast("long").alias("z"), "x", tiling.flip_y(F.col("y"), F.col("z")).alias("y")).distinct()
    return _generated(spark, seeds, mosaic).select("z", "x", "y")


@query(f"""SELECT round({geometry.A!r}::DOUBLE * radians(lon), 3) AS x, round({geometry.A!r}::DOUBLE * atanh(sin(radians(lat))), 3) AS y, count(*) AS n FROM {inputs.SQL_POINTS} GROUP BY ALL""")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points' places in web Mercator, with how many lie there."""
    x, y = projections.mercator(projections.COLUMNS, F.col("lon"), F.col("lat"))
    return inputs.points(spark, sf_dir).groupBy(F.round(x, 3).alias("x"), F.round(y, 3).alias("y")).agg(F.count(F.lit(1)).alias("n"))


# --- configurations and layer descriptions --------------------------------

SQL_CONFIG = """(SELECT concat('c', p_size % 10) AS file, p_partkey AS id, CASE WHEN p_partkey % 97 <> 96 THEN concat('d', p_partkey % 40) END AS name, concat('./', p_brand, '.tif') AS cog,
    CASE WHEN p_size % 3 = 0 THEN (p_size % 5)::BIGINT END AS min_zoom, CASE WHEN p_size % 4 = 0 THEN 'martini' END AS meshing, CASE WHEN p_size % 6 = 0 THEN p_size::DOUBLE END AS no_data,
    CASE WHEN p_size % 8 = 0 THEN concat('{"15":', p_size, '.0}') END AS grid_sizes FROM part)"""


@query(f"""SELECT c.file, name, cog, min_zoom, meshing, no_data, grid_sizes FROM {SQL_CONFIG} c LEFT JOIN (SELECT file, min(id) AS stop FROM {SQL_CONFIG} WHERE name IS NULL GROUP BY file) s ON s.file = c.file
           WHERE stop IS NULL OR id < stop QUALIFY row_number() OVER (PARTITION BY c.file, name ORDER BY id DESC) = 1""")
def dataset_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations written and read: an unnamed dataset ends its file, the last of a name stays."""
    root = inputs.shared_folder(spark, "configs")
    rows = inputs.table(spark, sf_dir, "part").selectExpr(
        "concat('c', p_size % 10) as file",
        "p_partkey as ordinal",
        "case when p_partkey % 97 <> 96 then concat('d', p_partkey % 40) end as name",
        "concat('./', p_brand, '.tif') as cog",
        "case when p_size % 3 = 0 then cast(p_size % 5 as bigint) end as min_zoom",
        "case when p_size % 4 = 0 then 'martini' end as meshing",
        "case when p_size % 6 = 0 then cast(p_size as double) end as no_data",
        "case when p_size % 8 = 0 then map('15', cast(p_size as double)) end as grid_sizes",
    )
    datasets.write(rows, root)
    return datasets.read(spark, root).where("problem is null").select("file", "name", "cog", "min_zoom", "meshing", "no_data", "grid_sizes")


_LEVELS = 7
_LAYER = "tilejson string, version string, format string, schema string, projection string, extensions array<string>, tiles array<string>, bounds array<double>, cogBounds array<double>, available array<array<struct<startX: bigint, startY: bigint, endX: bigint, endY: bigint>>>"


@query(f"""SELECT ordinal, z, start_x, start_y, end_x, end_y, '2.1.0' AS tilejson, '1.1.0' AS version, 'quantized-mesh-1.0' AS format, 'tms' AS "schema", 'EPSG:4326' AS projection,
             'octvertexnormals' AS extension, concat('{{z}}/{{x}}/{{y}}.terrain?v={{version}}&minZoom=', ordinal % 4, '&cog=', name) AS tile, 180e0 AS east, e."left", e.top
           FROM (SELECT ordinal, 0 AS z, 0 AS start_x, 0 AS start_y, 1 AS end_x, 0 AS end_y FROM {SQL_EXTENTS} UNION ALL
                 SELECT ordinal, z, start_x, start_y, end_x, end_y FROM {sql_ranges(SQL_EXTENTS, 'ordinal', _LEVELS)}) r JOIN {SQL_EXTENTS} e USING (ordinal)""")
def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer descriptions written to files, and read back as a row for each zoom."""
    root, boxes = inputs.shared_folder(spark, "layers"), inputs.extents(spark, sf_dir)
    ranges = catalog.availability(boxes, ["ordinal"], max_zoom=_LEVELS, first=0)
    url = F.concat(F.lit("&"), params.query_url(F.lit(""), minZoom=F.col("ordinal") % 4, cog=F.col("name")).substr(F.lit(2), F.lit(10_000)))
    docs = catalog.layer_documents(ranges, boxes, "ordinal", query=url, max_zoom=_LEVELS)
    files.write(docs.select(F.concat(F.col("ordinal").cast("string"), F.lit("/layer.json")).alias("name"), F.col("document").cast("binary").alias("data")), root)
    read = spark.read.schema(_LAYER).option("recursiveFileLookup", "true").json(root).withColumn("ordinal", F.regexp_extract(F.input_file_name(), r"(\d+)/layer\.json$", 1).cast("long"))
    rows = read.select("*", F.posexplode("available").alias("z", "r")).withColumn("r", F.col("r")[0])
    places = [F.col(f"r.{k}").alias(c) for k, c in (("startX", "start_x"), ("startY", "start_y"), ("endX", "end_x"), ("endY", "end_y"))]
    last = [F.col("extensions")[0].alias("extension"), F.col("tiles")[0].alias("tile"), F.col("bounds")[2].alias("east"), F.col("cogBounds")[0].alias("left"), F.col("cogBounds")[3].alias("top")]
    return rows.select("ordinal", "z", *places, "tilejson", "version", "format", "schema", "projection", *last)
