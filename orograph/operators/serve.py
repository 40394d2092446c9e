"""Requests answered by their parameters: each method a mesher and a stitcher, all methods in one plan.

A mesher makes vertices and triangles of tiles from raster files, a stitcher
makes neighbouring tiles agree; a method is a pair of them in ``METHODS``, and
others can be added there. Requests are dealt by the few sets of parameters
that they have in common.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions import params, tiling
from orograph.operators import adaptive, catalog, encode, mesh, sampling, stitch, tile_meshes, tile_read
from orograph.operators.tables import kept
from orograph.sources import geotiff

KEY = ["z", "x", "y"]
#: Parameters of a request that change its tile; null means the default.
SETTINGS = {
    "meshing": "string",
    "resampling": "string",
    "no_data": "double",
    "min_zoom": "long",
    "grid_size": "long",
    "grid_sizes": "string",
    "max_error": "double",
    "max_errors": "string",
}


@dataclass(frozen=True)
class Settings:
    """One set of parameters, defaults filled in; the maps by zoom stay as they are."""

    meshing: str
    resampling: str
    no_data: float
    min_zoom: int
    grid_size: int | None
    grid_sizes: str | None
    max_error: float | None
    max_errors: str | None


class Mesher(Protocol):
    def mesh(self, tiles: DataFrame, mosaic: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
        """Vertices (z, x, y, vid, vx, vy, h) and triangles (z, x, y, tid, a, b, c) of tiles, from the headers of files."""
        ...


class Stitcher(Protocol):
    def stitch(self, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
        """The vertices with lon, lat, positions and normals, so that tiles agree on shared edges."""
        ...


class GridMesher:
    """A lattice with the size that the parameters have for the zoom."""

    def mesh(self, tiles: DataFrame, mosaic: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
        size = params.grid_size(F.col("z"), F.lit(settings.grid_sizes).cast("string"), F.lit(settings.grid_size).cast("long"))
        sized = tiles.withColumn("cells", size)
        vertices = tile_read.tile_vertices(sized, mosaic, cells="cells", method=settings.resampling, no_data=settings.no_data)
        return kept(vertices.drop("error"), "heights"), mesh.grid_triangles(sized, "cells").drop("cells")


class GridStitcher:
    """Normals come from each tile's own faces, weighted by area; then normals and heights are averaged over shared edges."""

    def stitch(self, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
        return tile_meshes.vertices(tile_meshes.stitched_grids(tile_meshes.grouped(vertices, triangles), size=mesh.GRID))


@dataclass(frozen=True)
class AdaptiveMesher:
    """Triangles as large as the error for the zoom allows, made anew with the neighbours' vertices on shared edges."""

    method: str

    def mesh(self, tiles: DataFrame, mosaic: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
        grids = tile_read.tile_grids(tiles, mosaic, method=settings.resampling, no_data=settings.no_data)
        error = params.max_error(F.col("z"), F.lit(settings.max_errors).cast("string"), F.lit(settings.max_error).cast("double"))
        meshes = adaptive.triangulate(grids.withColumn("max_error", error), self.method, max_error="max_error")
        return adaptive.flatten(kept(adaptive.remesh(meshes, size=mesh.MARTINI), "meshes"))


class AdaptiveStitcher:
    """Heights are averaged over shared edges, then normals are taken from the faces and averaged too."""

    def stitch(self, vertices: DataFrame, triangles: DataFrame) -> DataFrame:
        return tile_meshes.vertices(tile_meshes.stitched_adaptive(tile_meshes.grouped(vertices, triangles), size=mesh.MARTINI))


METHODS: dict[str, tuple[Mesher, Stitcher]] = {
    "grid": (GridMesher(), GridStitcher()),
    "martini": (AdaptiveMesher("martini"), AdaptiveStitcher()),
    "delatin": (AdaptiveMesher("delatin"), AdaptiveStitcher()),
}


def settled(requests: DataFrame) -> DataFrame:
    """The requests with all parameters, defaults filled in; unknown methods are the default ones."""
    have = {c: F.col(c).cast(t) if c in requests.columns else F.lit(None).cast(t) for c, t in SETTINGS.items()}
    rows = requests.withColumns(have)
    resampling = F.when(F.col("resampling").isin(*sampling.METHODS), F.col("resampling")).otherwise("nearest")
    filled = {"meshing": params.mesher(F.col("meshing")), "resampling": resampling, "no_data": params.with_default(F.col("no_data"), "noData").cast("double"), "min_zoom": params.with_default(F.col("min_zoom"), "minZoom").cast("long")}
    return rows.withColumns(filled)


def meshes(asked: DataFrame, mosaic: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Stitched vertices and triangles of tiles; the tiles around them are read too, since edges agree with all eight."""
    mesher, stitcher = METHODS[settings.meshing]
    vertices, triangles = mesher.mesh(stitch.around(asked), mosaic, settings)
    return tuple(df.join(asked, KEY, "left_semi") for df in (stitcher.stitch(vertices, triangles), triangles))


def empties(asked: DataFrame, no_data: float) -> DataFrame:
    """The bytes of flat tiles."""
    return encode.encode_tiles(mesh.empty_tiles(asked, no_data), mesh.grid_triangles(asked, 20))


def answer(requests: DataFrame, mosaic: DataFrame, *, most: int = 32) -> DataFrame:
    """The requests with kind (empty or the method), encoding and data of their tiles.

    ``requests`` has z, x, y and any of ``SETTINGS``; ``mosaic`` has the headers
    of the files with an ``ordinal`` each, and should be a table. Tiles at zoom
    0, below the least zoom, or that meet no file, are empty ones with the
    height for no data. At most ``most`` different sets of parameters are
    answered at once, more are an error; repeated requests are answered once
    and given to each.
    """
    spark = requests.sparkSession
    rows = settled(requests)
    sets = [Settings(**r.asDict()) for r in rows.select(*SETTINGS).distinct().limit(most + 1).collect()]
    if len(sets) > most:
        raise ValueError(f"more than {most} sets of parameters")
    numbered = spark.createDataFrame([(i, *(getattr(s, c) for c in SETTINGS)) for i, s in enumerate(sets)], "_set int, " + ", ".join(f"{c} {t}" for c, t in SETTINGS.items()))
    same = [rows[c].eqNullSafe(numbered[c]) for c in SETTINGS]
    rows = rows.join(F.broadcast(numbered), same).select(*(rows[c] for c in rows.columns), "_set")
    boxes = geotiff.box(mosaic.where("error is null and level = 0")).select("ordinal", *catalog.BOX)
    out = None
    for i, s in enumerate(sets):
        tiles = rows.where(F.col("_set") == i).select(*KEY).distinct()
        full = tiles.where(~mesh.is_empty(F.col("z"), F.lit(s.min_zoom)))
        full = kept(catalog.prune(full.withColumns(tiling.bounds(*map(F.col, KEY))), boxes).select(*KEY).distinct(), "asked")
        made = encode.encode_tiles(*meshes(full, mosaic, s)).withColumn("kind", F.lit(s.meshing))
        flat = empties(tiles.join(full, KEY, "left_anti"), s.no_data).withColumn("kind", F.lit("empty"))
        both = made.unionByName(flat).select(F.lit(i).alias("_set"), *KEY, "kind", "encoding", "data")
        out = both if out is None else out.unionByName(both)
    if out is None:
        return rows.drop("_set").withColumns({"kind": F.lit(""), "encoding": F.lit(""), "data": F.lit(b"")}).where("false")
    return rows.join(out, ["_set", *KEY]).drop("_set")
