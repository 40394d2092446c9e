"""Requests by their parameters: what each method gives, seams, empty tiles, other methods, and seeding that goes on."""

from __future__ import annotations

import gzip
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_meshes import decode
from test_tile_read import LEFT, TOP, WIDTH, X, Y, Z, stored, surface, tile

from orograph.operators import adaptive, serve, tile_read
from orograph.plans import source_queries
from orograph.sources import geotiff, tiles

REQUEST = "id int, z long, x long, y long, meshing string, resampling string, no_data double, min_zoom long, grid_size long, max_error double"


@pytest.fixture(scope="module")
def mosaic(spark, tmp_path_factory):
    """A raster over nine tiles and some more, finer than they are."""
    pixel = WIDTH / 300
    return stored(spark, tmp_path_factory.mktemp("rasters") / "a", a=geotiff.encode(surface(1000, pixel), LEFT - 1.1 * WIDTH, TOP + 1.1 * WIDTH, pixel, nodata=-1e9, block=128)).cache()


def heights(r):
    (low, high), v, t, _, ext = decode(gzip.decompress(bytes(r.data)))
    return low, high, v, t, ext


def test_mixed_requests(spark, mosaic):
    rows = [
        (1, Z, X, Y, None, None, None, None, None, None),
        (2, Z, X, Y, "grid", "average", None, None, 7, None),
        (3, Z, X, Y, "martini", "bilinear", None, None, None, 8.0),
        (4, Z, X, Y, "delatin", "nearest", None, None, None, 8.0),
        (5, Z, X, Y, "unheard of", "unheard of", None, None, None, None),
        (6, Z, X, Y, None, None, 7.0, 11, None, None),
        (7, Z, 3, 3, "martini", None, 5.0, None, None, None),
        (8, 0, 1, 0, None, None, None, 0, None, None),
        (9, Z, X, Y, None, None, None, None, None, None),
    ]
    out = {r.id: r for r in serve.answer(spark.createDataFrame(rows, REQUEST).withColumns({"h": F.lit("x"), "cells": F.lit("x"), "vid": F.lit("x"), "kind_": F.lit(1)}), mosaic).collect()}
    assert {i: r.kind for i, r in out.items()} == {1: "grid", 2: "grid", 3: "martini", 4: "delatin", 5: "grid", 6: "empty", 7: "empty", 8: "empty", 9: "grid"}
    assert out[1].data == out[5].data == out[9].data
    assert [len(heights(out[i])[2]) for i in (1, 2, 6, 7)] == [19 * 19, 8 * 8, 441, 441]
    assert [heights(out[i])[:2] for i in (6, 7, 8)] == [(7, 7), (5, 5), (0, 0)]
    pixel, n = WIDTH / 300, 256
    x, y = np.meshgrid((np.arange(n + 1) / n * 300 + 330) * pixel, (np.arange(n + 1) / n * 300 + 330) * pixel)
    true = 100 * np.sin(x * 30) + 50 * np.cos(y * 20) + x * 10
    for i in (3, 4):
        low, high, v, t, _ = heights(out[i])
        assert 20 < len(v) < 20_000 and len(t) > 20
        assert low == pytest.approx(true.min(), abs=9) and high == pytest.approx(true.max(), abs=9)


def test_too_many_sets(spark, mosaic):
    rows = [(i, Z, X, Y, None, None, float(i), None, None, None) for i in range(5)]
    with pytest.raises(ValueError, match="sets of parameters"):
        serve.answer(spark.createDataFrame(rows, REQUEST), mosaic, most=4)


def test_no_requests(spark, mosaic):
    assert serve.answer(spark.createDataFrame([], REQUEST), mosaic).count() == 0


def test_a_method_of_ones_own(spark, mosaic):
    class Flat(serve.GridMesher):
        def mesh(self, tiles, mosaic, settings):
            vertices, triangles = super().mesh(tiles, mosaic, settings)
            return vertices.withColumn("h", F.lit(42.0)), triangles

    with mock.patch.dict(serve.METHODS, {"grid": (Flat(), serve.GridStitcher())}):
        (r,) = serve.answer(spark.createDataFrame([(1, Z, X, Y)], "id int, z long, x long, y long"), mosaic).collect()
    assert heights(r)[:2] == (42, 42)


@pytest.mark.parametrize("method", ["nearest", "cubic", "average", "mode"])
def test_grids_share_their_edges(spark, mosaic, method):
    two = spark.createDataFrame([(Z, X, Y), (Z, X + 1, Y), (Z, X, Y + 1)], "z long, x long, y long")
    grids = {(r.x - X, r.y - Y): np.array(r.heights).reshape(257, 257) for r in tile_read.tile_grids(two, mosaic, method=method).collect()}
    assert (grids[0, 0][:, -1] == grids[1, 0][:, 0]).all() and (grids[0, 0][-1] == grids[0, 1][0]).all()
    pixel = WIDTH / 300
    x, y = (np.arange(257) / 256 * 300 + 330) * pixel, (np.arange(257)[:, None] / 256 * 300 + 330) * pixel
    assert np.abs(grids[0, 0] - (100 * np.sin((x - pixel / 2) * 30) + 50 * np.cos((y - pixel / 2) * 20) + x * 10)).max() < (40 * pixel * 120 if method in ("nearest", "mode") else 4)


def test_adaptive_tiles_from_files_have_no_seams(spark, mosaic):
    asked = spark.createDataFrame([(Z, X, Y), (Z, X + 1, Y)], "z long, x long, y long")
    settings = serve.Settings("martini", "bilinear", 0.0, 1, None, None, 8.0, None)
    vertices, _ = serve.meshes(asked, mosaic, settings)
    rows = vertices.collect()
    east = {r.vy: (r.h, round(r.nx, 9), round(r.ny, 9)) for r in rows if r.x == X and r.vx == 256}
    west = {r.vy: (r.h, round(r.nx, 9), round(r.ny, 9)) for r in rows if r.x == X + 1 and r.vx == 0}
    assert east == west and len(east) >= 5
    # heights that came from a neighbour are what sampling here gives
    grid = {(r.x, r.y): np.array(r.heights).reshape(257, 257) for r in tile_read.tile_grids(asked, mosaic, method="bilinear").collect()}
    assert all(r.h == pytest.approx(grid[r.x, r.y][256 - r.vy, r.vx], abs=1e-9) for r in rows)


def test_error_by_zoom(spark):
    h = (np.add.outer(np.arange(65) ** 2, np.arange(65) ** 2) / 50.0).ravel().tolist()
    grids = spark.createDataFrame([(1, 0, 0, h, 0.5), (2, 0, 0, h, 20.0)], "z long, x long, y long, heights array<double>, most_error double")
    sizes = {r.z: len(r.vertices) for r in adaptive.triangulate(grids, "martini", max_error="most_error").collect()}
    assert sizes[1] > 3 * sizes[2]


def test_tiles_without_any_file(spark, mosaic):
    (r,) = tile_read.tile_grids(tile(spark, Z, 3, 3), mosaic, no_data=4.0).collect()
    assert set(r.heights) == {4.0} and len(r.heights) == 257 * 257 and r.error is None


def test_a_second_seeding_reads_no_block(spark, mosaic, tmp_path):
    """What is stored is not made again: with the rasters gone, only what is missing would fail."""
    asked, root = spark.createDataFrame([(Z, X, Y), (Z, X + 1, Y)], "z long, x long, y long"), str(tmp_path / "store")
    source_queries.seed(asked.where(f"x = {X}"), mosaic, root)
    first = tiles.read(spark, root).collect()
    with mock.patch.object(source_queries, "tile_meshes", side_effect=AssertionError("nothing to make")):
        source_queries.seed(asked.where(f"x = {X}"), mosaic, root)
        with pytest.raises(AssertionError, match="nothing to make"):
            source_queries.seed(asked, mosaic, root)
    with mock.patch.object(source_queries, "tile_meshes", wraps=source_queries.tile_meshes) as made:
        source_queries.seed(asked.unionByName(asked), mosaic, root)
        assert [tuple(r) for r in made.call_args.args[0].collect()] == [(Z, X + 1, Y)]
    after = tiles.read(spark, root).collect()
    assert len(after) == 2 and {bytes(r.data) for r in first} < {bytes(r.data) for r in after}


def test_tiles_beyond_the_pyramid_are_made_too(spark, mosaic, tmp_path):
    """Rows north of the world have no neighbours, but who asks for one gets it."""
    asked, root = spark.createDataFrame([(Z, X, Y), (Z, X, -1), (Z, X + 1, 2**Z + 3)], "z long, x long, y long"), str(tmp_path / "store")
    source_queries.seed(asked, mosaic, root)
    got = {(r.z, r.x, r.y): r for r in tiles.read(spark, root).collect()}
    assert set(got) == {(Z, X, Y), (Z, X, -1), (Z, X + 1, 2**Z + 3)}
    assert all(len(heights(r)[2]) == 19 * 19 for r in got.values())
