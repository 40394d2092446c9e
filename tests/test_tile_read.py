"""Tiles from raster files: levels, kernels, broken blocks, missing data, and the bytes at the end."""

from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_meshes import decode

from orograph.functions import tiling
from orograph.operators import tile_read
from orograph.plans import source_queries
from orograph.sources import geotiff

Z, X, Y = 10, 1054, 168
WIDTH = 180 / 2**Z
LEFT, TOP = -180 + X * WIDTH, 90 - Y * WIDTH


def surface(n, pixel):
    y, x = np.mgrid[:n, :n]
    return 100 * np.sin(x * pixel * 30) + 50 * np.cos(y * pixel * 20) + x * pixel * 10


def stored(spark, folder, **files):
    folder.mkdir()
    for name, data in files.items():
        (folder / f"{name}.tif").write_bytes(data)
    found = geotiff.headers(spark, str(folder))
    return found.withColumn("ordinal", F.dense_rank().over(Window.orderBy("path")).cast("long"))


def tile(spark, z=Z, x=X, y=Y):
    return spark.createDataFrame([(z, x, y)], "z long, x long, y long")


def test_level_as_fine_as_the_tile(spark, tmp_path):
    pixel = WIDTH / 1024
    grid = surface(1024, pixel).astype(np.float32)
    found = stored(spark, tmp_path / "a", a=geotiff.encode(grid, LEFT, TOP, pixel, overviews=[2, 4, 8]))
    assert sorted((r.level, r.width) for r in found.collect()) == [(0, 1024), (1, 512), (2, 256), (3, 128)]
    levels = geotiff.box(found)
    picked = {z: [r.level for r in tile_read.sources(tile(spark, z, X * 2**z // 2**Z, Y * 2**z // 2**Z), levels, unsafe=True).collect()] for z in (9, 10, 11, 12, 13)}
    assert picked == {9: [3], 10: [2], 11: [1], 12: [0], 13: [0]}
    out = tile_read.tile_vertices(tile(spark), found, cells=6).collect()
    assert len(out) == 49 and all(r.h == grid[::4, ::4][255 - r.vy, r.vx] for r in out)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubic_spline", "lanczos"])
def test_kernels_follow_a_smooth_surface(spark, tmp_path, method):
    pixel = WIDTH / 200
    found = stored(spark, tmp_path / "a", a=geotiff.encode(surface(240, pixel), LEFT - 20 * pixel, TOP + 20 * pixel, pixel, block=64))
    out = tile_read.tile_vertices(tile(spark), found, cells=9, method=method).collect()
    for r in out:
        x, y = (r.vx + 0.5) / 256 * 200 + 20 - 0.5, (255 - r.vy + 0.5) / 256 * 200 + 20 - 0.5
        wanted = 100 * np.sin(x * pixel * 30) + 50 * np.cos(y * pixel * 20) + x * pixel * 10
        assert r.h == pytest.approx(wanted, abs=0.3 if method == "lanczos" else 0.05)  # lanczos does not keep slopes exactly


def test_first_file_with_data_and_broken_blocks(spark, tmp_path):
    pixel = WIDTH / 64
    first = np.full((64, 64), 5.0)
    first[:, 32:] = -1
    second = np.full((64, 64), 7.0)
    second[48:] = -1
    broken = bytearray(geotiff.encode(np.random.default_rng(1).normal(size=(64, 64)), LEFT, TOP, pixel, nodata=-1, block=64))
    broken[20:40] = bytes(20)
    made = {k: geotiff.encode(g, LEFT, TOP, pixel, nodata=-1, block=32) for k, g in (("b", first), ("c", second))}
    found = stored(spark, tmp_path / "a", a=bytes(broken), **made)
    assert [r.path.rpartition("/")[2] for r in geotiff.blocks(found).where("error is not null").collect()] == ["a.tif"]
    for r in tile_read.tile_vertices(tile(spark), found, cells=10, no_data=-9.0).collect():
        col, row = r.vx // 4, (255 - r.vy) // 4
        assert r.h == (5 if col < 32 else 7 if row < 48 else -9)
        assert r.error is not None  # the first file's only block is broken
    _, other = (F.col("path").endswith(n) for n in ("a.tif", "b.tif"))
    assert {r.error for r in tile_read.tile_vertices(tile(spark), found.where(other), cells=10).collect()} == {None}


def test_errors_stay_with_the_vertices_that_need_the_block(spark, tmp_path):
    pixel = WIDTH / 64
    data = bytearray(geotiff.encode(np.random.default_rng(2).normal(size=(64, 64)), LEFT, TOP, pixel, block=32))
    data[20:30] = bytes(10)  # within the first block
    found = stored(spark, tmp_path / "a", a=bytes(data))
    for method, edge in (("nearest", 32), ("average", 32), ("mode", 32), ("lanczos", 35)):
        for r in tile_read.tile_vertices(tile(spark), found, cells=15, method=method).collect():
            col, row = (r.vx + 0.5) / 4, (255 - r.vy + 0.5) / 4
            assert (r.error is not None) == (col < edge - 0.5 * (edge > 32) and row < edge - 0.5 * (edge > 32))


def test_aligned_reading_takes_pixels_as_they_are(spark, tmp_path):
    """A raster as fine as the tile, but off its lines by a part of a pixel: each vertex gets the pixel of its own number."""
    pixel = WIDTH / 256
    grid = np.random.default_rng(5).normal(size=(300, 300)).astype(np.float32)
    found = stored(spark, tmp_path / "a", a=geotiff.encode(grid, LEFT - 20.3 * pixel, TOP + 20.7 * pixel, pixel, block=64))
    for method in ("nearest", "bilinear"):
        out = tile_read.tile_vertices(tile(spark), found, cells=12, method=method, aligned=True).collect()
        for r in out:
            # the box has 257 of the raster's pixels on a side
            x, y = (r.vx + 0.5) * 257 / 256 + 20 - 0.5, (255 - r.vy + 0.5) * 257 / 256 + 20 - 0.5
            if method == "nearest":
                assert r.h == grid[int(y + 0.5), int(x + 0.5)]
            else:
                i, j = int(x), int(y)
                wanted = np.array([1 - (y - j), y - j]) @ grid[j : j + 2, i : i + 2].astype(float) @ np.array([1 - (x - i), x - i])
                assert r.h == pytest.approx(wanted, abs=1e-5)


def test_pixels_are_not_exchanged(spark, tmp_path):
    """What is between the reading task and the vertices are vertex numbers and sums, and no join has pixels on a side."""
    found = stored(spark, tmp_path / "a", a=geotiff.encode(np.ones((64, 64)), LEFT, TOP, WIDTH / 64, block=32))
    plan = tile_read.tile_vertices(tile(spark), found, cells=4, method="cubic")._jdf.queryExecution().executedPlan().toString()
    assert "heights" not in plan and plan.count("MapInArrow sampler") + plan.count("MapInArrow run") >= 1


def test_areas_against_pixels_one_by_one(spark, tmp_path):
    pixel, n = WIDTH / 900, 900  # no overview: each vertex covers three or four pixels on a side
    grid = np.random.default_rng(3).integers(0, 4, size=(n, n)).astype(np.float32)
    found = stored(spark, tmp_path / "a", a=geotiff.encode(grid, LEFT, TOP, pixel, nodata=0.0, block=256))
    out = {m: {r.vid: r for r in tile_read.tile_vertices(tile(spark), found, cells=20, method=m, no_data=-1.0).collect()} for m in ("average", "rms", "gauss", "mode")}
    half = 900 / 256 / 2
    for vid, r in out["average"].items():
        x, y = (r.vx + 0.5) / 256 * 900 - 0.5, (255 - r.vy + 0.5) / 256 * 900 - 0.5
        rows, cols = (np.arange(n)[(np.arange(n) >= c - half) & (np.arange(n) < c + half)] for c in (y, x))
        part = grid[np.ix_(rows, cols)].astype(float)
        w = np.exp(-((rows[:, None] - y) ** 2 + (cols[None] - x) ** 2) / (2 * half**2))
        ok = part != 0
        value, count = np.unique(part[ok], return_counts=True)
        wanted = {"average": part[ok].mean(), "rms": np.sqrt((part[ok] ** 2).mean()), "gauss": (part * w)[ok].sum() / w[ok].sum(), "mode": value[count.argmax()]}
        assert {m: out[m][vid].h for m in out} == pytest.approx(wanted)


def test_no_tiles_and_no_files(spark, tmp_path):
    found = stored(spark, tmp_path / "a", a=geotiff.encode(np.ones((8, 8)), 10, 10, 0.1))
    assert tile_read.tile_vertices(tile(spark).where("z < 0"), found, cells=4).count() == 0
    away = tile_read.tile_vertices(tile(spark), found, cells=4, no_data=3.0).collect()
    assert len(away) == 25 and {r.h for r in away} == {3.0}


def test_bytes_of_raster_tiles(spark, sf_dir):
    asked, mosaic = source_queries._asked(spark, sf_dir), source_queries._mosaic(spark, sf_dir)
    vertices = {}
    for r in source_queries.tile_meshes(asked, mosaic)[0].collect():
        vertices.setdefault((r.z, r.x, r.y), []).append(r)
    out = source_queries._generated(spark, asked, mosaic).collect()
    assert {(r.z, r.x, r.y) for r in out} == set(vertices) and len(out) == 10
    for r in out:
        (low, high), v, t, _, extensions = decode(gzip.decompress(bytes(r.data)))
        own = vertices[r.z, r.x, r.y]
        assert r.code == spark.range(1).select(tiling.morton(F.lit(r.x), F.lit(r.y))).first()[0]
        assert (low, high) == pytest.approx((min(p.h for p in own), max(p.h for p in own)), rel=1e-6)
        assert len(v) == 361 and len(t) == 648 and len(extensions[1]) == 722
        wanted = sorted((int(p.vx / 255 * 32767 + 0.5), int(p.vy / 255 * 32767 + 0.5)) for p in own)
        assert np.abs(np.array(sorted(map(tuple, v[:, :2].tolist()))) - np.array(wanted)).max() <= 1
