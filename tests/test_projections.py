"""Projections against known places and round trips; tiles from rasters in metres."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tile_read import LEFT, TOP, WIDTH, stored, tile

from orograph.functions import projections
from orograph.operators import tile_read
from orograph.sources import geotiff

ZONE = int((LEFT + 180) // 6) + 1


def test_known_places():
    # the meridian's length to 45 degrees, and half the equator
    x, y = projections.project(32631, np.array([3.0, 3.0]), np.array([0.0, 45.0]))
    assert x == pytest.approx([500_000, 500_000], abs=1e-6) and y == pytest.approx([0, 0.9996 * 4_984_944.378], abs=1e-3)
    assert projections.project(32731, np.array([3.0]), np.array([-45.0]))[1] == pytest.approx([10_000_000 - 0.9996 * 4_984_944.378], abs=1e-3)
    assert projections.project(3857, np.array([180.0]), np.array([85.0511287798066]))[0] == pytest.approx([20037508.342789244], abs=1e-6)
    assert projections.project(3857, np.array([180.0]), np.array([85.0511287798066]))[1] == pytest.approx([20037508.342789244], abs=1e-4)


@pytest.mark.parametrize("code", [3857, 32601, 32633, 32760, 25832])
def test_round_trips(code):
    rng = np.random.default_rng(1)
    zone = projections.zone_of(code)
    lon = rng.uniform(-6, 6, 500) + (zone[0] * 6 - 183 if zone else 0)
    lat = rng.uniform(-80, 80, 500)
    back = projections.unproject(code, *projections.project(code, lon, lat))
    assert np.abs(back[0] - lon).max() < 1e-8 and np.abs(back[1] - lat).max() < 1e-8


def test_columns_equal_arrays(spark):
    rows = [(c, float(lon), float(lat)) for c in (3857, 32631, 32731, 25831) for lon, lat in ((3, 10), (5.5, -60), (0.1, 79))]
    df = spark.createDataFrame(rows, "c long, lon double, lat double")
    x, y = projections.project_columns(F.col("c"), F.col("lon"), F.col("lat"))
    for r in df.select("c", "lon", "lat", x.alias("x"), y.alias("y")).collect():
        wanted = projections.project(r.c, np.array([r.lon]), np.array([r.lat]))
        assert (r.x, r.y) == pytest.approx((wanted[0][0], wanted[1][0]), abs=1e-6)


def plane(lon, lat):
    return (lon - LEFT) / WIDTH * 1000 + (TOP - lat) / WIDTH * 700


@pytest.mark.parametrize(("code", "method"), [(3857, "bilinear"), (32600 + ZONE, "nearest"), (32600 + ZONE, "bilinear"), (32600 + ZONE, "average"), (3857, "mode")])
def test_tiles_from_rasters_in_metres(spark, tmp_path, code, method):
    """Each vertex is right to less than half a pixel, in every block of a raster that is turned against the tile."""
    corners = projections.project(code, np.array([LEFT, LEFT + WIDTH, LEFT, LEFT + WIDTH]), np.array([TOP, TOP, TOP - WIDTH, TOP - WIDTH]))
    n, left, top = 300, corners[0].min(), corners[1].max()
    pixel = max(np.ptp(corners[0]), np.ptp(corners[1])) / (n - 20)
    left, top = left - 10 * pixel, top + 10 * pixel
    x, y = np.meshgrid(left + (np.arange(n) + 0.5) * pixel, top - (np.arange(n) + 0.5) * pixel)
    grid = plane(*projections.unproject(code, x, y))
    found = stored(spark, tmp_path / "a", a=geotiff.encode(grid, left, top, pixel, block=64, crs=code))
    out = tile_read.tile_vertices(tile(spark), found, cells=15, method=method, no_data=-1e9).collect()
    step = np.abs(np.diff(grid, axis=0)).max() + np.abs(np.diff(grid, axis=1)).max()
    for r in out:
        wanted = plane(LEFT + (r.vx + 0.5) / 256 * WIDTH, TOP - (255 - r.vy + 0.5) / 256 * WIDTH)
        assert abs(r.h - wanted) < {"nearest": 0.5, "bilinear": 0.01, "average": 0.5, "mode": 1.1}[method] * step + 1e-3


def test_unknown_systems(spark, tmp_path):
    found = stored(spark, tmp_path / "a", a=geotiff.encode(np.ones((8, 8)), 0, 0, 1, crs=2154))
    assert [r.error for r in found.collect()] == ["coordinate system 2154 is not known"]
    assert {r.h for r in tile_read.tile_vertices(tile(spark), found, cells=3, no_data=2.0).collect()} == {2.0}
