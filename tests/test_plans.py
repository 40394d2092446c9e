"""How joins of rows that are made from few small ones are planned: Spark takes them for small, so they would be sent whole to every executor."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orograph import plans
from orograph.operators import mesh, raster, serve, stitch, tables, tile_meshes
from orograph.plans import inputs


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["resample_bilinear", "resample_cubic", "resample_cubic_spline", "resample_lanczos"])
def test_pixels_are_not_sent_whole(spark, sf_dir, name):
    assert "BroadcastHashJoin" not in planned(plans.QUERIES[name](spark, sf_dir))


def test_only_pixels_under_vertices_are_exchanged(spark):
    tiles = spark.createDataFrame([(7, x, 0) for x in range(3)], "z long, x long, y long")
    line = F.expr("sequence(0L, 255L)")
    pixels = tiles.withColumn("row", F.explode(line)).withColumn("col", F.explode(line)).withColumn("h", (F.col("row") * 1000 + F.col("col")).cast("double"))
    got = mesh.sample(mesh.grid_vertices(tiles, 5), pixels)
    assert "SortMergeJoin" in planned(got) and planned(got).count("BroadcastHashJoin") == 1  # of places alone
    rows = got.collect()
    assert len(rows) == 3 * 36 and all(r.h == (255 - r.vy) * 1000 + r.vx for r in rows)


def test_tiles_are_dealt_by_their_number(spark):
    assert tables.spread(spark.range(250), "id", each=100).rdd.getNumPartitions() == 3
    assert tables.spread(spark.range(0), "id", each=100).rdd.getNumPartitions() == 1


def test_taps_are_added_in_one_order(spark):
    """1e16 + 1 - 1e16 and the like: the sum hangs on the order, and that is by row and column for any number of partitions."""
    values = {(0, 0): 1e16, (0, 1): 1.0, (1, 0): -1e16, (1, 1): 1.0}
    points = spark.createDataFrame([(t, 0, 0.5, 0.5) for t in range(20)], "tile long, pid long, px double, py double")
    rows = [(t, r, c, h) for t in range(20) for (r, c), h in values.items()]
    for n in (1, 3):
        pixels = spark.createDataFrame(rows[::-1], "tile long, row long, col long, h double").repartition(n)
        got = {r.h for r in raster.interpolate(points, pixels, ["tile"], "bilinear").collect()}
        assert got == {(((2.5e15 + 0.25) - 2.5e15) + 0.25) / 1.0}


def test_lists_of_tiles_are_not_sent_whole(spark, sf_dir):
    for name in ("encode_grid_tiles", "gzip_roundtrip"):
        assert "BroadcastHashJoin" not in planned(plans.QUERIES[name](spark, sf_dir))


def test_stitching_tiles_as_lists_equals_stitching_rows(spark, sf_dir):
    """Against windows and joins over rows."""
    tiles = inputs.mesh_tiles(spark, sf_dir)
    v = mesh.grid_vertices(tiles, 4).withColumn("h", F.expr(inputs.HEIGHT)).drop("tile", "i", "j")
    t = mesh.grid_triangles(tiles, 4).drop("tile")
    normals = mesh.vertex_normals(mesh.to_ecef(mesh.rescale(v)), t)
    wanted = mesh.to_ecef(mesh.rescale(stitch.average_edges(v.join(normals, ["z", "x", "y", "vid"]), ["h", "nx", "ny", "nz"], size=mesh.GRID)))
    columns = ["z", "x", "y", "vid", "vx", "vy", "h", "lon", "lat", "px", "py", "pz", "nx", "ny", "nz"]
    got = tile_meshes.vertices(tile_meshes.stitched_grids(tile_meshes.grouped(v, t), size=mesh.GRID))
    a, b = (sorted(map(tuple, df.select(columns).collect())) for df in (got, wanted))
    assert len(a) == len(b) == 250 and all(p == pytest.approx(q, rel=1e-9, abs=1e-9) for p, q in zip(a, b, strict=True))
    grid = serve.GridStitcher().stitch(v, t)
    assert sorted(map(tuple, grid.select(columns).collect())) == a
