"""Core operators on nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orograph.functions import tiling
from orograph.operators import cache, catalog, encode, mesh, stitch

TILES = "z long, x long, y long"
BOXES = "ordinal long, left double, bottom double, right double, top double"


def boxed(tiles):
    return tiles.withColumns(tiling.bounds(F.col("z"), F.col("x"), F.col("y"))).withColumn("ordinal", F.lit("x"))


@pytest.mark.parametrize("small", [0, 100])
def test_prune(spark, small):
    tiles = boxed(spark.createDataFrame([(3, 4, 2), (3, 5, 2), (None, 1, 1)], TILES))
    extents = [(1, -90.0, 40.0, -80.0, 50.0), (2, -67.5, 0.0, -67.5, 90.0), (3, None, 0.0, 1.0, 1.0), (4, 100.0, 0.0, 101.0, 1.0), (1, -90.0, 40.0, -80.0, 50.0)]
    got = sorted(map(tuple, catalog.prune(tiles, spark.createDataFrame(extents, BOXES), small=small).collect()))
    assert got == [(3, 4, 2, 1), (3, 4, 2, 1), (3, 4, 2, 2), (3, 5, 2, 2)]
    assert catalog.prune(tiles, spark.createDataFrame([], BOXES), small=small).count() == 0
    assert catalog.prune(tiles.where("z = 99"), spark.createDataFrame(extents, BOXES), small=small).count() == 0


def test_prune_against_all_pairs(spark):
    import random

    rng = random.Random(7)
    tiles = [(z, rng.randrange(2 ** (z + 1)), rng.randrange(2**z)) for z in range(8) for _ in range(12)]
    extents = []
    for i in range(150):
        w = 180 / 2 ** rng.randrange(8)
        left, bottom = -180 + w * rng.randrange(int(360 / w)), -90 + w * rng.randrange(int(180 / w))
        extents.append((i, left, bottom, left + w * rng.choice((0, 0.5, 1, 2)), bottom + w))
    t = boxed(spark.createDataFrame(tiles, TILES).distinct())
    e = spark.createDataFrame(extents, BOXES)
    ways = [sorted(map(tuple, catalog.prune(t, e, **o).collect())) for o in ({"small": 0}, {"small": 1000}, {"small": 0, "hot": 10}, {"small": 0, "hot": 3, "most_hot": 4})]
    wanted = sorted((r.z, r.x, r.y, o) for r in t.collect() for o, a, b, c, d in extents if not (r.left > c or r.right < a or r.bottom > d or r.top < b))
    assert all(w == wanted for w in ways)


def test_prune_of_mixed_sizes_grows_with_pairs(spark):
    """A world-wide extent and a tile of zoom 0 among very many small ones: covers stay small, each pair comes once."""
    n = 200_000
    small = spark.range(n).selectExpr("id as ordinal", "-180D + (id * 7919 % 36000) / 100D as left", "-90D + (id * 104729 % 17990) / 100D as bottom").selectExpr("*", "left + 0.01 as right", "bottom + 0.01 as top")
    extents = small.unionByName(spark.createDataFrame([(-1, -180.0, -90.0, 180.0, 90.0)], BOXES))
    tiles = [(0, 0, 0), (0, 1, 0), *((z, 2**z + z, 2**z // 3) for z in range(1, 19))]
    t = boxed(spark.createDataFrame(tiles, TILES))
    levels = [r[0] for r in catalog._levelled(t).select("_own").distinct().collect()]
    assert catalog.cover(extents).count() <= 4.2 * n
    assert catalog._around(extents, levels, itself=False).count() < 1.6 * n * len(levels)
    got = catalog.prune(t, extents, hot=20_000).groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("first")).collect()
    e = extents.alias("e")
    wanted = {tuple(r)[:3]: r.n for r in e.join(F.broadcast(t.alias("t")), tiling.intersects(catalog.box("t"), catalog.box("e"))).groupBy("t.z", "t.x", "t.y").agg(F.count("*").alias("n")).collect()}
    assert {(r.z, r.x, r.y): r.n for r in got} == wanted and all(r.n == r.d and r["first"] == -1 for r in got)


def test_meshes_of_no_tiles(spark):
    none = spark.createDataFrame([], TILES)
    v = mesh.grid_vertices(none, 4).withColumn("h", F.lit(1.0))
    t = mesh.grid_triangles(none, 4)
    p = mesh.to_ecef(mesh.rescale(stitch.average_edges(v, ["h"], size=mesh.GRID)))
    assert mesh.vertex_normals(p, t).count() == 0
    assert encode.encode_tiles(mesh.geocentric_normals(p), t).count() == 0
    assert stitch.expand(none).count() == 0


def test_cells_by_column(spark):
    tiles = spark.createDataFrame([(5, 1, 1, 3), (5, 2, 1, 300), (5, 3, 1, 1)], f"{TILES}, n long")
    sizes = {r.x: r["count"] for r in mesh.grid_vertices(tiles, "n").groupBy("x").count().collect()}
    faces = {r.x: r["count"] for r in mesh.grid_triangles(tiles, "n").groupBy("x").count().collect()}
    assert sizes == {1: 16, 2: 256 * 256, 3: 4} and faces == {1: 18, 2: 2 * 255 * 255, 3: 2}


def test_requests_with_nulls_and_repeats(spark):
    wanted = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 0), (2, None, 0, 0), (3, 0, 1, 0)], f"request long, {TILES}")
    cached = spark.createDataFrame([(0, 0, 0), (0, 0, 0)], TILES)
    got = {r.request: (r.wanted, r.have, r.ready) for r in cache.ready(wanted, cached, "request", ["z", "x", "y"]).collect()}
    assert got == {1: (2, 2, True), 2: (1, 0, False), 3: (1, 0, False)}
    assert cache.to_read(wanted, cached, cached.where("z > 5"), ["z", "x", "y"]).where("z is not null").count() == 1
    # a request at the world's corner needs four tiles
    assert stitch.inputs_of(spark.createDataFrame([(2, 0, 0, "a")], f"{TILES}, who string")).count() == 4
