"""Adaptive meshes of many tiles at once against one at a time, and against the plain incremental triangulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orograph.operators import adaptive, tile_meshes
from orograph.plans import inputs, mesh_queries


def test_stand_in_rasters_keep_their_values(spark, sf_dir):
    side = mesh_queries.SIDE
    c, r = f"(k % {side + 1})", f"(k div {side + 1})"
    h = F.expr(f"""transform(sequence(0L, {(side + 1) ** 2 - 1}L), k -> cast(
        tile % 7 * 3 + {c} * {r} / 900.0 + pow({c} - 20 * (tile % 9) - 40, 2) / 400.0 + if({r} > 100 + tile % 50, 12.0, 0.0) as float))""")
    wanted = {(t.x, t.y): t.h for t in inputs.mesh_tiles(spark, sf_dir).select("x", "y", h.alias("h")).collect()}
    assert {(t.x, t.y): t.heights for t in mesh_queries._grids(spark, sf_dir).collect()} == wanted and len(wanted) == 10


def surfaces(n, side, seed):
    rng = np.random.default_rng(seed)
    return np.cumsum(np.cumsum(rng.normal(size=(n, side, side)), axis=1), axis=2)


def test_greedy_of_many_equals_each_alone():
    grids, most = surfaces(7, 33, 4), np.array([0.5, 3.0, 9.0, 1e9, 2.0, 0.0, 5.0])
    for (points, triangles), g, e in zip(adaptive.greedy_many(grids, most), grids, most, strict=True):
        p, t = adaptive.greedy(g, e)
        assert (points == p).all() and (triangles == t).all()


def test_remeshed_tiles_are_delaunay(spark):
    """The neighbours' places come in on every side, corners included, and no circle holds a point."""
    grids, side = surfaces(9, 17, 8), 16
    rows = [(5, 10 + i % 3, 10 + i // 3, g.ravel().tolist()) for i, g in enumerate(grids)]
    meshes = adaptive.triangulate(spark.createDataFrame(rows, "z long, x long, y long, heights array<double>"), "delatin", max_error=2.0)
    before = {(m.x, m.y): {(v.vx, v.vy): v.h for v in m.vertices} for m in meshes.collect()}
    out = {(m.x, m.y): m for m in adaptive.remesh(meshes, size=side).collect()}
    assert out.keys() == before.keys()
    for (x, y), m in out.items():
        wanted = set(before[x, y])
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                moved = {(vx + dx * side, vy - dy * side) for vx, vy in before.get((x + dx, y + dy), {})}
                wanted |= {(vx, vy) for vx, vy in moved if (dx or dy) and 0 <= vx <= side and 0 <= vy <= side}
        d = adaptive.Delaunay(side)
        for p in sorted(wanted - set(d.points)):
            d.insert(p)
        places = [(v.vx, v.vy) for v in m.vertices]
        assert places == d.points and all(v.h == before[x, y][v.vx, v.vy] for v in m.vertices if (v.vx, v.vy) in before[x, y])
        faces = [(t.a, t.b, t.c) for t in m.triangles]
        assert len(faces) == len(d.triangles) and sum(d._side(i, j, places[k]) for i, j, k in faces) == 2 * side * side
        assert not any(d._in_circle(t, p) for t in faces for p in places)


def test_adaptive_tiles_of_no_rows(spark):
    none = spark.createDataFrame([], "z long, x long, y long, heights array<double>")
    meshes = adaptive.remesh(adaptive.triangulate(none, "martini", max_error=1.0), size=16)
    assert tile_meshes.stitched_adaptive(adaptive.as_tiles(meshes), size=16).count() == 0
