"""Meshes that SQL cannot express: an independent decoder, error bounds, coverage, and the stream against batch."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest

from orograph import plans
from orograph.operators import adaptive, encode
from orograph.plans import inputs


def decode(data: bytes):
    """Vertices (u, v, q), triangles, edges, extensions of quantized-mesh bytes."""
    low, high = struct.unpack_from("<ff", data, 24)
    (n,) = struct.unpack_from("<I", data, 88)
    at, columns = 92, []
    for _ in range(3):
        codes = np.frombuffer(data, "<u2", n, at).astype(np.int64)
        columns.append(np.cumsum((codes >> 1) ^ -(codes & 1)))
        at += 2 * n
    kind, width = ("<u2", 2) if n <= 65536 else ("<u4", 4)
    at += -at % width
    (m,) = struct.unpack_from("<I", data, at)
    codes = np.frombuffer(data, kind, 3 * m, at + 4)
    at += 4 + 3 * m * width
    highest, indices = 0, []
    for c in codes.tolist():
        indices.append(highest - c)
        highest += c == 0
    edges = []
    for _ in range(4):
        (k,) = struct.unpack_from("<I", data, at)
        edges.append(np.frombuffer(data, kind, k, at + 4))
        at += 4 + k * width
    extensions = {}
    while at < len(data):
        i, size = struct.unpack_from("<BI", data, at)
        extensions[i] = data[at + 5 : at + 5 + size]
        at += 5 + size
    return (low, high), np.column_stack(columns), np.array(indices).reshape(-1, 3), edges, extensions


def test_encoded_tiles_decode(spark, sf_dir):
    out = plans.QUERIES["encode_grid_tiles"](spark, sf_dir).collect()
    assert len(out) == 10
    for r in out:
        (low, high), v, t, edges, extensions = decode(gzip.decompress(bytes(r.data)))
        assert len(v) == 36 * 36 and len(t) == 2 * 35 * 35 and low < high
        assert v.min() == 0 and v.max() == 32767 and sorted(np.unique(t)) == list(range(1296))
        assert [len(e) for e in edges] == [36] * 4 and (v[edges[0], 0] == 0).all() and (v[edges[3], 1] == 32767).all()
        assert len(extensions[encode.OCT_NORMALS]) == 2 * 1296
        a, b, c = (v[t[:, i], :2] for i in range(3))
        area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum()
        assert area == 2 * 32767**2  # the triangles cover the tile


def test_large_mesh_has_wide_indices():
    n = 300
    xs, ys = (g.ravel() for g in np.meshgrid(np.linspace(0, 1, n), np.linspace(0, 1, n)))
    i = (np.arange(n - 1)[:, None] * n + np.arange(n - 1)).ravel()
    triangles = np.concatenate([np.stack([i, i + 1, i + n], 1), np.stack([i + n, i + 1, i + n + 1], 1)])
    ecef = np.column_stack([xs * 100 + 6.4e6, ys * 100, xs * 0])
    _, v, t, _, _ = decode(encode.encode(encode.Mesh(np.column_stack([xs, ys, xs * 0]), ecef, triangles), (0, 0, 1, 1)))
    assert len(v) == n * n and len(t) == len(triangles) and (v[:, 2] == 0).all()


def surface(size, seed):
    rng = np.random.default_rng(seed)
    return np.cumsum(np.cumsum(rng.normal(size=(size, size)), axis=0), axis=1)


@pytest.mark.parametrize("method", sorted(adaptive.MESHERS))
@pytest.mark.parametrize("limit", [0.5, 5.0, 1e9])
def test_adaptive_meshes_keep_the_error(method, limit):
    h = surface(17, 2)
    at, triangles = adaptive.MESHERS[method](h, limit)
    a, b, c = (at[triangles[:, i]] for i in range(3))
    assert np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() == 2 * 16 * 16
    worst = max(adaptive._worst(h, at[t])[0] for t in (x if _left(at[x]) else x[::-1] for x in triangles))
    assert limit == 1e9 or method == "martini" or worst <= limit
    assert len(triangles) == 2 or limit < 1e9


def _left(p):
    return (p[1] - p[0])[0] * (p[2] - p[0])[1] - (p[1] - p[0])[1] * (p[2] - p[0])[0] > 0


def test_remeshed_tiles_share_their_edges(spark, sf_dir):
    out = {(r.x, r.y): r for r in plans.QUERIES["martini_remesh"](spark, sf_dir).collect()}
    for (x, y), r in out.items():
        if other := out.get((x + 1, y)):
            assert {v.vy for v in r.vertices if v.vx == 256} == {v.vy for v in other.vertices if v.vx == 0}
        assert sum(_area(r, t) for t in r.triangles) == 2 * 256 * 256


def test_adaptive_tiles_agree_on_their_edges(spark, sf_dir):
    places, shared = {}, 0
    for r in plans.QUERIES["martini_vertices"](spark, sf_dir).collect():
        at = r.z, r.x * 256 + r.vx, r.y * 256 + 256 - r.vy
        shared += at in places
        assert places.setdefault(at, (r.h, r.nx, r.ny, r.nz)) == pytest.approx((r.h, r.nx, r.ny, r.nz), abs=1e-12)
    assert shared > 100


def test_delaunay_against_every_circle():
    rng = np.random.default_rng(5)
    d = adaptive.Delaunay(40)
    for p in {tuple(map(int, p)) for p in rng.integers(0, 41, (150, 2))} - set(d.points):
        d.insert(p)
    assert sum(d._side(i, j, d.points[k]) for i, j, k in d.triangles) == 2 * 40 * 40
    assert not any(d._in_circle(t, p) for t in d.triangles for p in d.points)


@pytest.mark.parametrize("name", ["martini_tiles", "delatin_tiles"])
def test_adaptive_tiles_decode(spark, sf_dir, name):
    out = plans.QUERIES[name](spark, sf_dir).collect()
    assert len(out) == 10
    for r in out:
        _, v, t, _, extensions = decode(gzip.decompress(bytes(r.data)))
        assert len(extensions[encode.OCT_NORMALS]) == 2 * len(v) and v.min() == 0 and v.max() == 32767
        a, b, c = (v[t[:, i], :2] for i in range(3))
        assert np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() == 2 * 32767**2


def _area(r, t):
    (ax, ay), (bx, by), (cx, cy) = ((r.vertices[i].vx, r.vertices[i].vy) for i in (t.a, t.b, t.c))
    return abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def test_stream_equals_batch(spark, sf_dir):
    streamed = plans.QUERIES["stream_dedup"](spark, sf_dir).select("z", "x", "y")
    assert sorted(streamed.collect()) == sorted(inputs.requests(spark, sf_dir).select("z", "x", "y").distinct().collect())


@pytest.mark.parametrize("name, size", [("grid_heights", 255), ("martini_heights", 256)])
def test_heights_of_all_tiles(spark, tmp_path, name, size):
    keys = [5, 199, 200, 990]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert {t: sum(r.tile == t for r in rows) for t in keys} == dict.fromkeys(keys, 36) and len(rows) == 144
    assert all(r.h == (r.tile * 31 + r.vx * 7 + (size - r.vy) * 13) % 97 for r in rows)


@pytest.mark.parametrize("max_error", [0.0, 3.0, 12.0])
def test_greedy_keeps_the_error_and_empty_circles(max_error):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:33, 0:33]
    height = 40 * np.sin(x / 5) * np.cos(y / 7) + rng.normal(0, 2, (33, 33))
    height[4, 9] = np.nan  # a pixel without a height asks for nothing
    points, triangles = adaptive.greedy(height, max_error)
    assert len(np.unique(points, axis=0)) == len(points)
    a, b, c = (points[triangles[:, k]] for k in range(3))
    area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    assert (area > 0).all() and area.sum() == 2 * 32 * 32
    for (i, j, k), (p, q, r) in zip(triangles.tolist(), points[triangles].tolist(), strict=True):
        d = points - np.array(r)
        (ax, ay), (bx, by) = np.array(p) - r, np.array(q) - r
        s = ax * ax + ay * ay, bx * bx + by * by, (d**2).sum(axis=1)
        circle = s[2] * (ax * by - bx * ay) - s[0] * (d[:, 0] * by - bx * d[:, 1]) - s[1] * (ax * d[:, 1] - d[:, 0] * ay)
        assert (circle >= 0).all()  # no point lies inside the circle around the triangle
        for col in range(min(p[0], q[0], r[0]), max(p[0], q[0], r[0]) + 1):
            for row in range(min(p[1], q[1], r[1]), max(p[1], q[1], r[1]) + 1):
                w = [(v[0] - u[0]) * (row - u[1]) - (v[1] - u[1]) * (col - u[0]) for u, v in ((q, r), (r, p), (p, q))]
                if min(w) >= 0:
                    plane = sum(n * height[o[1], o[0]] for n, o in zip(w, (p, q, r), strict=True)) / sum(w)
                    assert np.isnan(height[row, col]) or abs(plane - height[row, col]) <= max_error + 1e-9
