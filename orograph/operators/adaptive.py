"""Adaptive meshes: right-triangulated networks, greedy insertion, and remeshing with neighbours.

Spark deals out tiles and gathers each tile's neighbours; one tile's mesh is a
small numpy problem (at most 257 x 257 pixels).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.operators import tile_meshes

Mesh = tuple[np.ndarray, np.ndarray]
_VERTICES = "vertices array<struct<vx: long, vy: long, h: double>>"
_TRIANGLES = "triangles array<struct<a: long, b: long, c: long>>"


@functools.cache
def _split_levels(side: int) -> list[tuple[np.ndarray, ...]]:
    """For each level of halving a grid of side + 1 pixels, from the coarsest: corners a, b, c and middle m of the triangles, as places in the grid's rows.

    Then, of each middle once, the numbers of the one or two triangles that have it. The halves of triangle i are i
    and i + n on the next level.
    """
    a, b, c = (np.array(p) for p in ([[0, 0], [side, side]], [[side, side], [0, 0]], [[side, 0], [0, side]]))
    flat = lambda p: (p[:, 1] * (side + 1) + p[:, 0]).astype(np.int32)
    levels = []
    while np.abs(a[0] - b[0]).max() > 1:
        m = (a + b) // 2
        at = flat(m)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        last = np.r_[first[1:], len(at)] - 1
        levels.append((flat(a), flat(b), flat(c), at, order[first], order[last]))
        a, b, c = np.concatenate([c, b]), np.concatenate([a, c]), np.concatenate([m, m])
    levels.append((flat(a), flat(b), flat(c)))
    return levels


def rtin(height: np.ndarray, max_error: float) -> Mesh:
    """(pixel places (col, row), triangles) of a right-triangulated irregular network on a (2^k + 1)² grid."""
    levels, h = _split_levels(len(height) - 1), height.ravel()
    error, below = np.zeros(h.size), None
    for a, b, _, m, first, last in levels[-2::-1]:
        own = np.abs((h[a] + h[b]) / 2 - h[m])
        if below is not None:
            own = np.maximum(own, error[below].reshape(2, -1).max(axis=0))
        error[m[first]] = np.maximum(own[first], own[last])
        below = m
    done, rows = [], np.arange(2)
    for a, b, c, *middle in levels:
        split = error[middle[0][rows]] > max_error if middle else np.zeros(len(rows), bool)
        whole = rows[~split]
        done.append(np.stack([a[whole], b[whole], c[whole]], axis=1))
        rows = np.concatenate([rows[split], rows[split] + len(a)])
    corners = np.concatenate(done)
    used, number = np.unique(corners, return_inverse=True)
    places = np.stack([used % len(height), used // len(height)], axis=1).astype(np.int64)
    order = np.lexsort((places[:, 1], places[:, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return places[order], rank[number].reshape(-1, 3)


Triangle = tuple[int, int, int]


def _named(i: int, j: int, k: int) -> Triangle:
    """A triangle begins with its smallest corner."""
    return (i, j, k) if i < j and i < k else (j, k, i) if j < k else (k, i, j)


class Delaunay:
    """Incremental Delaunay triangulation of whole-number points in a square; all predicates are exact.

    ``third`` has the third corner behind each directed edge, so the triangle
    around a point is walked to from the last one, and those whose circle holds
    the point are found from there over their edges.
    """

    def __init__(self, size: int):
        self.points = [(0, 0), (size, 0), (0, size), (size, size)]
        self.third: dict[tuple[int, int], int] = {}
        for t in ((0, 1, 2), (2, 1, 3)):
            self._add(t)
        self.last = (0, 1)

    def _add(self, t: Triangle) -> None:
        i, j, k = t
        self.third[i, j], self.third[j, k], self.third[k, i] = k, i, j

    @property
    def triangles(self) -> set[Triangle]:
        return {_named(i, j, k) for (i, j), k in self.third.items()}

    def _side(self, i: int, j: int, p: tuple[int, int]) -> int:
        (ax, ay), (bx, by) = self.points[i], self.points[j]
        return (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)

    def _in_circle(self, t: Triangle, p: tuple[int, int]) -> bool:
        (ax, ay), (bx, by), (cx, cy) = ((self.points[i][0] - p[0], self.points[i][1] - p[1]) for i in t)
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        return a * (bx * cy - by * cx) - b * (ax * cy - ay * cx) + c * (ax * by - ay * bx) > 0

    def _around(self, p: tuple[int, int]) -> Triangle:
        i, j = self.last
        while True:
            k = self.third[i, j]
            if self._side(j, k, p) < 0:
                i, j = k, j
            elif self._side(k, i, p) < 0:
                i, j = i, k
            elif self._side(i, j, p) < 0:
                i, j = j, i
            else:
                return i, j, k

    def insert(self, p: tuple[int, int]) -> tuple[set[Triangle], list[Triangle]]:
        """(removed, added) triangles; p must not be a vertex yet."""
        n = len(self.points)
        first = self._around(p)
        self.points.append(p)
        bad, todo, border = {_named(*first)}, [first], []
        while todo:
            i, j, k = todo.pop()
            for a, b in ((i, j), (j, k), (k, i)):
                c = self.third.get((b, a))
                t = None if c is None else _named(b, a, c)
                if t in bad:
                    continue
                if t is not None and self._in_circle(t, p):
                    bad.add(t)
                    todo.append(t)
                else:
                    border.append((a, b))
        for i, j, k in bad:
            del self.third[i, j], self.third[j, k], self.third[k, i]
        added = [_named(a, b, n) for a, b in sorted(border) if self._side(a, b, p) > 0]
        for t in added:
            self._add(t)
        self.last = added[0][:2]
        return bad, added


def _double_area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _worst_of_each(heights: np.ndarray, grid: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each triangle (n x 3 x 2, of positive area) on its grid the largest vertical error over its pixels but the corners, and its place (col, row).

    Ties go by row, then column; pixels without a height have no error. -1 where there is no such pixel. In each row a
    triangle's pixels are one span, along which its plane is a line.
    """
    side = heights.shape[-1]
    x, y = corners[..., 0], corners[..., 1]
    low = y.min(axis=1)
    count = y.max(axis=1) + 1 - low
    start = np.r_[0, np.cumsum(count)]
    own = np.repeat(np.arange(len(corners)), count)
    row = np.arange(len(own)) - start[own] + low[own]
    left, right = x.min(axis=1)[own], x.max(axis=1)[own]
    for k in range(3):  # inside is where (bx - ax) (row - ay) >= (by - ay) (col - ax)
        ax, ay, dx, dy = x[:, k], y[:, k], np.roll(x, -1, axis=1)[:, k] - x[:, k], np.roll(y, -1, axis=1)[:, k] - y[:, k]
        over, by = dx[own] * (row - ay[own]), dy[own]
        cut = ax[own] + np.where(by > 0, over // np.where(by > 0, by, 1), -(over // np.where(by < 0, -by, 1)))
        right, left = np.where(by > 0, np.minimum(right, cut), right), np.where(by < 0, np.maximum(left, cut), left)
    length = np.maximum(right - left + 1, 0)
    a, b, c = (heights[grid, y[:, k], x[:, k]] for k in range(3))
    area = _double_area(corners[:, 0], corners[:, 1], corners[:, 2])
    slope_x = ((b - a) * (y[:, 2] - y[:, 0]) - (c - a) * (y[:, 1] - y[:, 0])) / area
    slope_y = ((c - a) * (x[:, 1] - x[:, 0]) - (b - a) * (x[:, 2] - x[:, 0])) / area
    begin = a[own] + slope_x[own] * (left - x[own, 0]) + slope_y[own] * (row - y[own, 0])
    first = np.r_[0, np.cumsum(length)]
    along = np.arange(first[-1]) - np.repeat(first[:-1], length)
    at = along + np.repeat((grid[own] * side + row) * side + left, length)
    error = np.abs(np.repeat(begin, length) + np.repeat(slope_x[own], length) * along - heights.ravel()[at])
    error[np.isnan(error)] = -1.0
    spans = start[:-1, None] + y - low[:, None]
    error[(first[spans] + x - left[spans]).ravel()] = -1.0  # corners
    most = np.maximum.reduceat(error, first[start[:-1]])
    hit = np.flatnonzero(error == np.repeat(most, np.add.reduceat(length, start[:-1])))
    triangle = np.searchsorted(first[start[1:]], hit, side="right")
    hit = at[hit[np.r_[True, np.diff(triangle) > 0]]]
    return most, np.stack([hit % side, hit // side % side], axis=1)


def _worst(height: np.ndarray, corners: np.ndarray) -> tuple[float, tuple[int, int]]:
    """The same for one triangle."""
    error, place = _worst_of_each(height[None], np.zeros(1, np.int64), corners[None])
    return float(error[0]), (int(place[0, 0]), int(place[0, 1]))


def _winners(wanted: np.ndarray, n: int) -> np.ndarray:
    """Of rows of triangles (-1: none), those that share no triangle with an earlier row that asks for it."""
    rank = np.repeat(np.arange(len(wanted)), wanted.shape[1]).reshape(wanted.shape)
    first = np.empty(n + 1, np.int64)
    first[wanted.ravel()[::-1]] = rank.ravel()[::-1]  # the earliest is written last
    return ((first[wanted] == rank) | (wanted < 0)).all(axis=1)


def _edges(triangles: np.ndarray) -> np.ndarray:
    """For each half edge 3 * t + k, from corner k to the next one of triangle t, its other half, or -1."""
    i, j = triangles.ravel(), np.roll(triangles, -1, axis=1).ravel()
    key = np.minimum(i, j) << 32 | np.maximum(i, j)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    other = np.full(len(key), -1)
    other[order[at]], other[order[at + 1]] = order[at + 1], order[at]
    return other


def _next(half: np.ndarray, step: int) -> np.ndarray:
    return half // 3 * 3 + (half + step) % 3


def _flip(points: np.ndarray, triangles: np.ndarray, changed: np.ndarray) -> None:
    """Flip edges, many apart from each other at a time, until each circle around a triangle is empty; whole numbers, so exact.

    Only edges of ``changed`` triangles need it at first, then those of the ones that a flip made.
    """
    other, flat = _edges(triangles), triangles.reshape(-1)
    todo = np.flatnonzero(changed)
    while len(todo):
        half = (3 * todo[:, None] + np.arange(3)).ravel()
        half = half[other[half] >= 0]
        d = points[flat[_next(other[half], 2)]]
        (ax, ay), (bx, by), (cx, cy) = ((points[flat[_next(half, k)]] - d).T for k in range(3))
        a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bad = half[a * (bx * cy - by * cx) - b * (ax * cy - ay * cx) + c * (ax * by - ay * bx) > 0]
        won = _winners(np.stack([bad // 3, other[bad] // 3], axis=1), len(triangles))
        half, back = bad[won], other[bad[won]]
        t, u = half // 3, back // 3
        i, j, k, m = flat[half], flat[back], flat[_next(half, 2)], flat[_next(back, 2)]
        # the four outer edges move to (i, m, k) and (m, j, k)
        old = np.concatenate([_next(half, 1), _next(half, 2), _next(back, 1), _next(back, 2)])
        new = np.concatenate([3 * u + 1, 3 * t + 2, 3 * t, 3 * u])
        moved = np.arange(len(other))
        moved[old] = new
        beyond = other[old]
        beyond = np.where(beyond < 0, -1, moved[beyond])
        other[new], other[beyond[beyond >= 0]] = beyond, new[beyond >= 0]
        other[3 * t + 1], other[3 * u + 2] = 3 * u + 2, 3 * t + 1
        triangles[t], triangles[u] = np.stack([i, m, k], axis=1), np.stack([m, j, k], axis=1)
        changed[t] = changed[u] = True
        todo = np.unique(np.concatenate([t, u, bad[~won] // 3]))


def greedy(height: np.ndarray, max_error: float) -> Mesh:
    """The same by inserting pixels with large errors until none exceeds ``max_error``."""
    return greedy_many(height[None], np.array([max_error]))[0]


def greedy_many(heights: np.ndarray, max_error: np.ndarray) -> list[Mesh]:
    """The same for grids of one size at once, each as if it were alone.

    In a round each triangle whose largest error is over half of the largest of its grid gets that pixel, if no
    worse one touches it: a triangle is cut in three, the two at an edge in four. Then edges are flipped. Points
    and triangles of all grids stand in the same arrays, and no two grids share any.
    """
    n, side = len(heights), heights.shape[-1] - 1
    points = np.tile(np.array([(0, 0), (side, 0), (0, side), (side, side)]), (n, 1))
    triangles = (np.array([(0, 1, 2), (2, 1, 3)]) + 4 * np.arange(n)[:, None, None]).reshape(-1, 3)
    grid, of_point = np.repeat(np.arange(n), 2), np.repeat(np.arange(n), 4)
    error, place, changed = np.zeros(2 * n), np.zeros((2 * n, 2), np.int64), np.ones(2 * n, bool)
    while True:
        new = np.flatnonzero(changed)
        error[new], place[new] = _worst_of_each(heights, grid[new], points[triangles[new]])
        changed[:] = False
        most = np.zeros(n)
        np.maximum.at(most, grid, error)
        at = np.flatnonzero((error > max_error[grid]) & (2 * error >= most[grid]))
        if not len(at):
            return [_of_one(points[of_point == g], np.flatnonzero(of_point == g), triangles[grid == g]) for g in range(n)]
        at = at[np.lexsort((place[at, 0], place[at, 1], -error[at]))]
        corners = points[triangles[at]]
        on_edge = np.stack([_double_area(corners[:, k], corners[:, (k + 1) % 3], place[at]) == 0 for k in range(3)], axis=1)
        half = 3 * at + on_edge.argmax(axis=1)
        back = np.where(on_edge.any(axis=1), _edges(triangles)[half], -1)
        won = _winners(np.stack([at, np.where(back < 0, -1, back // 3)], axis=1), len(triangles))
        at, half, back, on_edge = at[won], half[won], back[won], on_edge[won].any(axis=1)
        p = len(points) + np.arange(len(at))
        points, of_point = np.concatenate([points, place[at]]), np.r_[of_point, grid[at]]
        flat = triangles.ravel()
        i, j, k, m = flat[half], flat[_next(half, 1)], flat[_next(half, 2)], flat[_next(back, 2)]
        inside, shared = ~on_edge, back >= 0
        made = [np.stack(t, axis=1) for t in ((p, j, k), (p[inside], i[inside], j[inside]), (j[shared], p[shared], m[shared]))]
        triangles = np.concatenate([triangles, *made])
        grid = np.concatenate([grid, grid[at], grid[at][inside], grid[at][shared]])
        triangles[at] = np.stack([p, k, i], axis=1)
        triangles[back[shared] // 3] = np.stack([p, i, m], axis=1)[shared]
        grown = len(triangles) - len(error)
        error, place, changed = np.r_[error, np.zeros(grown)], np.concatenate([place, np.zeros((grown, 2), np.int64)]), np.r_[changed, np.ones(grown, bool)]
        changed[at] = changed[back[shared] // 3] = True
        _flip(points, triangles, changed)


def _of_one(points: np.ndarray, numbers: np.ndarray, triangles: np.ndarray) -> Mesh:
    """One grid's points, which have these numbers, and its triangles in order, each from its smallest corner on."""
    own = np.searchsorted(numbers, triangles)
    named = np.take_along_axis(own, (own.argmin(axis=1)[:, None] + np.arange(3)) % 3, axis=1)
    return points, named[np.lexsort(named.T[::-1])]


def regular(height: np.ndarray, max_error: float) -> Mesh:
    """A plain lattice of 18 cells at most, whatever the error: what an unknown method gives."""
    side = len(height) - 1
    n = min(18, side)
    line = np.r_[(np.arange(n) * (side / n)).astype(np.int64), side]
    ys, xs = (g.ravel() for g in np.meshgrid(line, line, indexing="ij"))
    at = (np.arange(n)[:, None] * (n + 1) + np.arange(n)).ravel()
    return np.column_stack([xs, ys]), np.concatenate([np.stack([at, at + 1, at + n + 1], 1), np.stack([at + n + 1, at + 1, at + n + 2], 1)])


MESHERS: dict[str, Callable[[np.ndarray, float], Mesh]] = {"martini": rtin, "delatin": greedy}


def _lists(counts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
    """Lists of so many structs each."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def _rows(keys: list, vertices: pa.Array, triangles: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, vertices.cast(_SCHEMA.field("vertices").type), triangles.cast(_SCHEMA.field("triangles").type)], schema=_SCHEMA)


_SCHEMA = pa.schema(
    [*((c, pa.int64()) for c in "zxy"), ("vertices", pa.list_(pa.struct([("vx", pa.int64()), ("vy", pa.int64()), ("h", pa.float64())]))), ("triangles", pa.list_(pa.struct([(k, pa.int64()) for k in "abc"])))]
)


#: Grids that greedy insertion works on at once.
AT_ONCE = 32


def _meshes(mesher: Callable[[np.ndarray, float], Mesh], grids: list[np.ndarray], most: list[float]) -> list[Mesh]:
    if mesher is not greedy:
        return [mesher(g, e) for g, e in zip(grids, most, strict=True)]
    made: list = [None] * len(grids)
    for side in {len(g) for g in grids}:
        same = [i for i, g in enumerate(grids) if len(g) == side]
        for at in (same[k : k + AT_ONCE] for k in range(0, len(same), AT_ONCE)):
            for i, m in zip(at, greedy_many(np.stack([grids[i] for i in at]), np.array([most[i] for i in at])), strict=True):
                made[i] = m
    return made


def triangulate(grids: DataFrame, method: str, *, max_error: float | str) -> DataFrame:
    """z, x, y, vertices (vy from the south), triangles from ``heights``, the rows of a square raster, north first.

    ``max_error`` may be a column of the grids. An unknown method gives a plain lattice.
    """
    mesher = MESHERS.get(method, regular)
    grids = grids.select("z", "x", "y", "heights", (F.col(max_error) if isinstance(max_error, str) else F.lit(float(max_error))).cast("double").alias("most"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, AT_ONCE) for k in range(0, whole.num_rows, AT_ONCE)):
                flat = [h.values.to_numpy(zero_copy_only=False).astype(np.float64) for h in b.column("heights")]
                grids = [f.reshape(side := int(round(len(f) ** 0.5)), side) for f in flat]
                made = _meshes(mesher, grids, b.column("most").to_pylist())
                at, faces = np.concatenate([p for p, _ in made]), np.concatenate([t for _, t in made])
                n = np.array([len(p) for p, _ in made])
                height = np.concatenate([g[p[:, 1], p[:, 0]] for g, (p, _) in zip(grids, made, strict=True)])
                south = np.repeat([len(g) - 1 for g in grids], n) - at[:, 1]
                vertices = _lists(n, {"vx": at[:, 0], "vy": south, "h": height})
                yield _rows([b.column(c) for c in "zxy"], vertices, _lists(np.array([len(t) for _, t in made]), dict(zip("abc", faces.T, strict=True))))

    return grids.mapInArrow(run, f"z long, x long, y long, {_VERTICES}, {_TRIANGLES}")


def _insert_on_sides(points: np.ndarray, tile: np.ndarray, added: np.ndarray, triangles: np.ndarray, size: int) -> np.ndarray:
    """The triangles after points ``added`` (numbers) on the sides of their tiles have cut those that lie there into fans."""
    for axis, end in ((0, 0), (0, size), (1, 0), (1, size)):
        on = points[:, axis] == end
        mine = added[on[added]]
        half = np.flatnonzero(on[triangles.ravel()] & on[np.roll(triangles, -1, axis=1).ravel()])
        flat, along = triangles.ravel(), points[:, 1 - axis]
        i, j = flat[half], flat[_next(half, 1)]
        order = np.argsort(tile[i] * (size + 1) + np.minimum(along[i], along[j]))
        half, i, j = half[order], i[order], j[order]
        edge = np.searchsorted(tile[i] * (size + 1) + np.minimum(along[i], along[j]), tile[mine] * (size + 1) + along[mine], side="right") - 1
        ahead = np.where(along[i] < along[j], 1, -1)[edge]
        by = np.lexsort((along[mine] * ahead, edge))
        mine, edge = mine[by], edge[by]
        last = np.r_[np.diff(edge) > 0, True][: len(edge)]
        first = np.r_[True, np.diff(edge) > 0][: len(edge)]
        after = np.where(last, j[edge], np.roll(mine, -1))
        fans = np.stack([mine, after, flat[_next(half[edge], 2)]], axis=1)
        cut = triangles.ravel().copy()
        cut[_next(half[edge[first]], 1)] = mine[first]
        triangles = np.concatenate([cut.reshape(-1, 3), fans])
    return triangles


def remeshed(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Delaunay meshes of tiles with what is ``around`` them."""
    n, tile, items = tile_meshes.lists(batch.column("v"))
    m, of_face, faces = tile_meshes.lists(batch.column("t"))
    _, other, near = tile_meshes.lists(batch.column("around"))
    own, theirs = (np.stack([tile_meshes.numbers(p, c) for c in ("vx", "vy")], axis=1).astype(np.int64) for p in (items, near))
    h, their_h = tile_meshes.numbers(items, "h"), tile_meshes.numbers(near, "h")
    code = lambda t, p: (t * (size + 1) + p[:, 0]) * (size + 1) + p[:, 1]
    new = np.flatnonzero(~np.isin(code(other, theirs), code(tile, own)))
    new = new[np.lexsort((their_h[new], code(other, theirs)[new]))]
    new = new[np.r_[True, np.diff(code(other, theirs)[new]) > 0][: len(new)]]  # the lowest of each place
    points, of_point, h = np.concatenate([own, theirs[new]]), np.r_[tile, other[new]], np.r_[h, their_h[new]]
    triangles = np.stack([tile_meshes.numbers(faces, k) for k in "abc"], axis=1) + np.r_[0, np.cumsum(n)][of_face][:, None]
    turned = _double_area(*(points[triangles[:, k]] for k in range(3))) < 0
    triangles[turned] = triangles[turned][:, [0, 2, 1]]
    triangles = _insert_on_sides(points, of_point, np.arange(len(own), len(points)), triangles, size)
    _flip(points, triangles, np.ones(len(triangles), bool))
    # the corners stand first, then points by column and row; triangles by number
    corner = ((points == 0) | (points == size)).all(axis=1)
    order = np.lexsort((np.where(corner, points[:, 0], points[:, 1]), np.where(corner, points[:, 1], points[:, 0]), ~corner, of_point))
    counts = np.bincount(of_point, minlength=len(n))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    of_face = of_point[triangles[:, 0]]
    named = number[triangles]
    named = np.take_along_axis(named, (named.argmin(axis=1)[:, None] + np.arange(3)) % 3, axis=1)
    named = named[np.lexsort((*named.T[::-1], of_face))]
    vertices = _lists(counts, {"vx": points[order, 0], "vy": points[order, 1], "h": h[order]})
    return _rows([batch.column(c) for c in "zxy"], vertices, _lists(np.bincount(of_face, minlength=len(n)), dict(zip("abc", named.T, strict=True))))


def remesh(meshes: DataFrame, *, size: int) -> DataFrame:
    """Delaunay meshes of each tile's own vertices and its neighbours' edge vertices.

    Neighbours exchange only edge vertices, so both sides of an edge get the
    same points; heights where two tiles disagree are the tile's own. What comes
    from the neighbours cuts the triangles on the edges, then edges are flipped.
    """
    tiles = meshes.select("z", "x", "y", F.col("vertices").alias("v"), F.col("triangles").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                yield remeshed(whole.slice(k, AT_ONCE), size)

    return tile_meshes.gathered(tiles, ["h"], size=size).mapInArrow(run, f"z long, x long, y long, {_VERTICES}, {_TRIANGLES}")


def as_tiles(meshes: DataFrame) -> DataFrame:
    """The meshes as ``tile_meshes`` has them."""
    v = F.transform("vertices", lambda p, i: F.struct(i.cast("long").alias("vid"), p["vx"].alias("vx"), p["vy"].alias("vy"), p["h"].alias("h")))
    return meshes.select("z", "x", "y", v.alias("v"), F.col("triangles").alias("t"))


def flatten(meshes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of vertices (vid, vx, vy, h) and of triangles (tid, a, b, c)."""
    vertices = meshes.select("z", "x", "y", F.posexplode("vertices").alias("vid", "v")).select("z", "x", "y", F.col("vid").cast("long").alias("vid"), "v.*")
    triangles = meshes.select("z", "x", "y", F.posexplode("triangles").alias("tid", "t")).select("z", "x", "y", F.col("tid").cast("long").alias("tid"), "t.*")
    return vertices, triangles
