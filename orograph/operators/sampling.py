"""Heights of tiles' grid vertices, sampled where a block of pixels is read.

Each row in is a tile beside a block that it needs; the task reads the block's
bytes, decodes them and hands over, for each vertex that the block says
something about, sums from which the height is made once all blocks were seen.
Pixels never leave the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

from orograph.functions import projections
from orograph.sources import files, geotiff

#: Methods that weigh the pixels around a place (with the pixels on each side), and those that take all pixels under the tile's pixel.
KERNELS = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}
AREAS = ("average", "rms", "gauss", "mode")
METHODS = ("nearest", *KERNELS, *AREAS)

_KEY = ("z", "x", "y", "ordinal")
SCHEMA = "z long, x long, y long, ordinal long, vids array<long>, a array<double>, b array<double>, error string"
_ARROW = pa.schema([*((c, pa.int64()) for c in _KEY), ("vids", pa.list_(pa.int64())), ("a", pa.list_(pa.float64())), ("b", pa.list_(pa.float64())), ("error", pa.string())])


def _kernel(method: str, d: np.ndarray) -> np.ndarray:
    """Weight at a distance in pixels."""
    d = np.abs(d)
    if method == "bilinear":
        return np.maximum(0.0, 1.0 - d)
    if method == "cubic":  # Catmull-Rom
        return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1.0, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4.0 * d + 2.0, 0.0))
    if method == "cubic_spline":  # uniform B-spline
        return np.where(d < 1, (4.0 - 6.0 * d**2 + 3.0 * d**3) / 6.0, np.where(d < 2, (2.0 - d) ** 3 / 6.0, 0.0))
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0.0)  # lanczos


def weights(method: str, place: np.ndarray, first: int, count: int, footprint: float) -> np.ndarray:
    """A row for each place (in pixels from the raster's edge), a column for each of ``count`` pixels from ``first`` on.

    ``footprint`` is the width of the tile's pixel in pixels of the raster.
    """
    pixel = first + np.arange(count)
    if method == "nearest":
        return (pixel == np.floor(place)[:, None]).astype(float)
    return _weight(method, (place - 0.5)[:, None] - pixel, footprint)


def _weight(method: str, d: np.ndarray, footprint: float) -> np.ndarray:
    """Weight of a pixel whose centre lies so many pixels before a place."""
    if method in KERNELS:
        return _kernel(method, d)
    half = max(footprint, 1.0) / 2
    under = (d <= half) & (d > -half)
    return under * np.exp(-(d**2) / (2.0 * half**2)) if method == "gauss" else under.astype(float)


def _sums_at(method: str, grid: np.ndarray, valid: np.ndarray, x: np.ndarray, y: np.ndarray, footprint: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(touched, vertex, a, b) like ``_sums``, for places anywhere (in pixels from the block's edge); touched are all vertices with weight on the block."""
    rows, cols = grid.shape
    if method == "nearest":
        c, r, offsets = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64), [0]
    else:
        c, r = np.floor(x - 0.5).astype(np.int64), np.floor(y - 0.5).astype(np.int64)
        far = int(np.ceil(reach(method, footprint)))
        offsets = range(-far, far + 1)
    a, b, touched, found = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool), []
    for i in offsets:
        down = np.ones(len(x)) if method == "nearest" else _weight(method, y - 0.5 - (r + i), footprint)
        for j in offsets:
            w = down if method == "nearest" else down * _weight(method, x - 0.5 - (c + j), footprint)
            here = np.flatnonzero((w != 0) & (r + i >= 0) & (r + i < rows) & (c + j >= 0) & (c + j < cols))
            touched[here] = True
            here = here[valid[r[here] + i, c[here] + j]]
            h = grid[r[here] + i, c[here] + j]
            found.append((here, h))
            a[here] += w[here] * (h * h if method == "rms" else h)
            b[here] += w[here]
    vertex = np.unique(np.concatenate([f[0] for f in found]))
    if method == "mode":
        both = np.concatenate([np.stack([f[0].astype(float), f[1]]) for f in found], axis=1)
        (v, value), n = np.unique(both, axis=1, return_counts=True)
        return touched, v.astype(np.int64), value, n.astype(float)
    return touched, vertex, a[vertex], b[vertex]


def reach(method: str, footprint: float) -> float:
    """How many pixels on each side of a place can carry weight."""
    return KERNELS.get(method, 0.0) if method not in AREAS else max(footprint, 1.0) / 2 + 1


def lattice(cells: int, last: int) -> np.ndarray:
    """Places of the lines 0..cells: evenly spaced, cut to whole numbers, the last one exactly at the edge."""
    line = (np.arange(cells + 1) * (float(last) / cells)).astype(np.int64)
    line[-1] = last
    return line


def _sums(method: str, grid: np.ndarray, valid: np.ndarray, across: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, a, b) of the vertices with pixels here: a / b is the height, its square for rms; for mode a is a value and b its number."""
    seen = (down != 0).astype(float) @ valid @ (across != 0).astype(float).T
    if method == "mode":
        out = []
        for v in np.flatnonzero(seen):
            r, c = divmod(v, len(across))
            part = np.ix_(down[r] != 0, across[c] != 0)
            value, n = np.unique(grid[part][valid[part]], return_counts=True)
            out.append((np.full(len(value), v), value, n.astype(float)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    held = np.where(valid, grid * grid if method == "rms" else grid, 0.0)
    vertex = np.flatnonzero(seen)
    return vertex, (down @ held @ across.T).ravel()[vertex], (down @ valid @ across.T).ravel()[vertex]


class _Reader:
    """Blocks of files, the last one and its file kept."""

    def __init__(self):
        self.path = self.key = self.source = self.held = None

    def block(self, r: dict) -> tuple[np.ndarray, np.ndarray, int, int, str | None]:
        """Heights, where there is data, the first row and column, and why the block can't be read."""
        key = r["path"], r["level"], r["block"]
        if key != self.key:
            self.key, self.held = key, self._read(r)
        return self.held

    def _read(self, r: dict) -> tuple[np.ndarray, np.ndarray, int, int, str | None]:
        across = -(-r["width"] // r["block_width"])
        row, col = r["block"] // across * r["block_height"], r["block"] % across * r["block_width"]
        try:
            if r["path"] != self.path:
                self.close()
                system, at = files.locate(r["path"])
                self.path, self.source = r["path"], system.open_input_file(at)
            self.source.seek(r["offset"])
            grid = geotiff.decode(self.source.read(r["size"]), r)[: r["height"] - row, : r["width"] - col]
        except (OSError, ValueError, zlib.error, zstandard.ZstdError) as e:
            shape = min(r["block_height"], r["height"] - row), min(r["block_width"], r["width"] - col)
            return np.zeros(shape), np.zeros(shape, bool), row, col, f"{type(e).__name__}: {e}"
        valid = ~np.isnan(grid)
        return grid, valid if r["nodata"] is None else valid & (grid != r["nodata"]), row, col, None

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
        self.path = self.source = None


def whole_grid(method: str, side: int, no_data: float):
    """All partial rows of one tile to its heights, north first; ``no_data`` where no file has data."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        grid, ordinal = np.full(side * side, np.nan), rows.column("ordinal").to_numpy()
        lists = [rows.column(c).chunk(0) for c in ("vids", "a", "b")]
        ends = lists[0].offsets.to_numpy()
        owner = np.repeat(ordinal, np.diff(ends))
        every = [x.flatten().to_numpy() for x in lists]
        for o in np.unique(ordinal):
            v, a, b = (c[owner == o] for c in every)
            if method == "mode":
                order = np.lexsort((a, v))
                v, a, b = v[order], a[order], b[order]
                new = np.flatnonzero(np.r_[True, (np.diff(v) != 0) | (np.diff(a) != 0)]) if len(v) else np.zeros(0, np.int64)
                v, a, n = v[new], a[new], np.add.reduceat(b, new) if len(new) else b[:0]
                best = np.lexsort((-a, n))  # the last one written is the most frequent, then the lowest
                height = np.full(side * side, np.nan)
                height[v[best]] = np.where(n[best] > 0, a[best], np.nan)
            else:
                above, below = np.bincount(v, a, side * side), np.bincount(v, b, side * side)
                height = np.divide(above, below, out=np.full(side * side, np.nan), where=below != 0)
                height = np.sqrt(height) if method == "rms" else height
            grid = np.where(np.isnan(grid), height, grid)
        heights = np.where(np.isnan(grid), no_data, grid).reshape(side, side)[::-1].ravel()
        columns = [pa.array([k.as_py()], pa.int64()) for k in key]
        error = max((e for e in rows.column("error").to_pylist() if e), default=None)
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, side * side], pa.int32()), pa.array(heights)), pa.array([error], pa.string())], names=["z", "x", "y", "heights", "error"])

    return one


def _batch(rows: list[dict]) -> pa.RecordBatch:
    ends = pa.array(np.cumsum([0, *(len(r["vids"]) for r in rows)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(r[c], t) for r in rows]))) for c, t in (("vids", np.int64), ("a", float), ("b", float))]
    columns = [*(pa.array([r[k] for r in rows], pa.int64()) for k in _KEY), *(x.cast(_ARROW.field(c).type) for x, c in zip(lists, ("vids", "a", "b"), strict=True))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r["error"] for r in rows], pa.string())], schema=_ARROW)


def snapped(low: float, high: float, origin: float, pixel: float) -> tuple[float, float]:
    """A side of a box moved outwards to lines of a raster's grid, the origin being one of them."""
    return origin + np.floor((low - origin) / pixel + 1e-9) * pixel, origin + np.ceil((high - origin) / pixel - 1e-9) * pixel


def sampler(method: str, *, last: int, pixels: int, corners: bool = False, aligned: bool = False):
    """Rows of tiles beside blocks, in any order but best by block, to rows of ``SCHEMA``.

    Vertices lie in the middle of the tile's pixels, or with ``corners`` between
    them, so that neighbouring tiles share the places on their edges. With
    ``aligned`` the tile's box is moved outwards to the raster's grid first.
    """
    middle = 0.0 if corners else 0.5

    def one(reader: _Reader, r: dict) -> dict:
        key = {k: r[k] for k in _KEY}
        grid, valid, row, col, error = reader.block(r)
        width = 180.0 / 2.0 ** r["z"]
        pixel, line = width / pixels, lattice(r["cells"], last)
        west, north = -180.0 + r["x"] * width, 90.0 - r["y"] * width
        if aligned and r["crs"] is None:
            west, east = snapped(west, west + width, r["origin_x"], r["pixel_x"])
            south, north = snapped(north - width, north, r["origin_y"], r["pixel_y"])
            pixel, pixel_down = (east - west) / pixels, (north - south) / pixels
        else:
            pixel_down = pixel
        lon, lat = west + (line + middle) * pixel, north - (last - line + middle) * pixel_down
        if r["crs"] is not None:
            every_lon, every_lat = (g.ravel() for g in np.meshgrid(lon, lat))
            v = np.flatnonzero((every_lon >= r["left"]) & (every_lon <= r["right"]) & (every_lat <= r["top"]) & (every_lat >= r["bottom"]))
            x, y = projections.project(r["crs"], every_lon[v], every_lat[v])
            x, y = (x - r["origin_x"]) / r["unit_x"], (r["origin_y"] - y) / r["unit_y"]
            ok = (x >= 0) & (x < r["width"]) & (y >= 0) & (y < r["height"])
            v, x, y = v[ok], x[ok] - col, y[ok] - row
            touched, at, a, b = _sums_at(method, grid, valid, x, y, pixel / r["pixel_x"])
            if error:
                at = np.flatnonzero(touched)
                a = b = np.zeros(len(at))
            return key | {"vids": v[at], "a": a, "b": b, "error": error}
        inside_x, inside_y = np.flatnonzero((lon >= r["left"]) & (lon < r["right"])), np.flatnonzero((lat <= r["top"]) & (lat > r["bottom"]))
        across = weights(method, (lon[inside_x] - r["origin_x"]) / r["pixel_x"], col, grid.shape[1], pixel / r["pixel_x"])
        down = weights(method, (r["origin_y"] - lat[inside_y]) / r["pixel_y"], row, grid.shape[0], pixel_down / r["pixel_y"])
        if error:  # the vertices that the block would have a say in
            v = np.flatnonzero(np.outer((down != 0).any(1), (across != 0).any(1)))
            a = b = np.zeros(len(v))
        else:
            v, a, b = _sums(method, grid, valid, across, down)
        if len(v):
            v = inside_y[v // len(inside_x)] * (r["cells"] + 1) + inside_x[v % len(inside_x)]
        return key | {"vids": v, "a": a, "b": b, "error": error}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        try:
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    yield _batch([one(reader, r) for r in b.slice(at, 64).to_pylist()])
        finally:
            reader.close()

    return run
