"""Meshes with a row for each tile: z, x, y, vertices ``v`` and triangles ``t`` as lists, stitched with their neighbours.

What is exchanged are whole rows by tile, each with the vertices on its edges
for the neighbours; a task works on the arrays of all tiles of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from orograph.functions import geometry, tiling

KEY = ["z", "x", "y"]
PLACES, NORMALS = ["lon", "lat", "px", "py", "pz"], ["nx", "ny", "nz"]


def grouped(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """From rows of vertices (vid 0-based and gapless, vx, vy, h and any others) and of triangles (tid, a, b, c)."""
    rest = [c for c in vertices.columns if c not in (*KEY, "vid", "vx", "vy", "h")]
    v = vertices.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("vid", F.col("vx").cast("long").alias("vx"), F.col("vy").cast("long").alias("vy"), F.col("h").cast("double").alias("h"), *rest))).alias("v"))
    t = triangles.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("tid", "a", "b", "c"))).alias("t"))
    # both sides are far larger than Spark takes them for, so neither may be sent whole
    return v.join(t.hint("merge"), KEY)


def vertices(tiles: DataFrame) -> DataFrame:
    """Rows of vertices."""
    return tiles.select(*KEY, F.explode("v").alias("v")).select(*KEY, "v.*")


def gathered(tiles: DataFrame, values: Sequence[str], *, size: int) -> DataFrame:
    """The tiles with ``around``: the neighbours' vertices on shared edges (vx, vy and the values), in the tile's own places."""
    rest = [c for c in tiles.columns if c not in KEY]
    kinds = {f.name: f.dataType for f in tiles.schema["v"].dataType.elementType}
    edge_type = ArrayType(StructType([StructField(c, kinds[c]) for c in ("vx", "vy", *values)]))

    def inside(p: Column, dx: int, dy: int) -> Column:
        return (p["vx"] - dx * size).between(0, size) & (p["vy"] + dy * size).between(0, size)

    def moved(dx: int, dy: int) -> Column:
        there = F.filter("_e", lambda p: inside(p, dx, dy))
        return F.transform(there, lambda p: F.struct((p["vx"] - dx * size).alias("vx"), (p["vy"] + dy * size).alias("vy"), *(p[c].alias(c) for c in values))).cast(edge_type)

    whole = F.struct(*rest)
    own = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), whole.alias("w"), F.array().cast(edge_type).alias("e"))
    none = F.when(F.lit(False), whole)
    ring = F.array(own, *(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), none.alias("w"), moved(dx, dy).alias("e")) for _, dx, dy in tiling.DIRECTIONS))
    edge = F.filter("v", lambda p: p["vx"].isin(0, size) | p["vy"].isin(0, size))
    rows = tiles.withColumn("_e", edge).select(*KEY, F.explode(ring).alias("_r"))
    rows = rows.select("z", (F.col("x") + F.col("_r.dx")).alias("x"), (F.col("y") + F.col("_r.dy")).alias("y"), "_r.w", "_r.e")
    rows = rows.where(F.col("w").isNotNull() | (F.size("e") > 0) & tiling.in_matrix(F.col("z"), F.col("x"), F.col("y")))
    met = rows.groupBy(*KEY).agg(F.first("w", ignorenulls=True).alias("w"), F.flatten(F.collect_list("e")).alias("around"))
    return met.where("w is not null").select(*KEY, "w.*", "around")


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """(lengths, the number of the list of each item, all items)."""
    n = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return n, np.repeat(np.arange(len(n)), n), column.flatten()


def numbers(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


def joined(n: np.ndarray, items: pa.StructArray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), items).cast(kind)


def _ecef(lon: np.ndarray, lat: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    lam, phi = np.radians(lon), np.radians(lat)
    n = geometry.A / np.sqrt(1.0 - geometry.E2 * np.sin(phi) * np.sin(phi))
    return [(n + h) * np.cos(phi) * np.cos(lam), (n + h) * np.cos(phi) * np.sin(lam), (n * (1 - geometry.E2) + h) * np.sin(phi)]


def _face_normals(p: list[np.ndarray], corners: list[np.ndarray]) -> list[np.ndarray]:
    """Unit sums of the face normals around each vertex, weighted by area."""
    a, b, c = ([axis[k] for axis in p] for k in corners)
    u, v = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)]
    face = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    weight = 0.5 * np.sqrt(face[0] ** 2 + face[1] ** 2 + face[2] ** 2)
    at = np.concatenate(corners)
    sums = [np.bincount(at, np.tile(weight * f, 3), len(p[0])) for f in face]
    size = np.sqrt(sums[0] ** 2 + sums[1] ** 2 + sums[2] ** 2)
    return [np.where(size > 1e-8, s / np.where(size > 1e-8, size, 1.0), s) for s in sums]


def _averaged(key: np.ndarray, others: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Means of own and others' values with the same key; summed by size, so that all tiles get the same number."""
    keys, values = np.concatenate([key, others]), np.concatenate([own, theirs])
    order = np.lexsort((values, keys))
    first = np.flatnonzero(np.r_[True, np.diff(keys[order]) > 0]) if len(keys) else np.zeros(0, np.int64)
    means = np.add.reduceat(values[order], first) / np.diff(np.r_[first, len(keys)]) if len(first) else values
    return means[np.searchsorted(keys[order][first], key)]


def worked(tiles: DataFrame, *, size: int, average: Sequence[str] = (), places: bool = False, normals: bool = False) -> DataFrame:
    """One step on the tiles' vertices: means of columns with ``around``, then lon, lat and positions, then normals from the tile's own faces.

    What a step adds stands in ``v`` behind what was there; ``around`` goes.
    """
    fields = {f.name: f.dataType for f in tiles.schema["v"].dataType.elementType}
    fields |= dict.fromkeys([*(PLACES if places else ()), *(NORMALS if normals else ())], DoubleType())
    kind = StructType([*(StructField(c, LongType()) for c in KEY), StructField("v", ArrayType(StructType([StructField(c, t) for c, t in fields.items()]))), tiles.schema["t"]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, own, items = lists(b.column("v"))
            z, x, y = (b.column(c).to_numpy().astype(np.int64) for c in KEY)
            vx, vy = numbers(items, "vx"), numbers(items, "vy")
            made = {f.name: items.field(f.name) for f in items.type}
            edge = np.flatnonzero((vx == 0) | (vx == size) | (vy == 0) | (vy == size))
            if average:
                _, other, near = lists(b.column("around"))
                code = lambda tile, i, j: (tile * (size + 1) + i) * (size + 1) + j
                mine, theirs = code(own[edge], vx[edge], vy[edge]), code(other, numbers(near, "vx"), numbers(near, "vy"))
                for c in average:
                    values = numbers(items, c).copy()
                    values[edge] = _averaged(mine, theirs, values[edge], numbers(near, c))
                    made[c] = pa.array(values)
            if places or normals:
                w = 180.0 / np.exp2(z)
                left, top = -180.0 + x * w, 90.0 - y * w
                bottom, right = top - w, left + w
                lon = left[own] + vx / size * (right - left)[own]
                lat = bottom[own] + vy / size * (top - bottom)[own]
                p = _ecef(lon, lat, made["h"].to_numpy(zero_copy_only=False))
                if places:
                    made |= dict(zip(PLACES, map(pa.array, [lon, lat, *p]), strict=True))
            if normals:
                _, tile, faces = lists(b.column("t"))
                start = np.r_[0, np.cumsum(n)][tile]
                made |= dict(zip(NORMALS, map(pa.array, _face_normals(p, [start + numbers(faces, k) for k in "abc"])), strict=True))
            out = pa.StructArray.from_arrays([made[c] for c in fields], list(fields))
            v = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), out)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), v, b.column("t")], [*KEY, "v", "t"])

    wanted = [*KEY, "v", "t", *(["around"] if average else [])]
    return tiles.select(*(F.col(c).cast("long").alias(c) if c in KEY else F.col(c) for c in wanted)).mapInArrow(run, kind)


def stitched_grids(tiles: DataFrame, *, size: int) -> DataFrame:
    """Normals come from each tile's own faces, weighted by area; then normals and heights are averaged over shared edges."""
    own = worked(tiles, size=size, normals=True)
    return worked(gathered(own, ["h", *NORMALS], size=size), size=size, average=["h", *NORMALS], places=True)


def stitched_adaptive(tiles: DataFrame, *, size: int) -> DataFrame:
    """Heights are averaged over shared edges, then normals are taken from the faces and averaged too."""
    level = worked(gathered(tiles, ["h"], size=size), size=size, average=["h"], places=True, normals=True)
    return worked(gathered(level, NORMALS, size=size), size=size, average=NORMALS)
