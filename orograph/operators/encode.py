"""Quantized-mesh tiles as bytes (quantized-mesh 1.0, little-endian), one row for each tile."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions import geometry, tiling

TILE = ["z", "x", "y"]
_NUMBERS = ["lon", "lat", "h", "px", "py", "pz", "nx", "ny", "nz"]
OCT_NORMALS = 1


@dataclass
class Mesh:
    """Vertices (lon, lat, h), their ECEF positions, optional normals, and triangles as rows of vertex numbers."""

    places: np.ndarray
    ecef: np.ndarray
    triangles: np.ndarray
    normals: np.ndarray | None = None


def _zigzag(values: np.ndarray) -> bytes:
    d = np.diff(values.astype(np.int32), prepend=0)
    return ((d << 1) ^ (d >> 31)).astype("<u2").tobytes()


def _scale(v: np.ndarray, low: float, high: float) -> np.ndarray:
    if high <= low:
        return np.zeros(len(v), np.int64)
    return np.clip(np.floor((v - low) / (high - low) * 32767 + 0.5), 0, 32767).astype(np.int64)


def _oct(n: np.ndarray) -> bytes:
    p = n / np.abs(n).sum(axis=1, keepdims=True)
    sign = np.where(p[:, :2] < 0, -1.0, 1.0)
    xy = np.where(p[:, 2:] < 0, (1 - np.abs(p[:, 1::-1])) * sign, p[:, :2])
    return np.floor((np.clip(xy, -1, 1) * 0.5 + 0.5) * 255 + 0.5).astype(np.uint8).tobytes()


def _occlusion(ecef: np.ndarray, centre: np.ndarray) -> np.ndarray:
    radii = np.array([geometry.A, geometry.A, geometry.B])
    p, c = ecef / radii, centre / radii
    c = c / np.linalg.norm(c)
    size = np.linalg.norm(p, axis=1)
    direction, size = p / size[:, None], np.maximum(1.0, size)
    den = direction @ c / size - np.linalg.norm(np.cross(direction, c), axis=1) * np.sqrt(size**2 - 1) / size
    return c * (1 / np.where(den == 0, np.finfo(float).eps, den)).max()


def encode(mesh: Mesh, bounds: tuple[float, float, float, float]) -> bytes:
    """The tile's bytes. Vertices are numbered by their first use, which the index coding needs."""
    _, first = np.unique(mesh.triangles.ravel(), return_index=True)
    order = mesh.triangles.ravel()[np.sort(first)]
    number = np.zeros(len(mesh.places), np.int64)
    number[order] = np.arange(len(order))
    places, ecef, indices = mesh.places[order], mesh.ecef[order], number[mesh.triangles.ravel()]
    left, bottom, right, top = bounds
    u, v = _scale(places[:, 0], left, right), _scale(places[:, 1], bottom, top)
    low, high = np.float32(places[:, 2].min()), np.float32(places[:, 2].max())
    centre = (ecef.min(axis=0) + ecef.max(axis=0)) / 2
    radius = np.linalg.norm(ecef - centre, axis=1).max()
    doubles = lambda *x: np.array(x, "<f8").tobytes()
    out = [doubles(*centre), np.array([low, high], "<f4").tobytes(), doubles(*centre, radius), doubles(*_occlusion(ecef, centre))]
    out += [np.uint32(len(u)).astype("<u4").tobytes(), _zigzag(u), _zigzag(v), _zigzag(_scale(places[:, 2], float(low), float(high)))]
    kind = "<u2" if len(u) <= 65536 else "<u4"
    if kind == "<u4" and (size := sum(map(len, out))) % 4:
        out.append(bytes(4 - size % 4))
    highest = np.maximum.accumulate(np.concatenate([[-1], indices]))[:-1] + 1  # the next new number before each index
    out += [np.uint32(len(indices) // 3).astype("<u4").tobytes(), (highest - indices).astype(kind).tobytes()]
    for edge in (np.flatnonzero(u == 0), np.flatnonzero(v == 0), np.flatnonzero(u == 32767), np.flatnonzero(v == 32767)):
        out += [np.uint32(len(edge)).astype("<u4").tobytes(), edge.astype(kind).tobytes()]
    if mesh.normals is not None:
        payload = _oct(mesh.normals[order])
        out += [bytes([OCT_NORMALS]), np.uint32(len(payload)).astype("<u4").tobytes(), payload]
    return b"".join(out)


def _encoder(compress: bool):
    schema = pa.schema([*((c, pa.int64()) for c in TILE), ("encoding", pa.string()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for v, t, bounds in zip(b.column("v"), b.column("t"), b.column("bounds").to_pylist(), strict=True):
                col = lambda rows, k: rows.values.field(k).to_numpy()
                n = np.column_stack([col(v, k) for k in _NUMBERS])
                mesh = Mesh(n[:, :3], n[:, 3:6], np.column_stack([col(t, k) for k in "abc"]).astype(np.int64), n[:, 6:])
                raw = encode(mesh, bounds)
                data.append(gzip.compress(raw, mtime=0) if compress else raw)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in TILE), pa.array(["gzip" if compress else "identity"] * len(data), pa.string()), pa.array(data, pa.binary())], schema=schema)

    return run


def encode_tiles(vertices: DataFrame, triangles: DataFrame, *, compress: bool = True) -> DataFrame:
    """z, x, y, encoding, data. Vertices have vid (0-based, gapless), lon, lat, h, ECEF and normals.

    A tile has at most 65,536 grid vertices, which bounds the gathered lists.
    """
    v = vertices.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("vid", *_NUMBERS))).alias("v"))
    t = triangles.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("tid", "a", "b", "c"))).alias("t"))
    # both sides are far larger than Spark takes them for, so neither may be sent whole
    return encode_meshes(v.join(t.hint("merge"), TILE), compress=compress)


def encode_meshes(tiles: DataFrame, *, compress: bool = True) -> DataFrame:
    """The same from a row for each tile, with its vertices ``v`` and triangles ``t`` as lists in their order."""
    b = tiling.bounds(*(F.col(c) for c in TILE))
    rows = tiles.select(*TILE, "v", "t", F.array(*b.values()).alias("bounds"))
    return rows.mapInArrow(_encoder(compress), "z long, x long, y long, encoding string, data binary")


def decompress(tiles: DataFrame) -> DataFrame:
    """The tiles with plain bytes; those that aren't compressed stay."""
    schema = pa.schema([*((c, pa.int64()) for c in TILE), ("encoding", pa.string()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [gzip.decompress(d) if e == "gzip" and d is not None else d for e, d in zip(b.column("encoding").to_pylist(), b.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in TILE), pa.array(["identity"] * len(data), pa.string()), pa.array(data, pa.binary())], schema=schema)

    return tiles.select(*TILE, "encoding", "data").mapInArrow(run, "z long, x long, y long, encoding string, data binary")
