"""Raster files of several kinds, broken files, and the stream of expired tiles against a plain version."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from orograph import plans
from orograph.plans import inputs
from orograph.sources import files, geotiff


def striped(grid, predictor, big_endian):
    """A striped file of whole numbers, or of floats under predictor 3, in either byte order."""
    e = ">" if big_endian else "<"
    kind = "f" if predictor == 3 else "i"
    if predictor == 3:
        planes = np.ascontiguousarray(grid.astype(">f4")).view(np.uint8).reshape(*grid.shape, 4).transpose(0, 2, 1).reshape(len(grid), -1)
        data = np.diff(planes, axis=1, prepend=np.zeros((len(grid), 1), np.uint8)).astype(np.uint8)
    else:
        data = grid.astype(np.int16)
        data = (np.diff(data, axis=1, prepend=np.zeros((len(grid), 1), np.int16)) if predictor == 2 else data).astype(f"{e}i2")
    parts = [zlib.compress(data[:3].tobytes()), zlib.compress(data[3:].tobytes())]
    tags = [(256, "H", [grid.shape[1]]), (257, "H", [len(grid)]), (258, "H", [32 if kind == "f" else 16]), (259, "H", [8]), (278, "H", [3])]
    tags += [(317, "H", [predictor]), (339, "H", [3 if kind == "f" else 2])]
    offsets = [8, 8 + len(parts[0])]
    at = 8 + sum(map(len, parts))
    after = at + 2 + 12 * (len(tags) + 2) + 4
    entries = [struct.pack(f"{e}HHI{c}", t, {"H": 3}[c], 1, *v).ljust(12, b"\0") for t, c, v in tags]
    entries += [struct.pack(f"{e}HHII", 273, 4, 2, after), struct.pack(f"{e}HHII", 279, 4, 2, after + 8)]
    tail = struct.pack(f"{e}4I", *offsets, *map(len, parts))
    return (b"MM\0*" if big_endian else b"II*\0") + struct.pack(f"{e}I", at) + b"".join(parts) + struct.pack(f"{e}H", len(entries)) + b"".join(entries) + bytes(4) + tail


@pytest.mark.parametrize("big_endian", [False, True])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_striped_files(spark, tmp_path, predictor, big_endian):
    grid = np.arange(5 * 7).reshape(5, 7) ** 2 % 101 - 50
    (tmp_path / "a b.TIF").write_bytes(striped(grid, predictor, big_endian))
    got = {(r.row, r.col): r.h for r in geotiff.pixels(geotiff.headers(spark, str(tmp_path))).collect()}
    assert got == {(r, c): float(grid[r, c]) for r in range(5) for c in range(7)}


def test_broken_files_say_why(spark, tmp_path):
    (tmp_path / "cut.tif").write_bytes(b"II*\0\x08")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "text.tiff").write_bytes(b"no raster at all")
    (tmp_path / "other.txt").write_bytes(b"II")
    (tmp_path / "good.tif").write_bytes(geotiff.encode(np.ones((3, 3)), 0, 0, 1.0, block=2))
    found = geotiff.headers(spark, str(tmp_path))
    rows = {r.path.rpartition("/")[2]: r.error for r in found.collect()}
    assert set(rows) == {"cut.tif", "text.tiff", "good.tif"} and rows["good.tif"] is None and rows["cut.tif"] and rows["text.tiff"]
    assert geotiff.pixels(found).count() == 9


def test_a_file_is_replaced_whole(spark, tmp_path):
    for data in (b"old", b"new"):
        files.write_tiles(spark.createDataFrame([(1, 2, 0, data), (1, 3, 0, None)], "z long, x long, y long, data binary"), str(tmp_path))
    assert (tmp_path / "1" / "2" / "1.terrain").read_bytes() == b"new"
    assert [p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")] == ["1.terrain"]
    assert [(r.z, r.x, r.y, bytes(r.data)) for r in files.read_tiles(spark, str(tmp_path)).collect()] == [(1, 2, 0, b"new")]


def test_expired_tiles(spark, sf_dir):
    rows = inputs.requests(spark, sf_dir).selectExpr("z", "x", "y", "cast(ts as double) as ts").collect()
    last = defaultdict(float)
    for r in rows:
        last[r.z, r.x, r.y] = max(last[r.z, r.x, r.y], r.ts)
    end = max(last.values())
    wanted = {k: t for k, t in last.items() if int((t + 86_400) * 1000) < int(end * 1000)}
    got = plans.QUERIES["stream_expiry"](spark, sf_dir).selectExpr("z", "x", "y", "cast(ts as double) as ts").collect()
    assert len(got) == len(wanted) > 0
    assert all(abs(wanted[r.z, r.x, r.y] - r.ts) < 1e-3 for r in got)


def test_tile_files_beyond_the_pyramid_are_read_back(spark, tmp_path):
    keys = [(1, 0, 0), (1, 1, 2), (7, 9, 599), (3, -1, -2)]
    tiles = spark.createDataFrame([(*k, bytearray(repr(k).encode())) for k in keys], "z long, x long, y long, data binary")
    files.write_tiles(tiles, str(tmp_path))
    assert {(r.z, r.x, r.y): bytes(r.data).decode() for r in files.read_tiles(spark, str(tmp_path)).collect()} == {k: repr(k) for k in keys}
