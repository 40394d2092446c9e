"""Raster files (tiled or striped TIFF): a row for each level's header and one for each block of pixels.

Listing and headers cost a few small reads a file. Blocks are dealt over tasks
by file and number, so that one large file is read by many, and each task reads
only its blocks' bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import projections
from orograph.sources import files

# Fixed values of the format: numbers of tags, field types as struct codes, kinds of samples, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, KIND, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
GEO_KEYS, PROJECTED = 34735, 3072
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
KINDS = {1: "u", 2: "i", 3: "f"}
RAW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 8, 32946, 50000

_HEADER = [
    *((c, pa.int64()) for c in ("level", "width", "height", "block_width", "block_height")),
    *((c, pa.float64()) for c in ("left", "top", "pixel_x", "pixel_y", "nodata")),
    ("sample", pa.string()),
    *((c, pa.int64()) for c in ("samples", "compression", "predictor")),
    ("offsets", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())),
    ("crs", pa.int64()),
    *((c, pa.float64()) for c in ("west", "south", "east", "north")),
    ("error", pa.string()),
]
HEADER = pa.schema([("path", pa.string()), *_HEADER])
_HEADER_DDL = (
    "path string, level long, width long, height long, block_width long, block_height long, left double, top double, pixel_x double, pixel_y double, nodata double, "
    "sample string, samples long, compression long, predictor long, offsets array<long>, sizes array<long>, crs long, west double, south double, east double, north double, error string"
)


def directories(source: pa.NativeFile) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, values by tag) of each image in a file."""
    source.seek(0)
    order = {b"II": "<", b"MM": ">"}[source.read(2)]

    def take(code: str, at: int) -> tuple:
        source.seek(at)
        return struct.unpack(order + code, source.read(struct.calcsize(order + code)))

    big = take("H", 2)[0] == 43
    count, word, inline = ("Q", "Q", 8) if big else ("H", "I", 4)
    (at,) = take(word, 8 if big else 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = take(count, at)
        at += struct.calcsize("<" + count)
        tags = {}
        for _ in range(n):
            tag, kind, values = take("HH" + word, at)
            place = at + 4 + inline
            at = place + inline
            if kind in FIELDS:
                code = f"{values}{FIELDS[kind]}"
                tags[tag] = take(code, place if struct.calcsize("<" + code) <= inline else take(word, place)[0])
        yield order, tags
        (at,) = take(word, at)


def _degrees(row: dict) -> dict[str, float]:
    """west, south, east, north of a level in a projected system: the box around its outline, and a little more."""
    along = np.linspace(0.0, 1.0, 65)
    x, y = row["left"] + along * row["width"] * row["pixel_x"], row["top"] - along * row["height"] * row["pixel_y"]
    outline = np.concatenate([x, x, np.full(65, x[0]), np.full(65, x[-1])]), np.concatenate([np.full(65, y[0]), np.full(65, y[-1]), y, y])
    lon, lat = projections.unproject(row["crs"], *outline)
    more = (lon.max() - lon.min()) / 1000, (lat.max() - lat.min()) / 1000
    return {"west": float(lon.min() - more[0]), "south": float(lat.min() - more[1]), "east": float(lon.max() + more[0]), "north": float(lat.max() + more[1])}


def header(path: str) -> list[dict]:
    """A row for each level of a file, the finest first; ``error`` tells why a level can't be read."""
    system, at = files.locate(path)
    rows = []
    with system.open_input_file(at) as source:
        for level, (order, t) in enumerate(directories(source)):
            one = lambda tag, default=None, t=t: t.get(tag, (default,))[0]
            tiled = TILES in t
            width, height = one(WIDTH), one(HEIGHT)
            bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
            n = -(-width // bw) * -(-height // bh)  # planes of further bands follow
            row = {"path": path, "level": level, "width": width, "height": height, "block_width": bw, "block_height": bh}
            row |= {"sample": f"{order}{KINDS.get(one(KIND, 1), 'u')}{one(BITS, 8) // 8}", "samples": one(SAMPLES, 1) if one(284, 1) == 1 else 1}
            row |= {"compression": one(COMPRESSION, RAW), "predictor": one(PREDICTOR, 1)}
            row |= {"offsets": list(t[TILES if tiled else STRIPS][:n]), "sizes": list(t[TILE_BYTES if tiled else STRIP_BYTES][:n])}
            if PIXEL_SCALE in t and TIE_POINT in t:
                (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINT]
                row |= {"pixel_x": sx, "pixel_y": sy, "left": x - i * sx, "top": y + j * sy}
            elif rows:  # overviews cover what the first level covers
                first = rows[0]
                row |= {"left": first.get("left"), "top": first.get("top")}
                row |= {p: first[p] * first[s] / row[s] for p, s in (("pixel_x", "width"), ("pixel_y", "height")) if p in first}
            keys = t.get(GEO_KEYS, ())
            code = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] == PROJECTED and keys[i + 1] == 0), None)
            row["crs"] = code if code is not None or not rows else rows[0].get("crs")
            if row["crs"] is not None and "left" in row and "pixel_x" in row and projections.known(row["crs"]):
                row |= _degrees(row)
            if NODATA in t:
                row["nodata"] = float(t[NODATA][0].rstrip(b"\0 ") or b"nan")
            elif rows:
                row["nodata"] = rows[0].get("nodata")
            if row["compression"] not in (RAW, DEFLATE, OLD_DEFLATE, ZSTD):
                row["error"] = f"compression {row['compression']} is not known"
            elif row["crs"] is not None and not projections.known(row["crs"]):
                row["error"] = f"coordinate system {row['crs']} is not known"
            elif row["predictor"] == 3 and row["samples"] > 1:
                row["error"] = "predictor 3 with several bands is not known"
            rows.append(row)
    return rows


def _headers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path in b.column("path").to_pylist():
            try:
                rows += header(path)
            except (OSError, KeyError, ValueError, struct.error) as e:
                rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(rows, schema=HEADER)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each level of each .tif or .tiff file (either case) under a path; ``error`` is set where one can't be read.

    Files of no bytes are not listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"(?i)\.tiff?$"))
    return headers_of(files.few_tasks(found))


def headers_of(paths: DataFrame) -> DataFrame:
    """The same for the files of the column ``path``."""
    return paths.select("path").mapInArrow(_headers, _HEADER_DDL)


def decode(data: bytes, h: dict) -> np.ndarray:
    """A block's first band as rows of heights."""
    if h["compression"] in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif h["compression"] == ZSTD:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    kind = np.dtype(h["sample"])
    if h["predictor"] == 3:
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(-1, h["block_width"] * kind.itemsize), axis=1, dtype=np.uint8)
        shuffled = planes.reshape(len(planes), kind.itemsize, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(shuffled).view(f">{kind.kind}{kind.itemsize}")[..., 0].astype(np.float64)
    grid = np.frombuffer(data, kind).reshape(-1, h["block_width"], h["samples"])
    if h["predictor"] == 2:
        grid = np.cumsum(grid, axis=1, dtype=kind.newbyteorder("="))
    return grid[..., 0].astype(np.float64)


_BLOCK = ["width", "height", "block_width", "block_height", "sample", "samples", "compression", "predictor", "nodata"]


_BLOCKS = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("level", "block", "row", "col", "columns")), ("heights", pa.list_(pa.float64())), ("error", pa.string())])
_BLOCKS_DDL = "path string, level long, block long, row long, col long, columns long, heights array<double>, error string"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            across = -(-r["width"] // r["block_width"])
            row, col = r["block"] // across * r["block_height"], r["block"] % across * r["block_width"]
            system, at = files.locate(r["path"])
            try:
                with system.open_input_file(at) as source:
                    source.seek(r["offset"])
                    grid = decode(source.read(r["size"]), r)[: r["height"] - row, : r["width"] - col]
            except (OSError, ValueError, zlib.error, zstandard.ZstdError) as e:
                made = [pa.array([0], pa.int64()), pa.array([None], _BLOCKS.field("heights").type), pa.array([f"{type(e).__name__}: {e}"])]
            else:
                empty = np.isnan(grid) if r["nodata"] is None else np.isnan(grid) | (grid == r["nodata"])
                flat = pa.array(grid.ravel(), pa.float64(), mask=empty.ravel())
                made = [pa.array([grid.shape[1]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([None], pa.string())]
            keys = [pa.array([r["path"]]), *(pa.array([v], pa.int64()) for v in (r["level"], r["block"], row, col))]
            yield pa.RecordBatch.from_arrays([*keys, made[0], made[1].cast(_BLOCKS.field("heights").type), made[2]], schema=_BLOCKS)


def places(found: DataFrame) -> DataFrame:
    """path, level, block, offset and size of the blocks of headers, with what decoding them takes; blocks that a file leaves out give no row."""
    part = F.posexplode(F.arrays_zip("offsets", "sizes")).alias("block", "at")
    keys = [c for c in ("ordinal", "path", "level") if c in found.columns]
    rows = found.where("error is null").select(*keys, *_BLOCK, part).where("at.sizes > 0")
    return rows.select(*keys, *_BLOCK, F.col("block").cast("long").alias("block"), F.col("at.offsets").alias("offset"), F.col("at.sizes").alias("size"))


def blocks(found: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """path, level, block, row, col (of the first pixel), columns, heights (by rows; null without data), error of the blocks of headers.

    ``needed`` names the blocks to read (path, level, block); without it all
    are. Blocks that a file leaves out give no row; one that can't be read has
    no heights and says why.
    """
    rows = places(found.drop("ordinal"))
    if needed is not None:
        rows = rows.join(needed, ["path", "level", "block"], "left_semi")
    return rows.repartition("path", "level", "block").mapInArrow(_blocks, _BLOCKS_DDL)


def pixels(found: DataFrame) -> DataFrame:
    """path, level, row, col, h of every pixel that has data."""
    each = blocks(found).where("heights is not null").select("path", "level", F.col("row").alias("_r"), F.col("col").alias("_c"), "columns", F.posexplode("heights").alias("_i", "h")).where("h is not null")
    return each.select("path", "level", F.expr("_r + _i div columns").alias("row"), F.expr("_c + _i % columns").alias("col"), "h")


def box(found: DataFrame) -> DataFrame:
    """The headers' columns and the box of each in degrees: left, bottom, right, top, and the pixels' size there.

    origin_x and origin_y are where the first pixel begins, unit_x and unit_y
    how large pixels are, in the file's own coordinates; for a file in a
    projected system (``crs``) these are metres, and the box lies around it.
    Headers with clip_left, clip_bottom, clip_right and clip_top end there.
    """
    sides = {"left": F.col("left"), "top": F.col("top"), "right": F.col("left") + F.col("width") * F.col("pixel_x"), "bottom": F.col("top") - F.col("height") * F.col("pixel_y")}
    origin = {"origin_x": F.col("left"), "origin_y": F.col("top"), "unit_x": F.col("pixel_x"), "unit_y": F.col("pixel_y")}
    around = {"left": "west", "bottom": "south", "right": "east", "top": "north"}
    plain = F.col("crs").isNull()
    sides = {c: F.when(plain, v).otherwise(F.col(around[c])) for c, v in sides.items()}
    degrees = {"pixel_x": (F.col("east") - F.col("west")) / F.col("width"), "pixel_y": (F.col("north") - F.col("south")) / F.col("height")}
    origin |= {c: F.when(plain, F.col(c)).otherwise(v) for c, v in degrees.items()}
    if "clip_left" in found.columns:
        inner = {"left": F.greatest, "bottom": F.greatest, "right": F.least, "top": F.least}
        sides = {c: inner[c](v, F.col(f"clip_{c}")) for c, v in sides.items()}
    return found.withColumns(sides | origin)


def encode(grid: np.ndarray, left: float, top: float, pixel: float, *, nodata: float | None = None, block: int = 256, overviews: Sequence[int] = (), crs: int | None = None) -> bytes:
    """A raster of heights as the bytes of a tiled, deflated file; each overview takes the first pixel of so many each way.

    ``crs`` is the code of a projected system that left, top and pixel are in.
    """
    out = b"II*\0" + bytes(4)
    link = 4  # where the place of the next directory is written
    for factor in (1, *overviews):
        parts, directory = _level(np.asarray(grid, "<f4")[::factor, ::factor], left, top, pixel * factor, nodata, block, len(out), crs)
        at = len(out) + len(parts)
        out = out[:link] + struct.pack("<I", at) + out[link + 4 :] + parts
        data, link = directory(at)
        out += data
    return out


def _level(grid: np.ndarray, left: float, top: float, pixel: float, nodata: float | None, block: int, start: int, crs: int | None) -> tuple[bytes, Callable[[int], tuple[bytes, int]]]:
    """The blocks of one level, and its directory (with the place of its link) once its own place is known."""
    rows, cols = (-(-n // block) * block for n in grid.shape)
    whole = np.full((rows, cols), 0 if nodata is None else nodata, "<f4")
    whole[: grid.shape[0], : grid.shape[1]] = grid
    parts = [zlib.compress(whole[r : r + block, c : c + block].tobytes()) for r in range(0, rows, block) for c in range(0, cols, block)]
    offsets = (start + np.cumsum([0, *map(len, parts)])).tolist()
    tags = [(WIDTH, "I", (grid.shape[1],)), (HEIGHT, "I", (grid.shape[0],)), (BITS, "H", (32,)), (COMPRESSION, "H", (DEFLATE,)), (SAMPLES, "H", (1,))]
    tags += [(TILE_WIDTH, "I", (block,)), (TILE_HEIGHT, "I", (block,)), (TILES, "I", tuple(offsets[:-1])), (TILE_BYTES, "I", tuple(map(len, parts))), (KIND, "H", (3,))]
    tags += [(PIXEL_SCALE, "d", (pixel, pixel, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, left, top, 0.0))]
    if crs is not None:
        tags.append((GEO_KEYS, "H", (1, 1, 0, 1, PROJECTED, 0, 1, crs)))
    if nodata is not None:
        text = f"{nodata}\0".encode()
        tags.append((NODATA, "s", (text,)))

    def directory(at: int) -> tuple[bytes, int]:
        entries, tail = [], b""
        after = at + 2 + 12 * len(tags) + 4
        for tag, code, values in tags:
            n = len(values[0]) if code == "s" else len(values)
            packed = struct.pack(f"<{n}{code}", *values)
            field = next(k for k, v in FIELDS.items() if v == code)
            if len(packed) > 4:
                packed, tail = struct.pack("<I", after + len(tail)), tail + packed
            entries.append(struct.pack("<HHI", tag, field, n) + packed.ljust(4, b"\0"))
        return b"".join([struct.pack("<H", len(tags)), *entries, bytes(4), tail]), after - 4

    return b"".join(parts), directory
