"""Grid meshes as rows: vertices, triangles, heights, positions and normals.

A tile's mesh is made from its row alone, so building it shuffles nothing; what
belongs to one tile stays in that tile's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.functions import geometry, tiling

TILE = ("z", "x", "y")
#: Most cells on a side: 256 x 256 vertices are what 16-bit indices reach.
MOST_CELLS = 255
GRID, MARTINI, EMPTY = 255, 256, 256


def cells(n: int | str) -> Column:
    """Cells on a side, from a number or from the column that holds each tile's; MOST_CELLS at most."""
    return F.least(F.col(n) if isinstance(n, str) else F.lit(n), F.lit(MOST_CELLS)).cast("long")


def step(i: Column, n: Column, size: int) -> Column:
    """The place of lattice line i: evenly spaced, cut to a whole number, the last one exactly at the edge."""
    return F.when(i == n, F.lit(size)).otherwise((i * (F.lit(float(size)) / n)).cast("long")).cast("long")


def _lattice(tiles: DataFrame, last: Column) -> DataFrame:
    line = F.sequence(F.lit(0).cast("long"), last)
    return tiles.withColumn("j", F.explode(line)).withColumn("i", F.explode(line))


def grid_vertices(tiles: DataFrame, n: int | str, *, size: int = GRID) -> DataFrame:
    """i, j, vid, vx, vy for each of the (n + 1)² vertices, row by row; ``n`` may be a column of the tiles."""
    k = cells(n)
    return _lattice(tiles, k).withColumns({"vid": F.col("j") * (k + 1) + F.col("i"), "vx": step(F.col("i"), k, size), "vy": step(F.col("j"), k, size)})


def grid_triangles(tiles: DataFrame, n: int | str) -> DataFrame:
    """tid, a, b, c: two triangles for each cell, split from top right to bottom left."""
    k = cells(n)
    corner = lambda dj, di: (F.col("j") + dj) * (k + 1) + F.col("i") + di
    tl, tr, bl, br = corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)
    two = F.array(F.struct(tl.alias("a"), tr.alias("b"), bl.alias("c")), F.struct(bl.alias("a"), tr.alias("b"), br.alias("c")))
    rows = _lattice(tiles, k - 1).select(*tiles.columns, (2 * (F.col("j") * k + F.col("i"))).alias("_first"), F.posexplode(two).alias("_k", "_t"))
    return rows.select(*tiles.columns, (F.col("_first") + F.col("_k")).alias("tid"), "_t.a", "_t.b", "_t.c")


def sample(vertices: DataFrame, pixels: DataFrame, *, size: int = GRID) -> DataFrame:
    """Heights at the vertices from pixels (z, x, y, row, col, h); the vertex's y counts from the south.

    Rows and columns on which no vertex of any tile lies (at most (size + 1)² are told) are left out before pixels
    are exchanged, and neither side is sent whole.
    """
    at = vertices.withColumns({"row": size - F.floor("vy"), "col": F.floor("vx")})
    needed = pixels.join(F.broadcast(at.select("row", "col").distinct()), ["row", "col"], "left_semi")
    return at.join(needed.hint("merge"), [*TILE, "row", "col"]).drop("row", "col")


def rescale(vertices: DataFrame, *, size: int = GRID) -> DataFrame:
    """lon, lat: vertex places, 0 to ``size``, stretched to the tile's box."""
    b = tiling.bounds(*(F.col(c) for c in TILE))
    return vertices.withColumns({"lon": b["left"] + F.col("vx") / size * (b["right"] - b["left"]), "lat": b["bottom"] + F.col("vy") / size * (b["top"] - b["bottom"])})


def to_ecef(vertices: DataFrame) -> DataFrame:
    px, py, pz = geometry.ecef(F.col("lon"), F.col("lat"), F.col("h"))
    return vertices.withColumns({"px": px, "py": py, "pz": pz})


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """z, x, y, vid, nx, ny, nz: unit sums of the face normals around each vertex, weighted by area.

    ``vertices`` has vid (0-based, gapless) and px, py, pz. A tile's vertices
    and triangles are gathered side by side once; faces look their corners up
    by place, and their sums stay in the tile's partition. A vertex without a
    face gives no row.
    """
    points = vertices.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("vid", "px", "py", "pz"))).alias("v"))
    faces = triangles.groupBy(*TILE).agg(F.collect_list(F.struct("a", "b", "c")).alias("t"))

    def face(t: Column) -> Column:
        p, q, r = (tuple(F.element_at(F.col("v"), (t[c] + 1).cast("int"))[k] for k in ("px", "py", "pz")) for c in ("a", "b", "c"))
        normal = geometry.cross(geometry.minus(q, p), geometry.minus(r, p))
        return F.struct(F.array(t["a"], t["b"], t["c"]).alias("at"), *(c.alias(k) for c, k in zip(normal, ("fx", "fy", "fz"), strict=True)))

    made = points.join(faces, list(TILE)).select(*TILE, F.explode(F.transform("t", face)).alias("f")).select(*TILE, "f.*")
    corners = made.withColumn("_w", geometry.norm((F.col("fx"), F.col("fy"), F.col("fz"))) * 0.5).withColumn("vid", F.explode("at"))
    sums = corners.groupBy(*TILE, "vid").agg(*(F.sum(F.col("_w") * F.col(f)).alias(n) for f, n in (("fx", "nx"), ("fy", "ny"), ("fz", "nz"))))
    unit = geometry.unit((F.col("nx"), F.col("ny"), F.col("nz")))
    return sums.select(*TILE, "vid", *(c.alias(k) for c, k in zip(unit, ("nx", "ny", "nz"), strict=True)))


def geocentric_normals(vertices: DataFrame) -> DataFrame:
    """nx, ny, nz: each vertex's ECEF position at length 1."""
    p = (F.col("px"), F.col("py"), F.col("pz"))
    return vertices.withColumns({k: c / geometry.norm(p) for k, c in zip(("nx", "ny", "nz"), p, strict=True)})


def empty_tiles(tiles: DataFrame, no_data: float, *, n: int = 20) -> DataFrame:
    """A flat mesh for each tile, with positions and geocentric normals."""
    flat = grid_vertices(tiles, n, size=EMPTY).withColumn("h", F.lit(float(no_data)))
    return geocentric_normals(to_ecef(rescale(flat, size=EMPTY)))


def is_empty(z: Column, min_zoom: Column) -> Column:
    return (z == 0) | (z < min_zoom)


def quantized(vertices: DataFrame) -> DataFrame:
    """u, v, q in 0..32767: places in the tile's box and heights in the tile's range."""
    w = Window.partitionBy(*TILE)
    b = tiling.bounds(*(F.col(c) for c in TILE))
    low, high = F.min("h").over(w), F.max("h").over(w)
    rows = vertices.withColumns({"_low": low, "_high": high})
    return rows.withColumns(
        {
            "u": geometry.quantize(F.col("lon"), b["left"], b["right"]),
            "v": geometry.quantize(F.col("lat"), b["bottom"], b["top"]),
            "q": geometry.quantize(F.col("h"), F.col("_low"), F.col("_high")),
        }
    ).drop("_low", "_high")


def occlusion_points(vertices: DataFrame) -> DataFrame:
    """z, x, y, ox, oy, oz: the horizon occlusion point of each tile in ellipsoid-scaled space."""
    middle = vertices.groupBy(*TILE).agg(*(((F.min(c) + F.max(c)) / 2).alias(f"_{c}") for c in ("px", "py", "pz")))
    scaled_centre = geometry.scaled((F.col("_px"), F.col("_py"), F.col("_pz")))
    size = geometry.norm(scaled_centre)
    middle = middle.select(*TILE, *((c / size).alias(k) for c, k in zip(scaled_centre, ("_dx", "_dy", "_dz"), strict=True)))
    direction = (F.col("_dx"), F.col("_dy"), F.col("_dz"))
    point = geometry.scaled((F.col("px"), F.col("py"), F.col("pz")))
    far = vertices.join(middle, list(TILE)).groupBy(*TILE, "_dx", "_dy", "_dz").agg(F.max(geometry.occlusion_magnitude(point, direction)).alias("_m"))
    return far.select(*TILE, *((F.col(d) * F.col("_m")).alias(k) for d, k in (("_dx", "ox"), ("_dy", "oy"), ("_dz", "oz"))))
