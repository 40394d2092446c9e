"""Queries on rasters and meshes: pixels, vertices, triangles, positions, normals, stitching, encoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import geometry
from orograph.operators import adaptive, encode, mesh, raster, serve, stitch, tile_meshes
from orograph.plans import inputs
from orograph.plans.inputs import SQL_BOUNDS, SQL_MESH_TILES, SQL_TILES, sql_vertices
from orograph.plans.registry import query

#: Cells on a side of the meshes that are compared with SQL.
N = 5
_KEY = "tile, z, x, y"


def vertices(spark: SparkSession, sf_dir: str, n: int = N, size: int = mesh.GRID) -> DataFrame:
    return mesh.grid_vertices(inputs.mesh_tiles(spark, sf_dir), n, size=size).withColumn("h", F.expr(inputs.HEIGHT))


def positions(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return mesh.to_ecef(mesh.rescale(vertices(spark, sf_dir, n)))


def sql_placed(source: str, size: int) -> str:
    return f"""(SELECT *, "left" + vx / {size}e0 * ("right" - "left") AS lon, bottom + vy / {size}e0 * (top - bottom) AS lat FROM (SELECT *, {SQL_BOUNDS} FROM {source}))"""


def sql_ecef(source: str) -> str:
    e2 = geometry.E2
    return f"""(SELECT *, (nn + h) * cos(phi) * cos(lam) AS px, (nn + h) * cos(phi) * sin(lam) AS py, (nn * {1 - e2!r} + h) * sin(phi) AS pz FROM (
        SELECT *, {geometry.A!r}::DOUBLE / sqrt(1e0 - {e2!r} * sin(phi) * sin(phi)) AS nn FROM (SELECT *, radians(lon) AS lam, radians(lat) AS phi FROM {source})))"""


def _rounded(columns: str, places: int) -> str:
    return ", ".join(f"round({c}, {places}) + 0e0 AS {c}" for c in columns.split())


def rounded(df: DataFrame, keys: str, columns: str, places: int) -> DataFrame:
    return df.select(*keys.replace(",", "").split(), *((F.round(c, places) + 0.0).alias(c) for c in columns.split()))


SQL_V = sql_vertices(N, mesh.GRID)
SQL_P = sql_ecef(sql_placed(SQL_V, mesh.GRID))


def sql_triangles(tiles: str, n: int, keys: str) -> str:
    return f"""(SELECT {keys}, 2 * (j * {n} + i) + k AS tid, CASE k WHEN 0 THEN tl ELSE bl END AS a, tl + 1 AS b, CASE k WHEN 0 THEN bl ELSE bl + 1 END AS c FROM (
        SELECT {keys}, i, j, k, j * {n + 1} + i AS tl, (j + 1) * {n + 1} + i AS bl
        FROM {tiles}, (SELECT unnest(range(0, {n})) AS i), (SELECT unnest(range(0, {n})) AS j), (SELECT unnest([0, 1]) AS k)))"""


def sql_normals(triangles: str, pos: str) -> str:
    """Area-weighted normals from triangles and a table of positions."""
    at = lambda t, v: f"JOIN {pos} {t} ON {t}.z = t.z AND {t}.x = t.x AND {t}.y = t.y AND {t}.vid = t.{v}"
    return f"""(SELECT z, x, y, vid, CASE WHEN l > 1e-8 THEN sx / l ELSE sx END AS nx, CASE WHEN l > 1e-8 THEN sy / l ELSE sy END AS ny, CASE WHEN l > 1e-8 THEN sz / l ELSE sz END AS nz FROM (
    SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM (
      SELECT z, x, y, vid, sum(w * fx) AS sx, sum(w * fy) AS sy, sum(w * fz) AS sz FROM (
        SELECT z, x, y, unnest([a, b, c]) AS vid, fx, fy, fz, 0.5e0 * sqrt(fx * fx + fy * fy + fz * fz) AS w FROM (
          SELECT t.z, t.x, t.y, t.a, t.b, t.c, (q.py - p.py) * (r.pz - p.pz) - (q.pz - p.pz) * (r.py - p.py) AS fx,
                 (q.pz - p.pz) * (r.px - p.px) - (q.px - p.px) * (r.pz - p.pz) AS fy, (q.px - p.px) * (r.py - p.py) - (q.py - p.py) * (r.px - p.px) AS fz
          FROM {triangles} t {at("p", "a")} {at("q", "b")} {at("r", "c")})) GROUP BY z, x, y, vid)))"""


SQL_T = sql_triangles(SQL_MESH_TILES, N, "tile, z, x, y")
SQL_NORMALS = sql_normals(SQL_T, "pos")
_WITH_POS = f"WITH pos AS (SELECT * FROM {SQL_P}) "
_EDGE = f"(vx IN (0, {mesh.GRID}) OR vy IN (0, {mesh.GRID}))"


def sql_averaged(columns: str) -> str:
    at = f"PARTITION BY z, x * {mesh.GRID} + vx, y * {mesh.GRID} + {mesh.GRID} - vy"
    return ", ".join(f"CASE WHEN {_EDGE} THEN avg({c}) OVER ({at}) ELSE {c} END AS {c}" for c in columns.split())


@query(f"SELECT {_KEY}, i, j, vid, vx, vy FROM {SQL_V}")
def grid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).drop("h")


@query("SELECT n, i, CASE WHEN i = n THEN 255 ELSE trunc(i * (255 / n))::BIGINT END AS place FROM (SELECT n, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT (2 * p_size + 17)::BIGINT AS n FROM part))")
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice lines of every grid size that is asked for; with some of them whole-number division would be wrong."""
    sizes = inputs.table(spark, sf_dir, "part").select(F.expr("cast(2 * p_size + 17 as bigint)").alias("n")).distinct()
    lines = sizes.withColumn("i", F.explode(F.expr("sequence(0L, n)")))
    return lines.select("n", "i", mesh.step(F.col("i"), F.col("n"), mesh.GRID).alias("place"))


@query(f"SELECT {_KEY}, tid, a, b, c FROM {SQL_T}")
def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.grid_triangles(inputs.mesh_tiles(spark, sf_dir), N)


def _raster(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Long pixels of each mesh tile's raster."""
    line = F.expr(f"sequence(0L, {size}L)")
    rows = inputs.mesh_tiles(spark, sf_dir).withColumn("row", F.explode(line)).withColumn("col", F.explode(line))
    return rows.select("z", "x", "y", "row", "col", F.expr("cast((tile * 31 + col * 7 + row * 13) % 97 as double)").alias("h"))


@query(f"SELECT {_KEY}, vid, vx, vy, ((tile * 31 + vx * 7 + ({mesh.GRID} - vy) * 13) % 97)::DOUBLE AS h FROM {SQL_V}")
def grid_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights at the vertices of all tiles, from their pixels; row 0 lies in the north."""
    v = vertices(spark, sf_dir).drop("h", "i", "j")
    return mesh.sample(v, _raster(spark, sf_dir, mesh.GRID))


@query(f"SELECT {_KEY}, vid, vx, vy, ((tile * 31 + vx * 7 + ({mesh.MARTINI} - vy) * 13) % 97)::DOUBLE AS h FROM {sql_vertices(N, mesh.MARTINI)}")
def martini_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on rasters of 257 x 257."""
    v = vertices(spark, sf_dir, size=mesh.MARTINI).drop("h", "i", "j")
    return mesh.sample(v, _raster(spark, sf_dir, mesh.MARTINI), size=mesh.MARTINI)


@query(f"SELECT {_KEY}, vid, lon, lat FROM {sql_placed(SQL_V, mesh.GRID)}")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.rescale(vertices(spark, sf_dir)).select("tile", "z", "x", "y", "vid", "lon", "lat")


@query(f"SELECT {_KEY}, vid, {_rounded('px py pz', 3)} FROM {SQL_P}")
def ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(positions(spark, sf_dir), f"{_KEY}, vid", "px py pz", 3)


@query(f"{_WITH_POS} SELECT z, x, y, vid, {_rounded('nx ny nz', 6)} FROM {SQL_NORMALS}")
def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangles = mesh.grid_triangles(inputs.mesh_tiles(spark, sf_dir), N).drop("tile")
    return rounded(mesh.vertex_normals(positions(spark, sf_dir), triangles), "z, x, y, vid", "nx ny nz", 6)


@query(f"SELECT {_KEY}, vid, {_rounded('nx ny nz', 6)} FROM (SELECT *, px / l AS nx, py / l AS ny, pz / l AS nz FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS l FROM {SQL_P}))")
def geodetic_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.geocentric_normals(positions(spark, sf_dir)), f"{_KEY}, vid", "nx ny nz", 6)


@query(f"SELECT {_KEY}, vid, vx, vy, {sql_averaged('h')} FROM {SQL_V}")
def stitch_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stitch.average_edges(vertices(spark, sf_dir), ["h"], size=mesh.GRID)
    return rows.select("tile", "z", "x", "y", "vid", "vx", "vy", "h")


@query(f"""{_WITH_POS}, n AS (SELECT v.z, v.x, v.y, v.vid, vx, vy, nx, ny, nz FROM {SQL_V} v JOIN {SQL_NORMALS} s ON s.z = v.z AND s.x = v.x AND s.y = v.y AND s.vid = v.vid)
           SELECT z, x, y, vid, {_rounded('nx ny nz', 6)} FROM (SELECT z, x, y, vid, {sql_averaged('nx ny nz')} FROM n)""")
def stitch_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals averaged over shared edges; not made unit length again."""
    p = positions(spark, sf_dir)
    normals = mesh.vertex_normals(p, mesh.grid_triangles(inputs.mesh_tiles(spark, sf_dir), N).drop("tile"))
    at = p.select("z", "x", "y", "vid", "vx", "vy").join(normals, ["z", "x", "y", "vid"])
    return rounded(stitch.average_edges(at, ["nx", "ny", "nz"], size=mesh.GRID), "z, x, y, vid", "nx ny nz", 6)


_RING = "(VALUES ('N', 0, -1), ('NE', 1, -1), ('E', 1, 0), ('SE', 1, 1), ('S', 0, 1), ('SW', -1, 1), ('W', -1, 0), ('NW', -1, -1)) o(direction, dx, dy)"
SQL_EDGES = f"""(SELECT z, x - dx AS x, y - dy AS y, vid, vx + dx * {mesh.GRID} AS vx, vy - dy * {mesh.GRID} AS vy, h, direction FROM {SQL_V}, {_RING}
    WHERE {_EDGE} AND vx + dx * {mesh.GRID} BETWEEN 0 AND {mesh.GRID} AND vy - dy * {mesh.GRID} BETWEEN 0 AND {mesh.GRID} AND x - dx BETWEEN 0 AND 255 AND y - dy BETWEEN 0 AND 127)"""


@query(f"SELECT z, x, y, vid, vx, vy, h, direction FROM {SQL_EDGES}")
def edge_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each neighbour gives to a tile's edges."""
    return stitch.edge_vertices(vertices(spark, sf_dir), size=mesh.GRID).select("z", "x", "y", "vid", "vx", "vy", "h", "direction")


@query(f"""{_WITH_POS}, n AS (SELECT z, x, y, vid, vx, vy, px / l AS nx, py / l AS ny, pz / l AS nz FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS l FROM pos))
           SELECT z, x - dx AS x, y - dy AS y, vid, direction, {_rounded('nx ny nz', 6)} FROM n, {_RING}
           WHERE {_EDGE} AND vx + dx * {mesh.GRID} BETWEEN 0 AND {mesh.GRID} AND vy - dy * {mesh.GRID} BETWEEN 0 AND {mesh.GRID} AND x - dx BETWEEN 0 AND 255 AND y - dy BETWEEN 0 AND 127""")
def edge_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours' normals, in step with their edge vertices."""
    n = mesh.geocentric_normals(positions(spark, sf_dir))
    return rounded(stitch.edge_vertices(n, size=mesh.GRID), "z, x, y, vid, direction", "nx ny nz", 6)


@query(f"""SELECT z, x, y, vx, vy, min_by(h, f) AS h FROM (SELECT z, x, y, vx, vy, h, 0 AS f FROM {SQL_V} UNION ALL SELECT e.z, e.x, e.y, vx, vy, min(h), 1 FROM {SQL_EDGES} e
           JOIN {SQL_MESH_TILES} m ON m.x = e.x AND m.y = e.y GROUP BY e.z, e.x, e.y, vx, vy) GROUP BY z, x, y, vx, vy""")
def merged_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.merged_vertices(vertices(spark, sf_dir), size=mesh.GRID)


_EMPTY = f"""(SELECT z, x, y, j * 21 + i AS vid, CASE WHEN i = 20 THEN 256 ELSE trunc(i * (256 / 20))::BIGINT END AS vx, CASE WHEN j = 20 THEN 256 ELSE trunc(j * (256 / 20))::BIGINT END AS vy, 7e0 AS h
              FROM {SQL_TILES}, (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(0, 21)) AS j) WHERE z = 0 OR z < 3)"""


@query(f"SELECT z, x, y, vid, h, {_rounded('px py pz', 3)} FROM {sql_ecef(sql_placed(_EMPTY, mesh.EMPTY))}")
def empty_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tiles below the least zoom."""
    tiles = inputs.tiles(spark, sf_dir).select("z", "x", "y").where(mesh.is_empty(F.col("z"), F.lit(3)))
    return rounded(mesh.empty_tiles(tiles, 7.0), "z, x, y, vid, h", "px py pz", 3)


@query(f"""SELECT {_KEY}, vid, {', '.join(f"CASE WHEN {hi} > {lo} THEN least(32767, greatest(0, floor(({v} - {lo}) / ({hi} - {lo}) * 32767e0 + 0.5e0))) ELSE 0 END::BIGINT AS {k}"
           for k, v, lo, hi in (('u', 'lon', '"left"', '"right"'), ('v', 'lat', 'bottom', 'top'), ('q', 'h', 'lo', 'hi')))}
           FROM (SELECT *, min(h) OVER (PARTITION BY z, x, y) AS lo, max(h) OVER (PARTITION BY z, x, y) AS hi FROM {sql_placed(SQL_V, mesh.GRID)})""")
def quantized_uvh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.quantized(mesh.rescale(vertices(spark, sf_dir))).select("tile", "z", "x", "y", "vid", "u", "v", "q")


_B = "floor((least(1e0, greatest(-1e0, {})) * 0.5e0 + 0.5e0) * 255e0 + 0.5e0)::BIGINT"
_FOLD = "CASE WHEN nz < 0 THEN (1e0 - abs({o})) * CASE WHEN {s} < 0 THEN -1e0 ELSE 1e0 END ELSE {s} END"


@query(f"""SELECT vec_id, {_B.format(_FOLD.format(o='oy', s='ox'))} AS ox, {_B.format(_FOLD.format(o='ox', s='oy'))} AS oy FROM (
             SELECT vec_id, nx / t AS ox, ny / t AS oy, nz FROM (SELECT *, abs(nx) + abs(ny) + abs(nz) AS t FROM (
               SELECT event_id AS vec_id, (event_id % 21 - 10) / 10e0 AS nx, (event_id % 13 - 6) / 6e0 AS ny, (event_id % 8 - 3.5e0) / 4e0 AS nz FROM events)))""")
def oct_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "events").selectExpr("event_id as vec_id", "(event_id % 21 - 10) / 10.0D as nx", "(event_id % 13 - 6) / 6.0D as ny", "(event_id % 8 - 3.5D) / 4.0D as nz")
    ox, oy = geometry.oct_encode((F.col("nx"), F.col("ny"), F.col("nz")))
    return rows.select("vec_id", ox.alias("ox"), oy.alias("oy"))


_A, _BB = repr(geometry.A), repr(geometry.B)


@query(f"""WITH pos AS (SELECT * FROM {SQL_P}), mid AS (SELECT z, x, y, cx / l AS dx, cy / l AS dy, cz / l AS dz FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM (
             SELECT z, x, y, (min(px) + max(px)) / 2 / {_A}::DOUBLE AS cx, (min(py) + max(py)) / 2 / {_A}::DOUBLE AS cy, (min(pz) + max(pz)) / 2 / {_BB}::DOUBLE AS cz FROM pos GROUP BY z, x, y))),
           s AS (SELECT pos.z, pos.x, pos.y, dx, dy, dz, px / {_A}::DOUBLE AS sx, py / {_A}::DOUBLE AS sy, pz / {_BB}::DOUBLE AS sz FROM pos JOIN mid ON mid.z = pos.z AND mid.x = pos.x AND mid.y = pos.y),
           u AS (SELECT *, sx / l AS ux, sy / l AS uy, sz / l AS uz, greatest(1e0, l2) AS m2, greatest(1e0, l) AS m FROM (SELECT *, sx * sx + sy * sy + sz * sz AS l2, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM s)),
           d AS (SELECT z, x, y, dx, dy, dz, (ux * dx + uy * dy + uz * dz) * (1e0 / m) - sqrt((uy * dz - uz * dy) ** 2 + (uz * dx - ux * dz) ** 2 + (ux * dy - uy * dx) ** 2) * (sqrt(m2 - 1e0) * (1e0 / m)) AS den FROM u)
           SELECT z, x, y, round(dx * m, 6) + 0e0 AS ox, round(dy * m, 6) + 0e0 AS oy, round(dz * m, 6) + 0e0 AS oz FROM (
             SELECT z, x, y, dx, dy, dz, max(1e0 / CASE WHEN den = 0 THEN 2.220446049250313e-16 ELSE den END) AS m FROM d GROUP BY ALL)""")
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mesh.occlusion_points(positions(spark, sf_dir)), "z, x, y", "ox oy oz", 6)


@query(f"""SELECT tile, z, x, y, count(*) AS n_vertices, min(h) AS min_h, max(h) AS max_h, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north
           FROM {sql_placed(f"(SELECT {_KEY}, vid, vx, vy, {sql_averaged('h')} FROM {SQL_V})", mesh.GRID)} GROUP BY tile, z, x, y""")
def grid_tile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid pipeline: vertices, heights, stitching, places; one row for each tile."""
    stitched = stitch.average_edges(vertices(spark, sf_dir), ["h"], size=mesh.GRID)
    placed = mesh.rescale(stitched)
    ends = [f(c).alias(k) for f, c, k in ((F.min, "h", "min_h"), (F.max, "h", "max_h"), (F.min, "lon", "west"), (F.min, "lat", "south"), (F.max, "lon", "east"), (F.max, "lat", "north"))]
    return placed.groupBy("tile", "z", "x", "y").agg(F.count(F.lit(1)).alias("n_vertices"), *ends)


@query(f"SELECT {_KEY}, vid, trunc(h / 7e0)::BIGINT AS h FROM {SQL_V}")
def int_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights cut to whole metres."""
    return vertices(spark, sf_dir).select("tile", "z", "x", "y", "vid", (F.col("h") / 7.0).cast("long").alias("h"))


# --- pixels ---------------------------------------------------------------

SQL_PX = f"""(SELECT tile, i AS "row", j AS col, ((tile * 31 + i * 7 + j * 13) % 97)::DOUBLE AS h FROM {SQL_MESH_TILES}, (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j))"""


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("sequence(0L, 15L)")
    rows = inputs.mesh_tiles(spark, sf_dir).select("tile").withColumn("row", F.explode(line)).withColumn("col", F.explode(line))
    return rows.withColumn("h", F.expr("cast((tile * 31 + row * 7 + col * 13) % 97 as double)"))


@query(f'SELECT tile, "row", col, CASE WHEN h = 11 THEN -1e0 ELSE h END AS h FROM {SQL_PX}')
def nodata_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir).withColumn("h", raster.replace_nodata(F.col("h"), F.lit(11.0), -1.0))


@query("""SELECT l_suppkey AS tile, l_partkey % 64 AS px, min_by(l_quantity, ordinal) AS h, min(ordinal) AS ordinal FROM (SELECT *, l_linenumber + l_orderkey * 10 AS ordinal FROM lineitem)
          WHERE l_quantity % 11 <> 0 AND ordinal IN (SELECT min(l_linenumber + l_orderkey * 10) FROM lineitem WHERE l_quantity % 11 <> 0 GROUP BY l_suppkey, l_partkey % 64) GROUP BY ALL""")
def mosaic_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel from the first dataset that has it; line numbers repeat, so the lowest height of the first decides."""
    rows = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as tile", "l_partkey % 64 as px", "l_quantity as h", "l_linenumber + l_orderkey * 10 as ordinal")
    return raster.first_valid(rows, ["tile", "px"], F.col("h") % 11 != 0)


def _block(method: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = raster.block_resample(_px(spark, sf_dir), ["tile"], 4, method, F.col("h") % 11 != 0)
        return out.withColumn("h", F.round("h", 6))

    run.__name__ = f"resample_{method}"
    rows = f'(SELECT tile, "row" // 4 AS out_row, col // 4 AS out_col, "row" % 4 AS r, col % 4 AS c, h FROM {SQL_PX} WHERE h % 11 <> 0)'
    query(sql.format(rows=rows))(run)


_GROUP = " FROM {rows} GROUP BY tile, out_row, out_col"
_block("nearest", "SELECT tile, out_row, out_col, h FROM {rows} WHERE r = 2 AND c = 2")
_block("average", "SELECT tile, out_row, out_col, round(avg(h), 6) AS h" + _GROUP)
_block("rms", "SELECT tile, out_row, out_col, round(sqrt(avg(h * h)), 6) AS h" + _GROUP)
_block("mode", "SELECT tile, out_row, out_col, h FROM (SELECT tile, out_row, out_col, h, count(*) AS n FROM {rows} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tile, out_row, out_col ORDER BY n DESC, h) = 1")
_W = "exp(-((r - 1.5e0) ** 2 + (c - 1.5e0) ** 2) / 8e0)"
_block("gauss", f"SELECT tile, out_row, out_col, round(sum(h * {_W}) / sum({_W}), 6) AS h" + _GROUP)

_KERNELS = {
    "bilinear": (1, "greatest(0e0, 1e0 - {d})"),
    "cubic": (2, "CASE WHEN {d} < 1 THEN 1.5e0 * {d} ** 3 - 2.5e0 * {d} ** 2 + 1 WHEN {d} < 2 THEN -0.5e0 * {d} ** 3 + 2.5e0 * {d} ** 2 - 4e0 * {d} + 2 ELSE 0e0 END"),
    "cubic_spline": (2, "CASE WHEN {d} < 1 THEN (4e0 - 6e0 * {d} ** 2 + 3e0 * {d} ** 3) / 6e0 WHEN {d} < 2 THEN (2e0 - {d}) ** 3 / 6e0 ELSE 0e0 END"),
    "lanczos": (3, "CASE WHEN {d} = 0 THEN 1e0 WHEN {d} < 3 THEN sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) ELSE 0e0 END"),
}


def _interpolated(method: str, taps: int, kernel: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = inputs.mesh_tiles(spark, sf_dir).selectExpr("tile", "explode(sequence(0L, 8L)) as pid").withColumns({"px": F.expr("1.25D + pid * 1.5D"), "py": F.expr("13.5D - pid * 1.25D")})
        out = raster.interpolate(points, _px(spark, sf_dir), ["tile"], method)
        return out.withColumn("h", F.round("h", 6))

    run.__name__ = f"resample_{method}"
    w = f"({kernel.format(d='abs(py - p.row)')}) * ({kernel.format(d='abs(px - p.col)')})"
    query(f"""SELECT tile, pid, round(sum(w * h) / sum(w), 6) AS h FROM (SELECT q.tile, pid, h, {w} AS w FROM (
                SELECT tile, pid, 1.25e0 + pid * 1.5e0 AS px, 13.5e0 - pid * 1.25e0 AS py FROM {SQL_MESH_TILES}, (SELECT unnest(range(0, 9)) AS pid)) q
              JOIN {SQL_PX.replace('AS "row"', "AS row")} p ON p.tile = q.tile AND p.row BETWEEN floor(py) + {1 - taps} AND floor(py) + {taps} AND p.col BETWEEN floor(px) + {1 - taps} AND floor(px) + {taps})
              WHERE w <> 0 GROUP BY tile, pid""")(run)


for _method, (_taps, _kernel) in _KERNELS.items():
    _interpolated(_method, _taps, _kernel)


# --- meshes that SQL cannot express: tested against plain versions ---------


def grid_tiles(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """lon, lat, h, positions and normals of grid tiles that agree with their neighbours.

    Normals come from each tile's own faces, weighted by area; then normals and heights are averaged over shared edges.
    """
    return serve.GridStitcher().stitch(vertices, triangles)


@query()
def encode_grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantized-mesh bytes of the stitched grid tiles of 35 x 35 cells, with normals, compressed."""
    triangles = mesh.grid_triangles(inputs.mesh_tiles(spark, sf_dir), 35).drop("tile")
    tiles = tile_meshes.grouped(vertices(spark, sf_dir, 35).drop("tile", "i", "j"), triangles)
    return encode.encode_meshes(tile_meshes.stitched_grids(tiles, size=mesh.GRID))


#: Pixels on a side of the rasters of adaptive meshes, less one.
SIDE = 256


def _heights(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slope (in millionths, as decimals have them), a bowl and a step for each tile."""
    r, c = np.mgrid[: SIDE + 1, : SIDE + 1].reshape(2, -1)
    slope = (c * r * 20_000 + 9) // 18
    for whole in batches:
        for b in (whole.slice(k, adaptive.AT_ONCE) for k in range(0, whole.num_rows, adaptive.AT_ONCE)):
            t = b.column("tile").to_numpy()[:, None]
            bowl = (c - 20.0 * (t % 9) - 40.0) ** 2 / 400.0
            h = (t % 7 * 3_000_000 + slope) / 1e6 + bowl + np.where(r > 100 + t % 50, 12.0, 0.0)
            heights = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * h.shape[1], pa.int32()), pa.array(h.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in "zxy"), heights], [*"zxy", "heights"])


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mesh tile's raster of 257 x 257 in one row; neighbours differ at their edges."""
    return inputs.mesh_tiles(spark, sf_dir).mapInArrow(_heights, "z long, x long, y long, heights array<float>")


@query()
def martini_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.triangulate(_grids(spark, sf_dir), "martini", max_error=4.0)


@query()
def delatin_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.triangulate(_grids(spark, sf_dir), "delatin", max_error=4.0)


@query()
def martini_remesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive meshes triangulated anew with their neighbours' edge vertices."""
    return adaptive.remesh(adaptive.triangulate(_grids(spark, sf_dir), "martini", max_error=4.0), size=SIDE)


def adaptive_tiles(meshes: DataFrame) -> DataFrame:
    """Tiles with positions and normals, from meshes with equal places on shared edges.

    Heights are averaged over the edges, then normals are taken from the faces and averaged too.
    """
    return tile_meshes.stitched_adaptive(adaptive.as_tiles(meshes), size=SIDE)


@query()
def martini_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What martini_tiles encodes: neighbours agree on their edges in places, heights and normals."""
    v = tile_meshes.vertices(adaptive_tiles(martini_remesh(spark, sf_dir)))
    return v.select("z", "x", "y", "vid", "vx", "vy", "h", "nx", "ny", "nz")


@query()
def martini_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of adaptive meshes whose edges agree with their neighbours' in places, heights and normals."""
    return encode.encode_meshes(adaptive_tiles(martini_remesh(spark, sf_dir)))


@query()
def delatin_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from greedy insertion."""
    meshes = adaptive.remesh(adaptive.triangulate(_grids(spark, sf_dir), "delatin", max_error=4.0), size=SIDE)
    return encode.encode_meshes(adaptive_tiles(meshes))


@query(f"SELECT z, x, y, true AS same FROM {SQL_MESH_TILES}")
def gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed tiles hold the same bytes as plain ones."""
    v = mesh.geocentric_normals(mesh.to_ecef(mesh.rescale(vertices(spark, sf_dir, 18))))
    t = mesh.grid_triangles(inputs.mesh_tiles(spark, sf_dir), 18)
    plain = encode.encode_tiles(v, t, compress=False).select("z", "x", "y", F.col("data").alias("plain"))
    packed = encode.encode_tiles(v, t).repartition("z", "x", "y")  # so that no task has Python workers for both at once
    opened = encode.decompress(packed)
    return opened.join(plain.hint("merge"), ["z", "x", "y"]).select("z", "x", "y", (F.col("data") == F.col("plain")).alias("same"))
