"""Queries on tiles: assignment, boxes, neighbours, ranges, seeding order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import tiling
from orograph.operators import catalog, stitch
from orograph.plans import inputs
from orograph.plans.inputs import SQL_EXTENTS, SQL_POINTS, SQL_REQUESTS, SQL_TILES
from orograph.plans.registry import query
from orograph.sources import tiles

_BOX = '"left", bottom, "right", top'


def sql_ranges(boxes: str, key: str, max_zoom: int) -> str:
    """Tile ranges by zoom of boxes, rows counted from the south."""
    eps = tiling.NUDGE
    return f"""(SELECT {key}, z, least(x0, x1) AS start_x, rows - 1 - greatest(yn, ys) AS start_y, greatest(x0, x1) AS end_x, rows - 1 - least(yn, ys) AS end_y FROM (
        SELECT {key}, z, (2 ** z)::BIGINT AS rows,
               floor((l + {eps!r} + 180e0) / (180e0 / 2 ** z))::BIGINT AS x0, floor((r - {eps!r} + 180e0) / (180e0 / 2 ** z))::BIGINT AS x1,
               floor((90e0 - (t - {eps!r})) / (180e0 / 2 ** z))::BIGINT AS yn, floor((90e0 - (b + {eps!r})) / (180e0 / 2 ** z))::BIGINT AS ys
        FROM (SELECT {key}, greatest("left", -180e0) AS l, greatest(bottom, -90e0) AS b, least("right", 180e0) AS r, least(top, 90e0) AS t FROM {boxes}),
             (SELECT unnest(range(1, {max_zoom + 1})) AS z)))"""


@query(f"""SELECT z, floor((lon + 180e0) / (180e0 / 2 ** z))::BIGINT AS x, floor((90e0 - lat) / (180e0 / 2 ** z))::BIGINT AS y, count(*) AS n, max(h) AS highest
           FROM {SQL_POINTS}, (SELECT unnest([1, 3, 6])::BIGINT AS z) GROUP BY ALL""")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by tile at three zooms."""
    rows = inputs.points(spark, sf_dir).withColumn("z", F.explode(F.expr("array(1L, 3L, 6L)")))
    z = F.col("z")
    return rows.groupBy("z", tiling.tile_x(F.col("lon"), z).alias("x"), tiling.tile_y(F.col("lat"), z).alias("y")).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("highest"))


@query(f"SELECT z, x, y, {_BOX} FROM {SQL_TILES}")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.tiles(spark, sf_dir)


@query(f"SELECT event_id, z, x, y, (2 ** z)::BIGINT - 1 - y AS y_tms, y AS y_back FROM {SQL_REQUESTS}")
def tms_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the south, and back."""
    rows = inputs.requests(spark, sf_dir).withColumn("y_tms", tiling.flip_y(F.col("y"), F.col("z")))
    return rows.select("event_id", "z", "x", "y", "y_tms", tiling.flip_y(F.col("y_tms"), F.col("z")).alias("y_back"))


_OFFSETS = ", ".join(f"('{n}', {dx}, {dy})" for n, dx, dy in tiling.DIRECTIONS)


@query(f"""SELECT z, x, y, direction, x + dx AS nx, y + dy AS ny FROM {SQL_TILES}, (VALUES {_OFFSETS}) o(direction, dx, dy)
           WHERE x + dx BETWEEN 0 AND (2 ** (z + 1))::BIGINT - 1 AND y + dy BETWEEN 0 AND (2 ** z)::BIGINT - 1""")
def tile_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitch.neighbours(inputs.tiles(spark, sf_dir).select("z", "x", "y"))


@query(f"""SELECT DISTINCT z, x + dx AS x, y + dy AS y FROM {SQL_TILES}, (VALUES ('', 0, 0), {_OFFSETS}) o(direction, dx, dy)
           WHERE x + dx BETWEEN 0 AND (2 ** (z + 1))::BIGINT - 1 AND y + dy BETWEEN 0 AND (2 ** z)::BIGINT - 1""")
def tiles_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requested tiles and their rings, each once."""
    return stitch.expand(inputs.tiles(spark, sf_dir))


@query(f"SELECT ordinal, z, start_x, start_y, end_x, end_y FROM {sql_ranges(SQL_EXTENTS, 'ordinal', 12)}")
def tile_ranges_by_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.availability(inputs.extents(spark, sf_dir), ["ordinal"], max_zoom=12)


@query("""SELECT event_id, greatest(lon - 40e0, -180e0) AS "left", greatest(lat - 30e0, -90e0) AS bottom, least(lon + 40e0, 180e0) AS "right", least(lat + 30e0, 90e0) AS top
          FROM (SELECT event_id, (event_id % 3600) / 10e0 - 180e0 AS lon, (user_id * 7 % 1800) / 10e0 - 89.95e0 AS lat FROM events)""")
def bbox_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around places, cut to the world."""
    rows = inputs.table(spark, sf_dir, "events").select("event_id", F.expr("(event_id % 3600) / 10.0D - 180.0D").alias("lon"), F.expr("(user_id * 7 % 1800) / 10.0D - 89.95D").alias("lat"))
    box = tiling.clamp(F.col("lon") - 40.0, F.col("lat") - 30.0, F.col("lon") + 40.0, F.col("lat") + 30.0)
    return rows.select("event_id", *(c.alias(k) for k, c in box.items()))


def _morton_sql(x: str, y: str) -> str:
    return f"list_sum(list_transform(range(0, 31), lambda b: ((({x} >> b) & 1) << (2 * b)) | ((({y} >> b) & 1) << (2 * b + 1))))::BIGINT"


@query(f"SELECT z, x, y, {_morton_sql('x', 'y')} AS code FROM {SQL_TILES}")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles along the Z-order curve of their zoom."""
    rows = inputs.tiles(spark, sf_dir).select("z", "x", "y", tiling.morton(F.col("x"), F.col("y")).alias("code"))
    return rows.orderBy("z", "code")


@query("""SELECT id, zooms, unnest(string_split(zooms, '-'))::BIGINT AS z FROM (
            SELECT p_partkey AS id, concat(5 + p_size % 4, '-', 10 + p_size % 3, CASE WHEN p_size % 2 = 0 THEN '-15' ELSE '' END) AS zooms FROM part)""")
def zoom_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of zooms, not ranges."""
    rows = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat(5 + p_size % 4, '-', 10 + p_size % 3, case when p_size % 2 = 0 then '-15' else '' end) as zooms")
    return rows.select("id", "zooms", F.explode(tiling.zoom_list(F.col("zooms"))).alias("z"))


SQL_SEED = f"""(SELECT ordinal, z, x, unnest(range(start_y, end_y + 1)) AS y FROM (
                 SELECT ordinal, z, start_y, end_y, unnest(range(start_x, end_x + 1)) AS x FROM {sql_ranges(SQL_EXTENTS, 'ordinal', 6)}))"""


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.seed_tiles(catalog.availability(inputs.extents(spark, sf_dir), ["ordinal"], max_zoom=6))


@query(f"SELECT ordinal, z, x, y, {_morton_sql('x', 'y')} AS code FROM {SQL_SEED}")
def seed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile of the datasets' ranges, with its place on the curve."""
    return _seed(spark, sf_dir)


@query(f"""SELECT DISTINCT z, x, y FROM {SQL_SEED} s WHERE NOT EXISTS (
             SELECT 1 FROM {SQL_REQUESTS} r WHERE r.z = s.z AND r.x = s.x AND (2 ** r.z)::BIGINT - 1 - r.y = s.y)""")
def seed_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to generate: those of the ranges that aren't stored yet."""
    stored = inputs.requests(spark, sf_dir).select("z", "x", tiling.flip_y(F.col("y"), F.col("z")).alias("y"))
    return _seed(spark, sf_dir).select("z", "x", "y").distinct().join(stored, ["z", "x", "y"], "left_anti")


@query(f"""SELECT z, batch, count(*) AS n, min(code) AS first_code, max(code) AS last_code FROM (
             SELECT z, code, (row_number() OVER (PARTITION BY z ORDER BY code) - 1) // 10 AS batch FROM (
               SELECT DISTINCT z, {_morton_sql('x', 'y')} AS code FROM {SQL_SEED})) GROUP BY ALL""")
def seed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten tiles along each zoom's curve."""
    seeds = _seed(spark, sf_dir).select("z", "code").distinct()
    numbered = catalog.number(seeds, ["z"], ["code"])
    batch = F.expr("_n div 10").alias("batch")
    return numbered.groupBy("z", batch).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code"), F.max("code").alias("last_code"))


@query(f"""SELECT z, count(*) AS tiles, min(x) AS start_x, min(y) AS start_y, max(x) AS end_x, max(y) AS end_y FROM (
             SELECT z, floor((lon + 180e0) / (180e0 / 2 ** z))::BIGINT AS x, (2 ** z)::BIGINT - 1 - floor((90e0 - lat) / (180e0 / 2 ** z))::BIGINT AS y
             FROM {SQL_POINTS}, (SELECT unnest(range(1, 9)) AS z)) GROUP BY z""")
def point_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of tiles that points cover at each zoom."""
    rows = inputs.points(spark, sf_dir).withColumn("z", F.explode(F.expr("sequence(1L, 8L)")))
    z = F.col("z")
    rows = rows.select("z", tiling.tile_x(F.col("lon"), z).alias("x"), tiling.flip_y(tiling.tile_y(F.col("lat"), z), z).alias("y"))
    return rows.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.min("x").alias("start_x"), F.min("y").alias("start_y"), F.max("x").alias("end_x"), F.max("y").alias("end_y"))


@query(f"""SELECT z, x, y, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS is_empty FROM (
             SELECT t.z, t.x, t.y, p.n FROM {SQL_TILES} t LEFT JOIN (
               SELECT z, floor((lon + 180e0) / (180e0 / 2 ** z))::BIGINT AS x, floor((90e0 - lat) / (180e0 / 2 ** z))::BIGINT AS y, count(*) AS n
               FROM {SQL_POINTS}, (SELECT unnest(range(1, 7)) AS z) GROUP BY ALL) p ON p.z = t.z AND p.x = t.x AND p.y = t.y)""")
def tile_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points each requested tile holds."""
    rows = inputs.points(spark, sf_dir).withColumn("z", F.explode(F.expr("sequence(1L, 6L)")))
    z = F.col("z")
    counts = rows.groupBy("z", tiling.tile_x(F.col("lon"), z).alias("x"), tiling.tile_y(F.col("lat"), z).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    met = inputs.tiles(spark, sf_dir).select("z", "x", "y").join(counts, ["z", "x", "y"], "left")
    return met.select("z", "x", "y", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("is_empty"))




@query(f"SELECT DISTINCT z, x, y, {_morton_sql('x', 'y')} AS code FROM {SQL_SEED}")
def seed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding in two runs: the second stores only what the first has not."""
    path = inputs.shared_folder(spark, "tiles")
    seeds = _seed(spark, sf_dir).select("z", "x", "y", "code").distinct()
    tiles.write(seeds.where("x % 2 = 0"), path)
    tiles.write(tiles.missing(seeds, path), path)
    return tiles.read(spark, path).select("z", "x", "y", "code")
