"""Stand-ins for rasters, points, catalogs, requests and options, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import tiling
from orograph.operators.tables import kept, shared_folder, spread

__all__ = ["kept", "shared_folder"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lon, lat, h of the line items."""
    return table(spark, sf_dir, "lineitem").select(
        (F.expr("(l_partkey % 3600) / 10.0D") - 180.0).alias("lon"),
        (F.expr("((l_suppkey * 7 + l_linenumber * 13) % 1800) / 10.0D") - 89.95).alias("lat"),
        F.col("l_quantity").alias("h"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, z, x, y (from the north) of the tiles that events ask for."""
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "user_id",
        "cast(1 + event_id % 6 as bigint) as z",
        "cast(user_id % cast(pow(2, 2 + event_id % 6) as bigint) as bigint) as x",
        "cast(event_id % cast(pow(2, 1 + event_id % 6) as bigint) as bigint) as y",
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tiles asked for, with their boxes."""
    keys = requests(spark, sf_dir).select("z", "x", "y").distinct()
    return keys.withColumns(tiling.bounds(F.col("z"), F.col("x"), F.col("y")))


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic's datasets: ordinal, region and box of each nation."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as ordinal",
        "cast(n_regionkey as bigint) as region",
        "n_name as name",
        "n_nationkey * 10.0D - 125.0D as left",
        "n_regionkey * 15.0D - 40.0D as bottom",
        "n_nationkey * 10.0D - 113.0D as right",
        "n_regionkey * 15.0D - 20.0D as top",
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests' optional parameters, many of them null."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as id",
        "p_size",
        "cast(10 + p_partkey % 14 as bigint) as z",
        "case when p_size % 2 = 0 then concat('./data/', p_brand, '.tif') end as cog",
        "case when p_size % 3 = 0 then cast(p_size % 5 as bigint) end as min_zoom",
        "case when p_size % 5 = 0 then cast(p_size as bigint) end as max_zoom",
        "case when p_size % 4 = 0 then 'martini' when p_size % 7 = 0 then 'delatin' when p_size % 11 = 0 then 'other' end as meshing",
        "case when p_size % 6 = 0 then cast(p_size as double) end as no_data",
        "case when p_size % 9 = 0 then true end as skip_cache",
        "case when p_size % 3 = 1 then cast(p_size as bigint) end as grid_size",
        "case when p_size % 8 = 0 then concat('{\"15\":', p_size, ',\"17\":40}') when p_size % 8 = 1 then '{\"15\":' end as grid_sizes",
        "case when p_size % 4 = 1 then cast(p_size as double) end as max_error",
        "case when p_size % 6 = 0 then '{\"16\":2.5,\"20\":0.25}' end as max_errors",
    )


#: A mesh tile has up to 66,049 pixels or vertices.
TILES_A_TASK = 100


def mesh_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, z, x, y: a block of tiles ten wide at zoom 7, one for each supplier."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as tile", "7L as z", "s_suppkey % 10 as x", "s_suppkey div 10 as y")
    return spread(rows, "z", "x", "y", each=TILES_A_TASK)


#: Height of a mesh tile's raster at column i and row j.
HEIGHT = "cast((tile * 31 + i * 7 + j * 13) % 97 as double)"

# The same stand-ins as DuckDB SQL.
SQL_POINTS = """(SELECT (l_partkey % 3600) / 10e0 - 180e0 AS lon, ((l_suppkey * 7 + l_linenumber * 13) % 1800) / 10e0 - 89.95e0 AS lat, l_quantity AS h
                 FROM lineitem)"""
SQL_REQUESTS = """(SELECT event_id, ts, user_id, (1 + event_id % 6)::BIGINT AS z, (user_id % (2 ** (2 + event_id % 6))::BIGINT)::BIGINT AS x,
                          (event_id % (2 ** (1 + event_id % 6))::BIGINT)::BIGINT AS y FROM events)"""
SQL_BOUNDS = """-180e0 + x * (180e0 / 2 ** z) AS "left", 90e0 - y * (180e0 / 2 ** z) - (180e0 / 2 ** z) AS bottom,
                -180e0 + x * (180e0 / 2 ** z) + (180e0 / 2 ** z) AS "right", 90e0 - y * (180e0 / 2 ** z) AS top"""
SQL_TILES = f"(SELECT z, x, y, {SQL_BOUNDS} FROM (SELECT DISTINCT z, x, y FROM {SQL_REQUESTS}))"
SQL_EXTENTS = """(SELECT n_nationkey::BIGINT AS ordinal, n_regionkey::BIGINT AS region, n_name AS name, n_nationkey * 10e0 - 125e0 AS "left",
                         n_regionkey * 15e0 - 40e0 AS bottom, n_nationkey * 10e0 - 113e0 AS "right", n_regionkey * 15e0 - 20e0 AS top FROM nation)"""
SQL_OPTIONS = """(SELECT p_partkey AS id, p_size, (10 + p_partkey % 14)::BIGINT AS z,
                         CASE WHEN p_size % 2 = 0 THEN concat('./data/', p_brand, '.tif') END AS cog,
                         CASE WHEN p_size % 3 = 0 THEN (p_size % 5)::BIGINT END AS min_zoom,
                         CASE WHEN p_size % 5 = 0 THEN p_size::BIGINT END AS max_zoom,
                         CASE WHEN p_size % 4 = 0 THEN 'martini' WHEN p_size % 7 = 0 THEN 'delatin' WHEN p_size % 11 = 0 THEN 'other' END AS meshing,
                         CASE WHEN p_size % 6 = 0 THEN p_size::DOUBLE END AS no_data,
                         CASE WHEN p_size % 9 = 0 THEN true END AS skip_cache,
                         CASE WHEN p_size % 3 = 1 THEN p_size::BIGINT END AS grid_size,
                         CASE WHEN p_size % 8 = 0 THEN concat('{"15":', p_size, ',"17":40}') WHEN p_size % 8 = 1 THEN '{"15":' END AS grid_sizes,
                         CASE WHEN p_size % 4 = 1 THEN p_size::DOUBLE END AS max_error,
                         CASE WHEN p_size % 6 = 0 THEN '{"16":2.5,"20":0.25}' END AS max_errors FROM part)"""
SQL_MESH_TILES = "(SELECT s_suppkey AS tile, 7::BIGINT AS z, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier)"
SQL_HEIGHT = "((tile * 31 + i * 7 + j * 13) % 97)::DOUBLE"


def sql_vertices(n: int, size: int) -> str:
    """The grid vertices of the mesh tiles, with heights."""
    at = lambda c: f"CASE WHEN {c} = {n} THEN {size} ELSE trunc({c} * ({size} / {n}))::BIGINT END"
    return f"""(SELECT tile, z, x, y, i, j, j * {n + 1} + i AS vid, ({at("i")})::BIGINT AS vx, ({at("j")})::BIGINT AS vy, {SQL_HEIGHT} AS h
                FROM {SQL_MESH_TILES}, (SELECT unnest(range(0, {n + 1})) AS i), (SELECT unnest(range(0, {n + 1})) AS j))"""
