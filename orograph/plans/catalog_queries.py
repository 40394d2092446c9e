"""Queries on datasets: mosaics, extents, availability, parameters, keys and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import params, tiling
from orograph.operators import catalog, raster
from orograph.plans import inputs
from orograph.plans.inputs import SQL_EXTENTS, SQL_OPTIONS, SQL_TILES
from orograph.plans.registry import query
from orograph.plans.tile_queries import sql_ranges

_MEETS = 'NOT (t."left" > e."right" OR t."right" < e."left" OR t.bottom > e.top OR t.top < e.bottom)'
SQL_PAIRS = f"(SELECT t.z, t.x, t.y, e.ordinal FROM {SQL_TILES} t JOIN {SQL_EXTENTS} e ON {_MEETS})"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.prune(inputs.tiles(spark, sf_dir), inputs.extents(spark, sf_dir))


@query(f"SELECT z, x, y, ordinal FROM {SQL_PAIRS}")
def mosaic_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets that each tile needs."""
    return _pairs(spark, sf_dir)


@query(f"SELECT z, x, y, ordinal FROM {SQL_PAIRS}")
def mosaic_prune_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a catalog of any size: joined by cells of a coarse zoom."""
    return catalog.prune(inputs.tiles(spark, sf_dir), inputs.extents(spark, sf_dir), small=0)


@query(f"SELECT * FROM (SELECT z, x, y, ordinal, count(*) OVER (PARTITION BY z, x, y) AS n FROM {SQL_PAIRS}) WHERE n <= 10")
def mosaic_fan_in_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fan_in_guard(_pairs(spark, sf_dir))


@query("""SELECT a.ordinal, b.ordinal AS other FROM (SELECT *, n_nationkey::BIGINT AS ordinal, n_nationkey * 12e0 - 125e0 AS l FROM nation) a
          JOIN (SELECT *, n_nationkey::BIGINT AS ordinal, n_nationkey * 12e0 - 125e0 AS l FROM nation) b
          ON NOT (a.l > b.l + 12 OR a.l + 12 < b.l) AND a.n_nationkey < b.n_nationkey""")
def extents_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring boxes that share an edge meet."""
    rows = inputs.table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as ordinal", "n_nationkey * 12.0D - 125.0D as left", "0.0D as bottom", "n_nationkey * 12.0D - 113.0D as right", "1.0D as top")
    tiles = rows.selectExpr("0L as z", "ordinal as x", "0L as y", "left", "bottom", "right", "top")
    pairs = catalog.prune(tiles, rows)
    return pairs.where("x < ordinal").select(F.col("x").alias("ordinal"), F.col("ordinal").alias("other"))


@query(f"""SELECT least(180e0, min("left")) AS "left", least(90e0, min(bottom)) AS bottom, greatest(-180e0, max("right")) AS "right", greatest(-90e0, max(top)) AS top FROM {SQL_EXTENTS}""")
def mosaic_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.extent(inputs.extents(spark, sf_dir))


@query(f"""SELECT t.z, t.x, t.y, NOT (t."left" > m.r OR t."right" < m.l OR t.bottom > m.t OR t.top < m.b) AS inside FROM {SQL_TILES} t,
           (SELECT min("left") AS l, min(bottom) AS b, max("right") AS r, max(top) AS t FROM {SQL_EXTENTS}) m""")
def overall_extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a tile meets the mosaic's whole extent (one row, broadcast)."""
    whole = catalog.extent(inputs.extents(spark, sf_dir)).alias("m")
    rows = inputs.tiles(spark, sf_dir).alias("t").join(F.broadcast(whole))
    return rows.select("t.z", "t.x", "t.y", tiling.intersects(catalog.box("t"), catalog.box("m")).alias("inside"))


@query("""SELECT ordinal, list_min(xs) AS "left", list_min(ys) AS bottom, list_max(xs) AS "right", list_max(ys) AS top FROM (
            SELECT n_nationkey::BIGINT AS ordinal, [n_nationkey * 7e0 % 50, n_nationkey * 3e0, n_nationkey * 11e0 % 90] AS xs, [n_regionkey * 5e0, n_nationkey * 2e0 % 17, 4e0] AS ys FROM nation)""")
def ring_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of a ring of points."""
    rows = inputs.table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as ordinal",
        "array(struct(n_nationkey * 7.0D % 50 as x, n_regionkey * 5.0D as y), struct(n_nationkey * 3.0D as x, n_nationkey * 2.0D % 17 as y), struct(n_nationkey * 11.0D % 90 as x, 4.0D as y)) as ring",
    )
    return rows.select("ordinal", *(c.alias(k) for k, c in catalog.ring_box(F.col("ring")).items()))


SQL_VALID = "(SELECT l_suppkey AS tile, l_partkey % 64 AS \"row\", (l_partkey // 64) % 64 AS col, l_quantity AS h FROM lineitem WHERE l_quantity % 11 <> 0)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as tile", "l_partkey % 64 as row", "(l_partkey div 64) % 64 as col", "l_quantity as h")


@query(f"SELECT tile, min(col) AS min_col, min(\"row\") AS min_row, max(col) AS max_col, max(\"row\") AS max_row FROM {SQL_VALID} GROUP BY tile")
def valid_pixel_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.valid_extent(_pixels(spark, sf_dir), ["tile"], F.col("h") % 11 != 0)


@query(f"""SELECT tile, 5e0 + min(col) * 0.01e0 AS "left", 60e0 - (max("row") + 1) * 0.01e0 AS bottom, 5e0 + (max(col) + 1) * 0.01e0 AS "right", 60e0 - min("row") * 0.01e0 AS top
           FROM {SQL_VALID} GROUP BY tile""")
def affine_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pixels' box in degrees; the far edges lie behind the last pixels."""
    at = raster.valid_extent(_pixels(spark, sf_dir), ["tile"], F.col("h") % 11 != 0)
    left, top, pixel = F.lit(5.0), F.lit(60.0), F.lit(0.01)
    x0, y1 = raster.affine(F.col("min_col"), F.col("min_row"), left, top, pixel)
    x1, y0 = raster.affine(F.col("max_col") + 1, F.col("max_row") + 1, left, top, pixel)
    return at.select("tile", x0.alias("left"), y0.alias("bottom"), x1.alias("right"), y1.alias("top"))


_PATH = "concat('./d/', p_partkey, CASE p_size % 6 WHEN 0 THEN '.ctod' WHEN 1 THEN '.json' WHEN 2 THEN '.vrt' WHEN 3 THEN '.tif' WHEN 4 THEN '.JSON' ELSE '' END)"


@query(f"""SELECT p_partkey AS id, path, CASE WHEN path LIKE '%.ctod' OR path LIKE '%.json' THEN 'mosaic' WHEN path LIKE '%.vrt' THEN 'vrt' ELSE 'cog' END AS type
           FROM (SELECT p_partkey, {_PATH} AS path FROM part)""")
def dataset_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{_PATH} as path")
    return rows.withColumn("type", params.dataset_type(F.col("path")))


@query(f"""SELECT id, coalesce(cog, './data/default.tif') AS cog, coalesce(min_zoom, 1) AS min_zoom, coalesce(max_zoom, 18) AS max_zoom,
           CASE WHEN meshing IN ('grid', 'martini', 'delatin') THEN meshing ELSE 'grid' END AS meshing, coalesce(no_data, 0e0) AS no_data, coalesce(skip_cache, false) AS skip_cache FROM {SQL_OPTIONS}""")
def param_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.options(spark, sf_dir)
    d = params.with_default
    return o.select(
        "id",
        d(F.col("cog"), "cog").alias("cog"),
        d(F.col("min_zoom"), "minZoom").alias("min_zoom"),
        d(F.col("max_zoom"), "maxZoom").alias("max_zoom"),
        params.mesher(F.col("meshing")).alias("meshing"),
        F.coalesce("no_data", F.lit(float(params.DEFAULTS["noData"]))).alias("no_data"),
        d(F.col("skip_cache"), "skipCache").alias("skip_cache"),
    )


def _per_zoom_sql(settings: str, default: str, built_in: str, last: int, kind: str) -> str:
    chosen = f"CASE WHEN {settings} IS NULL AND {default} IS NULL THEN '{built_in}' ELSE {settings} END"
    return f"""SELECT id, z, coalesce(CASE WHEN json_valid(m) THEN json_extract_string(m, concat('$."', z, '"'))::DOUBLE END, {default}::DOUBLE, {last})::{kind} AS setting
               FROM (SELECT *, {chosen} AS m FROM {SQL_OPTIONS})"""


@query(_per_zoom_sql("grid_sizes", "grid_size", params.ZOOM_GRID_SIZES, 18, "BIGINT"))
def zoom_grid_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.options(spark, sf_dir).select("id", "z", params.grid_size(F.col("z"), F.col("grid_sizes"), F.col("grid_size")).alias("setting"))


@query(_per_zoom_sql("max_errors", "max_error", params.ZOOM_MAX_ERRORS, 4, "DOUBLE"))
def zoom_max_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.options(spark, sf_dir).select("id", "z", params.max_error(F.col("z"), F.col("max_errors"), F.col("max_error")).alias("setting"))


@query(f"""SELECT id, CASE WHEN tail = '' THEN '{{z}}/{{x}}/{{y}}.terrain?v=1' ELSE concat('{{z}}/{{x}}/{{y}}.terrain?v=1&', tail) END AS url FROM (
             SELECT id, concat_ws('&', 'cog=' || cog, 'minZoom=' || min_zoom, 'maxZoom=' || max_zoom, 'meshingMethod=' || meshing, 'defaultGridSize=' || grid_size) AS tail FROM {SQL_OPTIONS})""")
def query_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.options(spark, sf_dir)
    values = {"cog": F.col("cog"), "minZoom": F.col("min_zoom"), "maxZoom": F.col("max_zoom"), "meshingMethod": F.col("meshing"), "defaultGridSize": F.col("grid_size")}
    return o.select("id", params.query_url(F.lit("{z}/{x}/{y}.terrain?v=1"), **values).alias("url"))


_ACCEPT = "CASE p_size % 4 WHEN 0 THEN 'application/vnd.quantized-mesh;extensions=octvertexnormals-watermask,*/*;q=0.01' WHEN 1 THEN 'a/b;extensions=metadata' WHEN 2 THEN '*/*' END"
_WANTED = "CASE p_size % 3 WHEN 0 THEN 'octvertexnormals-other' WHEN 1 THEN 'watermask' END"


@query(f"""SELECT id, array_to_string(list_sort(list_filter(['octvertexnormals', 'watermask', 'metadata'], lambda k: list_contains(asked, k))), ',') AS extensions FROM (
             SELECT p_partkey AS id, list_concat(string_split(regexp_extract(coalesce({_ACCEPT}, ''), 'extensions=([A-Za-z-]+)', 1), '-'), string_split(coalesce({_WANTED}, ''), '-')) AS asked FROM part)""")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{_ACCEPT} as accept", f"{_WANTED} as wanted")
    return rows.select("id", F.array_join(params.extensions(F.col("accept"), F.col("wanted")), ",").alias("extensions"))


@query(f"SELECT p_partkey AS id, p_brand AS name, o.id AS option_id, o.id IS NOT NULL AS found FROM part LEFT JOIN (SELECT max(id) AS id, cog FROM {SQL_OPTIONS} WHERE p_size % 4 = 0 GROUP BY cog) o ON o.cog = concat('./data/', p_brand, '.tif')")
def dataset_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by dataset name; an unknown name is not found."""
    named = catalog.last_wins(inputs.options(spark, sf_dir).where("cog is not null and p_size % 4 = 0").select("cog", "id"), "cog", "id").withColumnRenamed("id", "option_id")
    asked = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_brand as name", "concat('./data/', p_brand, '.tif') as cog")
    return asked.join(named, "cog", "left").select("id", "name", "option_id", F.col("option_id").isNotNull().alias("found"))


@query(f"SELECT cog, id, p_size FROM {SQL_OPTIONS} WHERE cog IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cog ORDER BY id DESC) = 1")
def dataset_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.last_wins(inputs.options(spark, sf_dir).where("cog is not null").select("cog", "id", "p_size"), "cog", "id")


@query(f"""SELECT id, concat_ws('; ', CASE WHEN cog IS NULL THEN 'no name' END, CASE WHEN min_zoom > max_zoom THEN 'zooms' END, CASE WHEN grid_sizes IS NOT NULL AND NOT json_valid(grid_sizes) THEN 'grid sizes' END) AS problems FROM {SQL_OPTIONS}""")
def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each entry of a catalog; empty where nothing is."""
    bad_json = F.col("grid_sizes").isNotNull() & F.get_json_object("grid_sizes", "$").isNull()
    problems = F.concat_ws("; ", F.when(F.col("cog").isNull(), "no name"), F.when(F.col("min_zoom") > F.col("max_zoom"), "zooms"), F.when(bad_json, "grid sizes"))
    return inputs.options(spark, sf_dir).select("id", problems.alias("problems"))


def _layer_sql(levels: int, max_zoom: int) -> str:
    item = """concat('[{"startX":', start_x, ',"startY":', start_y, ',"endX":', end_x, ',"endY":', end_y, '}]')"""
    rows = f"SELECT ordinal, 0 AS z, 0 AS start_x, 0 AS start_y, 1 AS end_x, 0 AS end_y FROM {SQL_EXTENTS} UNION ALL SELECT ordinal, z, start_x, start_y, end_x, end_y FROM {sql_ranges(SQL_EXTENTS, 'ordinal', max_zoom)}"
    return f"SELECT ordinal, concat('[', string_agg({item}, ',' ORDER BY z), ']') AS available FROM ({rows}) WHERE z < {levels} GROUP BY ordinal"


@query(_layer_sql(99, 9))
def layer_json_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = catalog.availability(inputs.extents(spark, sf_dir), ["ordinal"], max_zoom=9, first=0)
    return catalog.layer_json(ranges, ["ordinal"])


@query(_layer_sql(5, 9))
def layer_json_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the levels that were seeded."""
    ranges = catalog.availability(inputs.extents(spark, sf_dir), ["ordinal"], max_zoom=9, first=0)
    return catalog.layer_json(ranges, ["ordinal"], levels=5)


@query(f"""SELECT ordinal, CASE WHEN ordinal % 3 = 0 THEN 'mosaic' ELSE 'cog' END AS type, CASE WHEN ordinal % 3 = 0 THEN m.l ELSE "left" END AS "left", CASE WHEN ordinal % 3 = 0 THEN m.r ELSE "right" END AS "right"
           FROM {SQL_EXTENTS} e JOIN (SELECT region, min("left") AS l, max("right") AS r FROM {SQL_EXTENTS} GROUP BY region) m USING (region)""")
def layer_bounds_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic's layer takes the bounds of its extent, a single file's its own."""
    e = inputs.extents(spark, sf_dir).withColumn("type", params.dataset_type(F.expr("concat(name, if(ordinal % 3 = 0, '.json', '.tif'))")))
    m = catalog.extent(e, "region").selectExpr("region", "left as l", "right as r")
    pick = lambda a, b: F.when(F.col("type") == "mosaic", F.col(a)).otherwise(F.col(b))
    return e.join(m, "region").select("ordinal", "type", pick("l", "left").alias("left"), pick("r", "right").alias("right"))


_XML = "concat('<VRTDataset><SourceFilename relativeToVRT=\"1\">tiles/', p_partkey, '.tif</SourceFilename><SourceFilename relativeToVRT=\"0\">https://h.example/', p_size, '.tif</SourceFilename></VRTDataset>')"


@query("""SELECT p_partkey AS id, k AS n, CASE k WHEN 0 THEN concat('tiles/', p_partkey, '.tif') ELSE concat('https://h.example/', p_size, '.tif') END AS source,
                 concat('/vsicurl/', CASE k WHEN 0 THEN concat('https://s.example/a/tiles/', p_partkey, '.tif') ELSE concat('https://h.example/', p_size, '.tif') END) AS url
          FROM part, (SELECT unnest([0, 1]) AS k)""")
def vrt_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{_XML} as xml")
    return catalog.source_urls(rows, F.lit("https://s.example/a/mosaic.vrt")).select("id", "n", "source", "url")


_FILES = "SELECT p_partkey::VARCHAR AS path, 1000 * p_size AS width, 5e0 AS l, 5e0 + p_size / 10e0 AS r, CASE p_size % 4 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 2 ELSE 1 END AS factor FROM part"


@query(f"""SELECT path, coalesce(min(z), 0)::BIGINT AS level FROM (SELECT path, CASE WHEN ceil(least(180e0 / 2 ** z, r - l) * (width / (r - l)) / (256 * factor)) <= 4 THEN z END AS z
           FROM ({_FILES}), (SELECT unnest(range(0, 24)) AS z)) GROUP BY path""")
def safe_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest zoom that needs few source tiles; some files have no overviews."""
    return catalog.safe_level(_files(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as path",
        "1000 * p_size as width",
        "5.0D as left",
        "5.0D + p_size / 10.0D as right",
        "case p_size % 4 when 0 then array(2, 4, 8, 16) when 1 then array(8, 2) when 2 then array(2) else cast(array() as array<int>) end as overviews",
    )


@query(f"SELECT path, factor FROM ({_FILES})")
def overview_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", catalog.overview_factor(F.col("overviews")).alias("factor"))


@query(f"""SELECT z, x, y, f.path FROM {SQL_TILES} t JOIN (SELECT *, 45e0 AS b, 45e0 + p AS t FROM (SELECT f.*, p_size / 10e0 AS p FROM ({_FILES}) f JOIN part ON p_partkey::VARCHAR = f.path)) f
           ON NOT (t."left" > f.r OR t."right" < f.l OR t.bottom > f.t OR t.top < f.b)
           JOIN (SELECT path, coalesce(min(z2), 0) AS level FROM (SELECT path, CASE WHEN ceil(least(180e0 / 2 ** z2, r - l) * (width / (r - l)) / (256 * factor)) <= 4 THEN z2 END AS z2
           FROM ({_FILES}), (SELECT unnest(range(0, 24)) AS z2)) GROUP BY path) s ON s.path = f.path WHERE z >= level""")
def unsafe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each tile meets and may read: from a file's safe level on."""
    files = _files(spark, sf_dir).withColumns({"ordinal": F.col("path").cast("long"), "bottom": F.lit(45.0), "top": F.expr("45.0D + (right - 5.0D)")})
    pairs = catalog.prune(inputs.tiles(spark, sf_dir), files.select("ordinal", *catalog.BOX))
    levels = catalog.safe_level(files).withColumn("ordinal", F.col("path").cast("long"))
    return pairs.join(levels, "ordinal").where(catalog.safe_to_read(F.col("z"), F.col("level"), F.lit(False))).select("z", "x", "y", "path")


_LOCAL = "concat('<VRT><SourceFilename relativeToVRT=\"1\">../up/', p_size, '.tif</SourceFilename><SourceFilename>./', p_brand, '.tif</SourceFilename><SourceFilename>/abs/x.tif</SourceFilename><SourceFilename>https://s.example/y.tif</SourceFilename></VRT>')"


@query("""SELECT p_partkey AS id, n::INTEGER AS n, CASE n WHEN 0 THEN concat('data/up/', p_size, '.tif') WHEN 1 THEN concat('data/vrt/', p_brand, '.tif')
           WHEN 2 THEN '/abs/x.tif' ELSE '/vsicurl/https://s.example/y.tif' END AS url FROM part, (SELECT unnest(range(0, 4)) AS n)""")
def vrt_local_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of local VRT documents: no prefix but for remote ones, dots resolved."""
    rows = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{_LOCAL} as xml")
    return catalog.source_urls(rows, F.lit("data/vrt/mosaic.vrt")).select("id", "n", "url")


@query(f"""SELECT id, concat_ws('_', coalesce(cog, '-'), coalesce(meshing, 'grid'), z, id % 7, id % 5, coalesce(grid_size::VARCHAR, '-')) AS key,
                  concat('tiles/', lower(hex(encode(coalesce(cog, '-')))), '/', coalesce(meshing, 'grid'), '/', z, '/', id % 7, '/', (2 ** z)::BIGINT - 1 - id % 5, '.terrain') AS path FROM {SQL_OPTIONS}""")
def cache_key_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys with the parameters that change the result, and paths."""
    cog, meshing = F.coalesce("cog", F.lit("-")), F.coalesce("meshing", F.lit("grid"))
    x, y, z = F.expr("id % 7"), F.expr("id % 5"), F.col("z")
    o = inputs.options(spark, sf_dir)
    return o.select("id", params.cache_key(cog, meshing, z, x, y, F.col("grid_size")).alias("key"), params.tile_path("tiles", cog, meshing, z, x, tiling.flip_y(y, z)).alias("path"))


@query("SELECT event_id, concat(s // 86400, 'd ', s // 3600 % 24, 'h ', s // 60 % 60, 'm ', s % 60, 's') AS uptime FROM (SELECT event_id, event_id * 977 + user_id AS s FROM events)")
def uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").select("event_id", params.uptime(F.expr("event_id * 977 + user_id")).alias("uptime"))


@query("""SELECT event_id, CASE WHEN done > 0 THEN concat(lpad((t // 60)::VARCHAR, greatest(2, length((t // 60)::VARCHAR))::INTEGER, '0'), ':', lpad((t % 60)::VARCHAR, 2, '0')) END AS eta FROM (
            SELECT event_id, event_id % 90 AS done, ceil(user_id * 1e0 / nullif(event_id % 90, 0) * (100 - event_id % 90))::BIGINT AS t FROM events)""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and seconds until the rest is done."""
    rows = inputs.table(spark, sf_dir, "events")
    return rows.select("event_id", params.remaining_time(F.expr("event_id % 90"), F.lit(100), F.expr("user_id * 1.0D")).alias("eta"))
