"""Dataset catalogs, mosaics, availability and seeding ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orograph.functions import tiling

BOX = ("left", "bottom", "right", "top")


def box(df_or_prefix: DataFrame | str, prefix: str = "") -> tuple[Column, Column, Column, Column]:
    if isinstance(df_or_prefix, str):
        return tuple(F.col(f"{df_or_prefix}.{c}") for c in BOX)
    return tuple(df_or_prefix[f"{prefix}{c}"] for c in BOX)


#: Finest level of the cells that boxes are covered with.
FINEST = 24
#: How far a box reaches over its edges, so that boxes that only touch share a cell.
_TOUCH = 1e-9
_CELL = ["_l", "_cx", "_cy"]


def _own_level() -> Column:
    """The finest level whose cells are at least as wide as the box, which then meets two on a side."""
    size = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom")) + 4 * _TOUCH
    return F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(180.0) / F.greatest(size, F.lit(1e-6)))))).cast("int")


def _whole() -> Column:
    """Whether a box has all sides, and they are in order."""
    return (F.col("left") <= F.col("right")) & (F.col("bottom") <= F.col("top"))


def _place(lon: Column, lat: Column, level: Column) -> tuple[Column, Column]:
    """The cell of a point. Cells of one level lie in cells of the level above, exactly: their widths differ by a power of two."""
    w = F.lit(180.0) / F.pow(F.lit(2.0), level)
    return F.floor((lon + 180.0) / w).cast("long"), F.floor((F.lit(90.0) - lat) / w).cast("long")


def _levelled(boxes: DataFrame) -> DataFrame:
    """Boxes (without nulls) with their own level ``_own`` and the first and last cell there on each side."""
    rows = boxes.where(_whole()).withColumn("_own", _own_level())
    x0, y0 = _place(F.col("left") - _TOUCH, F.col("top") + _TOUCH, F.col("_own"))
    x1, y1 = _place(F.col("right") + _TOUCH, F.col("bottom") - _TOUCH, F.col("_own"))
    return rows.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})


def _cells(rows: DataFrame) -> DataFrame:
    """A row for each cell of level ``_l`` (its own or a coarser one) that the box meets: four of its own level, if it touches no more and is not as wide as the world."""
    line = lambda c: F.explode(F.sequence(F.expr(f"shiftright(_{c}0, _own - _l)"), F.expr(f"shiftright(_{c}1, _own - _l)")))
    return rows.withColumn("_cx", line("x")).withColumn("_cy", line("y")).drop("_x0", "_x1", "_y0", "_y1")


def cover(boxes: DataFrame) -> DataFrame:
    """The cells of each box at its own level."""
    return _cells(_levelled(boxes).withColumn("_l", F.col("_own")))


def _around(boxes: DataFrame, levels: Sequence[int], *, itself: bool) -> DataFrame:
    """The cells of each box at those of the given levels that are coarser than its own, or the same."""
    above = F.filter(F.array(*map(F.lit, sorted(levels))), lambda v: (v <= F.col("_own")) if itself else (v < F.col("_own")))
    return _cells(_levelled(boxes).withColumn("_l", F.explode(above)))


def _spread(fine: DataFrame, coarse: DataFrame, hot: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Add ``_salt``: cells with more than ``hot`` fine boxes are dealt out, and their coarse boxes repeated for each part.

    At most ``most`` cells are, those with the most boxes; their list is broadcast.
    """
    spark = fine.sparkSession
    counts = fine.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    found = counts.orderBy(F.desc("_n")).limit(most).collect()
    if not found:
        return fine.withColumn("_salt", F.lit(0)), coarse.withColumn("_salt", F.lit(0))
    rows = [(r["_l"], r["_cx"], r["_cy"], -(-r["_n"] // hot)) for r in found]
    parts = F.broadcast(spark.createDataFrame(rows, "_l int, _cx long, _cy long, _parts int"))
    salt = F.pmod(F.xxhash64(*BOX), F.coalesce("_parts", F.lit(1))).cast("int")
    fine = fine.join(parts, _CELL, "left").withColumn("_salt", salt).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return fine, coarse.join(parts, _CELL, "left").withColumn("_salt", every).drop("_parts")


def prune(tiles: DataFrame, extents: DataFrame, *, small: int = 64, hot: int = 100_000, most_hot: int = 10_000) -> DataFrame:
    """All pairs of a tile and an extent whose boxes meet: z, x, y, ordinal.

    ``extents`` has ``ordinal`` and a box, ``tiles`` z, x, y and a box; rows
    repeated in either give repeated pairs, boxes with nulls or sides in the wrong order none. A catalog of
    at most ``small`` rows, which is counted, is broadcast and compared
    directly. Otherwise each box is covered by a few cells of a level of its
    own size, and the finer box of a pair looks for the coarser one among the
    cells around its own; so rows grow with boxes and pairs, whatever sizes are
    mixed. A pair is made in one cell: that of its common box's upper left corner.
    """
    meets = tiling.intersects(box("t"), box("e"))
    seen = extents.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(_whole(), _own_level())).alias("levels")).first()
    if seen.n <= small:
        pairs = tiles.where(_whole()).alias("t").join(F.broadcast(extents.where(_whole()).alias("e")), meets)
        return pairs.select("t.z", "t.x", "t.y", "e.ordinal")
    sides = {"t": tiles.select("z", "x", "y", *BOX), "e": extents.select("ordinal", *BOX)}
    levels = {"e": seen.levels, "t": [r[0] for r in _levelled(sides["t"]).select("_own").distinct().collect()]}
    out = None
    for fine, coarse, itself in (("t", "e", True), ("e", "t", False)):
        if not levels[coarse]:
            continue
        f, c = _spread(_around(sides[fine], levels[coarse], itself=itself), cover(sides[coarse]), hot, most_hot)
        f, c = f.alias(fine), c.alias(coarse)
        x, y = _place(F.greatest("t.left", "e.left"), F.least("t.top", "e.top"), F.col(f"{coarse}._l"))
        here = (F.col(f"{coarse}._cx") == x) & (F.col(f"{coarse}._cy") == y)
        same = [F.col(f"{fine}.{k}") == F.col(f"{coarse}.{k}") for k in (*_CELL, "_salt")]
        pairs = f.join(c, [*same, here & meets]).select("t.z", "t.x", "t.y", "e.ordinal")
        out = pairs if out is None else out.unionByName(pairs)
    return tiles.join(extents, F.lit(False)).select("z", "x", "y", "ordinal") if out is None else out


def fan_in_guard(pairs: DataFrame, *, most: int = 10, unsafe: bool = False) -> DataFrame:
    """Drop the tiles that need more than ``most`` datasets, unless ``unsafe``."""
    if unsafe:
        return pairs
    counted = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("z", "x", "y")))
    return counted.where(F.col("n") <= most)


def extent(extents: DataFrame, *by: str) -> DataFrame:
    """The box around all boxes, from the empty box (180, 90, -180, -90)."""
    low, high = F.lit(180.0), F.lit(-180.0)
    return extents.groupBy(*by).agg(
        F.least(low, F.min("left")).alias("left"),
        F.least(F.lit(90.0), F.min("bottom")).alias("bottom"),
        F.greatest(high, F.max("right")).alias("right"),
        F.greatest(F.lit(-90.0), F.max("top")).alias("top"),
    )


def availability(boxes: DataFrame, key: Sequence[str], *, max_zoom: int, first: int = 1) -> DataFrame:
    """``key``, z, start_x, start_y, end_x, end_y for each zoom; zoom 0 always has both tiles."""
    zooms = boxes.withColumn("z", F.explode(F.sequence(F.lit(first), F.lit(max_zoom))))
    found = tiling.tile_range(F.col("z"), *(F.col(c) for c in BOX))
    whole = {"start_x": 0, "start_y": 0, "end_x": 1, "end_y": 0}
    return zooms.select(*key, "z", *(F.when(F.col("z") == 0, F.lit(whole[k])).otherwise(v).cast("long").alias(k) for k, v in found.items()))


def layer_json(ranges: DataFrame, key: Sequence[str], *, levels: int | None = None) -> DataFrame:
    """``key`` and ``available``: a JSON list by zoom of lists of ranges; ``levels`` keeps the first ones."""
    item = F.struct(F.col("start_x").alias("startX"), F.col("start_y").alias("startY"), F.col("end_x").alias("endX"), F.col("end_y").alias("endY"))
    rows = ranges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("z", F.array(item).alias("r")))).alias("s"))
    levels_of = F.expr("transform(s, e -> e.r)")
    return rows.select(*key, F.to_json(levels_of if levels is None else F.slice(levels_of, 1, levels)).alias("available"))


def layer_documents(ranges: DataFrame, boxes: DataFrame, key: str, *, query: Column, max_zoom: int) -> DataFrame:
    """``key`` and ``document``: the whole layer description of each dataset as JSON.

    ``boxes`` has the key and a box; ``query`` is the parameters' URL part, such
    as ``&cog=a`` (empty or null: none); ``available`` goes from zoom 0 to ``max_zoom``.
    """
    available = layer_json(ranges, [key], levels=max_zoom + 1).select(key, F.from_json("available", "array<array<struct<startX: bigint, startY: bigint, endX: bigint, endY: bigint>>>").alias("available"))
    url = F.concat(F.lit("{z}/{x}/{y}.terrain?v={version}"), F.coalesce(query, F.lit("")))
    # Fixed values of the format; the box of the world is what viewers expect here.
    fixed = {"tilejson": "2.1.0", "name": "orograph", "description": "Terrain tiles", "version": "1.1.0", "format": "quantized-mesh-1.0", "attribution": "", "schema": "tms"}
    parts = [F.lit(v).alias(k) for k, v in fixed.items()]
    parts += [F.array(F.lit("octvertexnormals")).alias("extensions"), F.array(url).alias("tiles"), F.lit("EPSG:4326").alias("projection")]
    parts += [F.array(*map(F.lit, (0.0, -90.0, 180.0, 90.0))).alias("bounds"), F.array(*BOX).alias("cogBounds"), F.col("available")]
    return boxes.join(available, key).select(key, F.to_json(F.struct(*parts)).alias("document"))


def seed_tiles(ranges: DataFrame) -> DataFrame:
    """Every tile of the ranges with its Morton code; x, y with y from the south."""
    rows = ranges.withColumn("x", F.explode(F.sequence("start_x", "end_x"))).withColumn("y", F.explode(F.sequence("start_y", "end_y")))
    return rows.withColumn("code", tiling.morton(F.col("x"), F.col("y"))).drop("start_x", "start_y", "end_x", "end_y")


def overview_factor(overviews: Column) -> Column:
    """The coarsest overview; a file without any counts as 1."""
    return F.coalesce(F.array_max(overviews), F.lit(1))


def safe_to_read(z: Column, level: Column, unsafe: Column) -> Column:
    return (z >= level) | unsafe


def ring_box(ring: Column) -> dict[str, Column]:
    """The box of a ring of structs (x, y)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"left": F.array_min(xs), "bottom": F.array_min(ys), "right": F.array_max(xs), "top": F.array_max(ys)}


def number(rows: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_n``, 0-based in ``order`` within ``scope``.

    Rows are counted by buckets of the scope's range first, so that a scope is
    numbered by many tasks: each bucket starts where the ones before it end.
    """
    first = order[0]
    ends = rows.groupBy(*scope).agg(F.min(first).alias("_lo"), F.max(first).alias("_hi"))
    width = F.greatest(F.lit(1), F.expr("(_hi - _lo) div 256 + 1"))
    placed = rows.join(ends, list(scope)).withColumn("_bucket", F.floor((F.col(first) - F.col("_lo")) / width)).drop("_lo", "_hi")
    counts = placed.groupBy(*scope, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*scope).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 257 rows at most
    starts = counts.select(*scope, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*scope, "_bucket").orderBy(*order)) - 1
    numbered = placed.withColumn("_local", local).join(starts, [*scope, "_bucket"])
    return numbered.withColumn("_n", F.col("_local") + F.col("_start")).drop("_bucket", "_local", "_start")


def safe_level(files: DataFrame, *, tile_size: int = 256, budget: int = 4) -> DataFrame:
    """path, level: the lowest zoom at which a tile needs few enough source tiles; 0 if none does.

    ``files`` has path, width (pixels), left, right and overviews (may be empty).
    """
    degrees = F.col("right") - F.col("left")
    factor = overview_factor(F.col("overviews"))
    zooms = files.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(23))))
    needed = F.ceil(F.least(tiling.tile_width(F.col("z")), degrees) * (F.col("width") / degrees) / (tile_size * factor))
    fits = zooms.withColumn("_fits", F.when(needed <= budget, F.col("z")))
    return fits.groupBy("path").agg(F.coalesce(F.min("_fits"), F.lit(0)).cast("long").alias("level"))


def source_urls(vrt: DataFrame, base: Column) -> DataFrame:
    """The sources of VRT documents: relative ones are joined to the folder of the VRT's own place, ``.`` and ``..`` resolved.

    Sources that start with a slash, or are URLs, stay; only http(s) sources get the prefix for remote reading.
    A document that is null or has no source gives no row.
    """
    folder = F.regexp_replace(base, r"[^/]*$", "")
    sources = F.regexp_extract_all("xml", F.lit(r"<SourceFilename[^>]*>([^<]*)</SourceFilename>"), 1)
    rows = vrt.withColumn("_folder", folder).select("*", F.posexplode(sources).alias("n", "source"))
    full = F.when(F.col("source").rlike("^([a-z]+:/)?/"), F.col("source")).otherwise(F.concat("_folder", "source"))
    head = F.regexp_extract(full, r"^([a-z]+://[^/]*)?", 0)
    steps = F.split(F.expr("substr(_full, length(_head) + 1)"), "/")
    # each step leaves the path as it is, shortens it by one, or goes on
    path = F.aggregate(steps, F.array().cast("array<string>"), lambda p, s: F.when(s == ".", p).when((s == "..") & (F.size(p) > 1), F.slice(p, 1, F.size(p) - 1)).otherwise(F.concat(p, F.array(s))))
    rows = rows.withColumn("_full", full).withColumn("_head", head).withColumn("_path", F.concat("_head", F.array_join(path, "/")))
    prefix = F.when(F.col("_head").rlike("^https?:"), F.lit("/vsicurl/")).otherwise(F.lit(""))
    return rows.withColumn("url", F.concat(prefix, "_path")).drop("_folder", "_full", "_head", "_path")


def last_wins(options: DataFrame, name: str, order: str) -> DataFrame:
    """For each name the row that comes last."""
    rest = [c for c in options.columns if c != name]
    return options.groupBy(name).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_m")).select(name, *(F.col(f"_m.{c}").alias(c) for c in rest))
