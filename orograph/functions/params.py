"""Request parameters: defaults, per-zoom settings, extensions, URLs, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a parameter is when nobody sets it.
DEFAULTS = {
    "cog": "./data/default.tif",
    "minZoom": 1,
    "maxZoom": 18,
    "meshingMethod": "grid",
    "noData": 0,
    "skipCache": False,
    "defaultGridSize": 18,
    "defaultMaxError": 4,
}
ZOOM_GRID_SIZES = '{"15":25,"16":25,"17":30,"18":35,"19":35,"20":35,"21":35,"22":35}'
ZOOM_MAX_ERRORS = '{"15":8,"16":5,"17":3,"18":2,"19":1,"20":0.5,"21":0.3,"22":0.1}'
MESHERS = ("grid", "martini", "delatin")
EXTENSIONS = ("octvertexnormals", "watermask", "metadata")
RESAMPLING = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "gauss", "rms")


def with_default(value: Column, name: str) -> Column:
    return F.coalesce(value, F.lit(DEFAULTS[name]))


def mesher(name: Column) -> Column:
    """An unknown method counts as the default one."""
    return F.when(name.isin(*MESHERS), name).otherwise(F.lit(DEFAULTS["meshingMethod"]))


def per_zoom(z: Column, settings: Column, default: Column, built_in: str, last: float) -> Column:
    """The setting for a zoom: from the map, else the default, else ``last``.

    The built-in map holds only where neither a map nor a default is given; a
    map that can't be read counts as empty.
    """
    text = F.when(settings.isNull() & default.isNull(), F.lit(built_in)).otherwise(settings)
    found = F.try_element_at(F.from_json(text, "map<string,double>"), z.cast("string"))
    return F.coalesce(found, default.cast("double"), F.lit(float(last)))


def grid_size(z: Column, settings: Column, default: Column) -> Column:
    return per_zoom(z, settings, default, ZOOM_GRID_SIZES, DEFAULTS["defaultGridSize"]).cast("long")


def max_error(z: Column, settings: Column, default: Column) -> Column:
    return per_zoom(z, settings, default, ZOOM_MAX_ERRORS, DEFAULTS["defaultMaxError"])


def extensions(accept: Column, parameter: Column) -> Column:
    """Known extensions asked for in an Accept header or a parameter, sorted; both may hold several joined by '-'."""
    header = F.regexp_extract(F.coalesce(accept, F.lit("")), r"extensions=([A-Za-z\-]+)", 1)
    asked = F.array_union(F.split(header, "-"), F.split(F.coalesce(parameter, F.lit("")), "-"))
    return F.array_sort(F.array_intersect(asked, F.array(*map(F.lit, EXTENSIONS))))


def query_url(base: Column, **values: Column) -> Column:
    """The base URL with the values that aren't null, in their order."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in values.items()]
    tail = F.concat_ws("&", *parts)
    mark = F.when(F.instr(base, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when(tail == "", base).otherwise(F.concat(base, mark, tail))


def dataset_type(path: Column) -> Column:
    end = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.when(end.isin(".ctod", ".json"), F.lit("mosaic")).when(end == ".vrt", F.lit("vrt")).otherwise(F.lit("cog"))


def cache_key(cog: Column, meshing: Column, z: Column, x: Column, y: Column, *more: Column) -> Column:
    """One key for each different result: ``more`` are the other parameters that change it."""
    return F.concat_ws("_", cog, meshing, z.cast("string"), x.cast("string"), y.cast("string"), *(F.coalesce(m.cast("string"), F.lit("-")) for m in more))


def tile_path(root: str, cog: Column, meshing: Column, z: Column, x: Column, y_south: Column) -> Column:
    folder = F.lower(F.hex(F.encode(cog, "UTF-8")))
    return F.concat_ws("/", F.lit(root), folder, meshing, z.cast("string"), x.cast("string"), F.concat(y_south.cast("string"), F.lit(".terrain")))


def uptime(seconds: Column) -> Column:
    """days, hours, minutes and seconds as text."""
    s = seconds.cast("long")
    whole = lambda n: F.floor(s / n)
    return F.concat(whole(86400), F.lit("d "), whole(3600) % 24, F.lit("h "), whole(60) % 60, F.lit("m "), s % 60, F.lit("s"))


def remaining_time(done: Column, total: Column, elapsed: Column) -> Column:
    """mm:ss until the rest is done at the pace so far; null before anything is done."""
    left = F.ceil(elapsed / F.when(done > 0, done) * (total - done)).cast("long")
    minutes = F.floor(left / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((left % 60).cast("string"), 2, "0"))
