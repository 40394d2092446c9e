"""Pixels: nodata, mosaic merging and resampling, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_nodata(h: Column, nodata: Column | None, value: float) -> Column:
    """The value to use where a pixel is the file's nodata; a file without one keeps its pixels."""
    if nodata is None:
        return h
    return F.when(h == nodata, F.lit(float(value))).otherwise(h)


def first_valid(pixels: DataFrame, key: Sequence[str], valid: Column) -> DataFrame:
    """For each pixel the height of the first dataset (by ordinal) that has one."""
    return pixels.where(valid).groupBy(*key).agg(F.min_by("h", "ordinal").alias("h"), F.min("ordinal").alias("ordinal"))


def valid_extent(pixels: DataFrame, key: Sequence[str], valid: Column) -> DataFrame:
    """Smallest and largest valid row and column, combined block by block before they are shuffled."""
    return pixels.where(valid).groupBy(*key).agg(F.min("col").alias("min_col"), F.min("row").alias("min_row"), F.max("col").alias("max_col"), F.max("row").alias("max_row"))


def affine(col: Column, row: Column, left: Column, top: Column, pixel: Column) -> tuple[Column, Column]:
    """Place of a pixel's corner."""
    return left + col * pixel, top - row * pixel


def block_resample(pixels: DataFrame, key: Sequence[str], factor: int, method: str, valid: Column | None = None) -> DataFrame:
    """Each output cell from the factor x factor cells that it covers: nearest, average, rms or mode.

    Cells without data carry no weight. Ties of the mode go to the lowest value.
    """
    rows = (pixels if valid is None else pixels.where(valid)).withColumns({"out_row": F.floor(F.col("row") / factor).cast("long"), "out_col": F.floor(F.col("col") / factor).cast("long")})
    keys = [*key, "out_row", "out_col"]
    if method == "nearest":
        middle = rows.where((F.col("row") % factor == factor // 2) & (F.col("col") % factor == factor // 2))
        return middle.select(*keys, "h")
    if method == "average":
        return rows.groupBy(*keys).agg(F.avg("h").alias("h"))
    if method == "rms":
        return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("h"))
    if method == "mode":
        counts = rows.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("h")).alias("_h"))).alias("_m")).select(*keys, (-F.col("_m._h")).alias("h"))
    if method == "gauss":
        weight = F.exp(-(F.pow(F.col("row") % factor - (factor - 1) / 2, 2) + F.pow(F.col("col") % factor - (factor - 1) / 2, 2)) / (2.0 * (factor / 2) ** 2))
        return rows.groupBy(*keys).agg((F.sum(F.col("h") * weight) / F.sum(weight)).alias("h"))
    raise ValueError(f"unknown method {method!r}")


def kernel(method: str, d: Column) -> tuple[int, Column]:
    """(taps on each side, weight at distance d) of an interpolating kernel."""
    d = F.abs(d)
    if method == "bilinear":
        return 1, F.greatest(F.lit(0.0), F.lit(1.0) - d)
    if method == "cubic":  # Catmull-Rom
        near = 1.5 * d * d * d - 2.5 * d * d + 1.0
        return 2, F.when(d < 1, near).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4.0 * d + 2.0).otherwise(0.0)
    if method == "cubic_spline":  # uniform B-spline
        near = (4.0 - 6.0 * d * d + 3.0 * d * d * d) / 6.0
        return 2, F.when(d < 1, near).when(d < 2, (2.0 - d) * (2.0 - d) * (2.0 - d) / 6.0).otherwise(0.0)
    if method == "lanczos":
        x = d * 3.141592653589793
        return 3, F.when(d == 0, 1.0).when(d < 3, F.sin(x) / x * (F.sin(x / 3) / (x / 3))).otherwise(0.0)
    raise ValueError(f"unknown method {method!r}")


def interpolate(points: DataFrame, pixels: DataFrame, key: Sequence[str], method: str) -> DataFrame:
    """Heights at ``points`` (key, pid, px, py in pixel centres) from the pixels around them.

    Each point asks for its taps by row and column; taps that are missing carry no weight.
    """
    taps, _ = kernel(method, F.lit(0.0))
    offsets = F.sequence(F.lit(1 - taps), F.lit(taps))
    asked = points.withColumn("_r", F.explode(offsets)).withColumn("_c", F.explode(offsets))
    asked = asked.withColumns({"row": F.floor("py") + F.col("_r"), "col": F.floor("px") + F.col("_c")})
    weight = kernel(method, F.col("py") - F.col("row"))[1] * kernel(method, F.col("px") - F.col("col"))[1]
    met = asked.withColumn("_w", weight).where("_w <> 0").join(pixels.hint("merge"), [*key, "row", "col"])  # pixels are too many to be sent whole
    # taps come from several tasks; they are added by row and column, so the last digits don't hang on how they met
    taps = F.sort_array(F.collect_list(F.struct("row", "col", (F.col("_w") * F.col("h")).alias("h"), F.col("_w").alias("w"))))
    total = lambda c: F.aggregate("_t", F.lit(0.0), lambda sum, t: sum + t[c])
    return met.groupBy(*key, "pid").agg(taps.alias("_t")).select(*key, "pid", (total("h") / total("w")).alias("h"))
