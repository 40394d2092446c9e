"""Dataset configurations: JSON files that name datasets and their request parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.sources import files

# The options of a dataset, as the files name them, and our columns.
OPTIONS = {
    "cog": ("cog", "string"),
    "minZoom": ("min_zoom", "bigint"),
    "maxZoom": ("max_zoom", "bigint"),
    "resamplingMethod": ("resampling", "string"),
    "meshingMethod": ("meshing", "string"),
    "skipCache": ("skip_cache", "boolean"),
    "defaultGridSize": ("grid_size", "bigint"),
    "zoomGridSizes": ("grid_sizes", "map<string,double>"),
    "defaultMaxError": ("max_error", "double"),
    "zoomMaxErrors": ("max_errors", "map<string,double>"),
    "extensions": ("extensions", "string"),
    "noData": ("no_data", "double"),
}
_SCHEMA = f"datasets array<struct<name: string, options: struct<{', '.join(f'{k}: {t}' for k, (_, t) in OPTIONS.items())}>>>, _corrupt string"


def write(rows: DataFrame, root: str) -> None:
    """Write datasets (file, ordinal, name and any of our option columns) as ``<file>.json`` under the root."""
    known = [(k, c) for k, (c, _) in OPTIONS.items() if c in rows.columns]
    options = F.struct(*(F.col(c).alias(k) for k, c in known))
    by_ordinal = lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0)
    held = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", options.alias("options"))), by_ordinal).alias("d"))
    doc = F.to_json(F.struct(F.expr("transform(d, e -> struct(e.name as name, e.options as options))").alias("datasets")))
    files.write(held.select(F.concat("file", F.lit(".json")).alias("name"), doc.cast("binary").alias("data")), root)


def _problem() -> Column:
    return F.when(F.col("_corrupt").isNotNull(), F.lit("no JSON")).when(F.col("datasets").isNull(), F.lit("no datasets"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, name, the options' columns (maps as JSON text) and ``problem`` of the datasets in the files under a path.

    A dataset without a name ends its file: those before it stay. Of equal names
    in a file the last one stays. A file that is no JSON, or has no datasets,
    gives one row that says so.
    """
    docs = spark.read.schema(_SCHEMA).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    docs = docs.select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^./]*$", 1).alias("file"), "datasets", "_corrupt").withColumn("problem", _problem())
    columns = [(F.to_json(f"d.options.{k}") if t.startswith("map") else F.col(f"d.options.{k}")).alias(c) for k, (c, t) in OPTIONS.items()]
    good = docs.where("problem is null").select("file", F.posexplode("datasets").alias("ordinal", "d")).select("file", "ordinal", F.col("d.name").alias("name"), *columns)
    unnamed = good.where("name is null or name = ''").groupBy("file").agg(F.min("ordinal").alias("_end"))
    good = good.join(unnamed, "file", "left").where("_end is null or ordinal < _end").drop("_end")
    last = F.row_number().over(Window.partitionBy("file", "name").orderBy(F.col("ordinal").desc()))
    good = good.withColumn("_last", last).where("_last = 1").drop("_last").withColumn("problem", F.lit(None).cast("string"))
    return good.unionByName(docs.where("problem is not null").select("file", "problem"), allowMissingColumns=True)
