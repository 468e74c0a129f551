"""What a run leaves beside the map: summary, intermediate rasters, kept intermediates, lists of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "array<struct<run:int,phi:double,coh:double,prob:double,n_clusters:bigint>>"


def write_summary(summary: DataFrame, path: str) -> None:
    """The runs (a small table) as one JSON array, a text file in the folder ``path``."""
    row = F.struct(F.col("run").cast("int").alias("run"), "phi", "coh", "prob", F.col("n_clusters").cast("long").alias("n_clusters"))
    summary.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value")).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", SUMMARY)).alias("x")).select("x.*")


def write_intermediates(cells: DataFrame, path: str, nogrow: DataFrame | None = None) -> None:
    """One wide table of depth, no-grow lines, shaking and shaded relief by cell, in place of a raster each."""
    from talus.operators.focal import hillshade

    wide = hillshade(cells.select("r", "c", "z")).select("r", "c", F.col("shade").alias("hillshade")).join(cells.select("r", "c", "depth", "pga"), ["r", "c"])
    if nogrow is not None:
        wide = wide.join(nogrow.select("r", "c").distinct().withColumn("nogrow", F.lit(True)), ["r", "c"], "left")
    wide = wide.withColumn("nogrow", F.coalesce("nogrow", F.lit(False)) if nogrow is not None else F.lit(False))
    wide.select("r", "c", "depth", "nogrow", "pga", "hillshade").write.mode("overwrite").parquet(path)


def kept(spark: SparkSession, folder: str, grid: str, name: str, make) -> DataFrame:
    """The intermediate ``name`` of a grid as written before, or made, written and read again. The mark of a finished write tells them apart."""
    path = f"{folder}/{grid}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, bytes, changed) of the GeoTIFF files in a folder; changed: as text, to the second."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(folder).drop("content")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("changed"))
