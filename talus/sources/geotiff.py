"""GeoTIFF files as cell tables, and cell tables as GeoTIFF files.

Spark reads the files, so that they may lie in any store it knows. Their blocks travel packed to all tasks, which unpack
them into cells. Several files of one grid (tiles) are placed by their corners.
A grid is written in files of ``TILE`` x ``TILE`` cells: one file at the path itself if that holds it all, else a folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.grid import extent
from talus.plans.checkpoints import cut
from talus.sources.tiff import Block, GeoRef, Tiff, encode, unpack

TILE = 2048
_BLOCKS = "path string, row int, column int, rows int, columns int, data binary, kind string, packing int, predictor int, m int, n int, dx double, dy double, x double, y double, nodata double"


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            t = Tiff(content.as_py())
            g = t.georef
            for b in t.blocks():
                row = [path, b.row, b.column, b.rows, b.columns, b.data, t.dtype.str, t.packing, t.predictor, t.rows, t.columns, g.dx, g.dy, g.x, g.y, g.nodata]
                kinds = [pa.string(), *[pa.int32()] * 4, pa.binary(), pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            part = unpack(Block(b["row"], b["column"], b["rows"], b["columns"], b["data"]), np.dtype(b["kind"]), b["packing"], b["predictor"], b["m"], b["n"])
            r, c = np.mgrid[b["r0"] + b["row"] : b["r0"] + b["row"] + part.shape[0], b["c0"] + b["column"] : b["c0"] + b["column"] + part.shape[1]]
            z = part.astype(np.float64).ravel()
            gone = np.isnan(z) if b["nodata"] is None else np.isnan(z) | (z == b["nodata"])
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), pa.array(z, mask=gone)], names=["r", "c", "z"])


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_directories, _BLOCKS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, z) of the file, or of all files in a folder, of one grid; null where the file says no data or NaN. r and c start at the upper left corner of all."""
    blocks = cut(_blocks(spark, path))
    x, y = blocks.agg(F.min("x"), F.max("y")).first()
    if x is None:
        return spark.createDataFrame([], "r int, c int, z double")
    placed = blocks.withColumns({"r0": F.round((F.lit(y) - F.col("y")) / F.col("dy")).cast("int"), "c0": F.round((F.col("x") - F.lit(x)) / F.col("dx")).cast("int")})
    return placed.repartition(blocks.sparkSession.sparkContext.defaultParallelism).mapInArrow(_cells, "r int, c int, z double")


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, z): as ``read``, and without what lies below 0."""
    return read(spark, path).withColumn("z", F.when(F.col("z") >= 0, F.col("z")))


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, unit): a label raster; no data and negative labels are 0."""
    unit = F.col("z").cast("long")
    return read(spark, path).select("r", "c", F.when(unit > 0, unit).otherwise(F.lit(0).cast("long")).alias("unit"))


def georef(spark: SparkSession, path: str) -> GeoRef:
    """Reference of the grid in ``path``: that of its upper left file, without the coordinate system's keys."""
    first = _blocks(spark, path).where("row = 0 and column = 0").orderBy(F.desc("y"), "x").select("dx", "dy", "x", "y", "nodata").first()
    return GeoRef(*first) if first else GeoRef()


def write(df: DataFrame, path: str, column: str = "z", ref: GeoRef | None = None, dtype: str = "float32", tile: int = TILE) -> None:
    """Write ``column`` of (r, c, column); missing cells and nulls are NaN, or the reference's no-data value (0 without one) for integers."""
    ref, spark = ref or GeoRef(), df.sparkSession
    m, n = extent(df)
    kind = np.dtype(dtype)
    empty = np.nan if kind.kind == "f" else ref.nodata or 0

    def made(key, table):  # no type hints: they would choose another form of call
        tr, tc = (int(k.as_py()) for k in key)
        grid = np.full((min(tile, m - tr * tile), min(tile, n - tc * tile)), empty, kind)
        v = table.column("v").to_numpy()
        have = ~np.isnan(v)
        grid[table.column("r").to_numpy()[have] - tr * tile, table.column("c").to_numpy()[have] - tc * tile] = v[have]
        own = GeoRef(ref.dx, ref.dy, ref.x + tc * tile * ref.dx, ref.y - tr * tile * ref.dy, ref.nodata, ref.keys)
        return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "data": pa.array([encode(grid, own)], pa.binary())})

    cells = df.select("r", "c", F.col(column).cast("double").alias("v"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    one = m <= tile and n <= tile
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in cells.groupBy("tr", "tc").applyInArrow(made, "tr int, tc int, data binary").toLocalIterator():  # a file at a time
        at = jvm.org.apache.hadoop.fs.Path(path if one else f"{path}/tile_{f.tr}_{f.tc}.tif")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(f.data))
        out.close()
