"""Polygons of label grids: parts, outlines as well-known text and GeoJSON, clipping by masks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.labels import components

Ring = list[tuple[int, int]]


def rings(cells: set[tuple[int, int]]) -> list[Ring]:
    """Closed outlines of 4-connected cells as (x, y) corners, turning where edges turn; outer counter to holes in sense."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for beyond, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if beyond not in cells:
                ahead.setdefault(a, []).append(b)
    out = []
    while ahead:
        start = min(ahead)
        path, came = [start], None
        while True:
            at = path[-1]
            choices = ahead[at]
            if len(choices) > 1 and came:  # two cells meet at a corner: keep to the own cell by turning right
                dx, dy = at[0] - came[0], at[1] - came[1]
                choices.sort(key=lambda p: (p[0] - at[0], p[1] - at[1]) != (-dy, dx))
            to = choices.pop(0)
            if not choices:
                del ahead[at]
            came = at
            if to == start:
                break
            path.append(to)
        n = len(path)
        out.append([p for i, p in enumerate(path) if (path[i - 1][0] - p[0]) * (path[(i + 1) % n][1] - p[1]) != (path[i - 1][1] - p[1]) * (path[(i + 1) % n][0] - p[0])])
    return sorted(out, key=lambda ring: min(ring))


def polygonize(df: DataFrame, unit: str = "unit", cell: float = 10.0, least: int = 1) -> DataFrame:
    """(unit, part, n_cells, area_m2, root): one row per 4-connected part, parts numbered row by row."""
    found = components(df.withColumn("_on", F.coalesce(F.col(unit) > 0, F.lit(False))), "_on", 4, same=unit)
    parts = found.join(df.select("r", "c", F.col(unit).alias("_unit")), ["r", "c"]).groupBy("_unit", "root").agg(F.count("*").alias("n_cells"), F.min(F.struct("r", "c")).alias("first"))
    parts = parts.where(F.col("n_cells") >= least)
    order = Window.partitionBy("_unit").orderBy("first")
    return parts.select(F.col("_unit").alias(unit), F.row_number().over(order).alias("part"), "n_cells", (F.col("n_cells") * (cell * cell)).alias("area_m2"), "root")


def outlines(df: DataFrame, unit: str = "unit", cell: float = 10.0, least: int = 1) -> DataFrame:
    """polygonize() with geometry (well-known text; x right, y down in metres, outer ring first). A part is one task's group."""
    parts = polygonize(df, unit, cell, least)
    found = components(df.withColumn("_on", F.coalesce(F.col(unit) > 0, F.lit(False))), "_on", 4, same=unit)

    def shape(key, cells):
        made = rings(set(zip(cells.column("r").to_pylist(), cells.column("c").to_pylist(), strict=True)))
        text = ", ".join("(" + ", ".join(f"{x * cell:g} {y * cell:g}" for x, y in [*ring, ring[0]]) + ")" for ring in made)
        return pa.table({"root": pa.array([key[0].as_py()], pa.int64()), "geometry": [f"POLYGON ({text})"]})

    return parts.join(found.groupBy("root").applyInArrow(shape, "root long, geometry string"), "root").drop("root")


def union_by_unit(parts: DataFrame, unit: str = "unit") -> DataFrame:
    """One row per unit of outlines(): its parts' cells and areas added, geometry a multipolygon."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "geometry"))), lambda x: F.regexp_replace(x["geometry"], "^POLYGON ", "")), ", ")
    return parts.groupBy(unit).agg(F.sum("n_cells").alias("n_cells"), F.sum("area_m2").alias("area_m2"), F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")")).alias("geometry"))


def clip_by_mask(df: DataFrame, mask: DataFrame, invert: bool = False, unit: str = "unit") -> DataFrame:
    """df with unit 0 outside the mask's cells (r, c), or inside them."""
    inside = mask.select("r", "c").distinct().withColumn("_in", F.lit(True))
    keep = F.col("_in").isNull() if invert else F.col("_in").isNotNull()
    return df.join(inside, ["r", "c"], "left").withColumn(unit, F.when(keep, F.col(unit)).otherwise(0)).drop("_in")


def valid_polygons(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Features whose geometry is a polygon or multipolygon and not empty."""
    return features.where(F.col(geometry).rlike(r"^(MULTI)?POLYGON \(") & ~F.col(geometry).rlike("EMPTY"))


def _geojson(wkt: str) -> dict:
    kind = "MultiPolygon" if wkt.startswith("MULTI") else "Polygon"
    body = re.sub(r"(-?[\d.e+-]+) (-?[\d.e+-]+)", r"[\1,\2]", wkt[wkt.index("(") :])
    return {"type": kind, "coordinates": json.loads(body.replace("(", "[").replace(")", "]"))}


def to_geojson(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(feature): a GeoJSON feature a row, properties from the other columns."""
    names = [c for c in features.columns if c != geometry]
    rows = features.select(F.to_json(F.struct(*names)).alias("properties"), geometry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [json.dumps({"type": "Feature", "properties": json.loads(p), "geometry": _geojson(g)}) for p, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["feature"])

    return rows.mapInArrow(run, "feature string")


def write_vector(features: DataFrame, path: str, geometry: str = "geometry") -> None:
    """Write features by the path's extension: .geojson or .json as one collection's lines in parts, .csv and .parquet with the geometry as WKT.

    Shapefiles and GeoPackages need a database or three files a layer and are refused, as is any other extension.
    """
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("geojson", "json"):
        to_geojson(features, geometry).write.mode("overwrite").text(path)
    elif kind == "csv":
        features.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "parquet":
        features.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no vector format for {path!r}: use .geojson, .json, .csv or .parquet")


def read_geojson(spark, path: str, properties: str) -> DataFrame:
    """Features as written above: columns of ``properties`` (a schema) and geometry, its GeoJSON as text."""
    rows = spark.read.text(path).select(F.from_json("value", f"type string, properties struct<{properties}>, geometry string").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry").alias("geometry"))
