"""Stencils of 3 x 3 cells as windows along rows and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.operators.grid import around, cross, extent, ring, shifted, sides

DEGREES = 57.29578
#: Weights of the neighbourhood code, column by column.
WEIGHTS = {"nw": 1, "w": 2, "sw": 4, "n": 8, "": 16, "s": 32, "ne": 64, "e": 128, "se": 256}


def horn(df: DataFrame, z: str = "z", dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """df with dzdx, dzdy, slope (degrees) and aspect (degrees from north, whole): 0 on the outer ring, null beside no data."""
    m, n = extent(df)
    g = {s: F.col(f"{z}_{s}") for s in ("nw", "n", "ne", "w", "e", "sw", "s", "se")}
    edge = ring(m, n) if min(m, n) >= 3 else F.lit(True)
    gx = ((g["ne"] + 2 * g["e"] + g["se"]) - (g["nw"] + 2 * g["w"] + g["sw"])) / (8 * dx)
    gy = ((g["sw"] + 2 * g["s"] + g["se"]) - (g["nw"] + 2 * g["n"] + g["ne"])) / (8 * dy)
    zero = F.lit(0.0)
    out = around(df, z).withColumns({"_x": gx, "_y": gy})
    turn = DEGREES * F.atan2("_y", -F.col("_x"))
    aspect = F.floor(F.when(turn > 90, 450.0 - turn).otherwise(90.0 - turn) + 0.5).cast("double")
    return out.select(
        *df.columns,
        F.when(edge, zero).otherwise(F.col("_x")).alias("dzdx"),
        F.when(edge, zero).otherwise(F.col("_y")).alias("dzdy"),
        F.when(edge, zero).otherwise(F.atan(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))) * DEGREES).alias("slope"),
        F.when(edge, zero).otherwise(aspect).alias("aspect"),
    )


def _central(z: str, before: str, after: str, first: Column, last: Column, step: float) -> Column:
    a, b, x = F.col(f"{z}_{before}"), F.col(f"{z}_{after}"), F.col(z)
    return F.when(first, (b - x) / step).when(last, (x - a) / step).otherwise((b - a) / (2 * step))


def central_gradient(df: DataFrame, z: str = "z", dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """df with gx, gy: central differences, one-sided at the grid's edges."""
    m, n = extent(df)
    out = cross(df, z)
    return out.select(*df.columns, _central(z, "w", "e", F.col("c") == 0, F.col("c") == n - 1, dx).alias("gx"), _central(z, "n", "s", F.col("r") == 0, F.col("r") == m - 1, dy).alias("gy"))


def hillshade(df: DataFrame, z: str = "z", dx: float = 10.0, dy: float = 10.0, azimuth: float = 315.0, altitude: float = 45.0, zfactor: float = 1.0) -> DataFrame:
    """df with shade (0 to 256), null on the outer ring."""
    m, n = extent(df)
    sun, zenith = F.radians(F.lit((450.0 - azimuth) % 360.0)), F.radians(F.lit(90.0 - altitude))
    tilt, face = F.atan(zfactor * F.hypot("gx", "gy")), F.atan2("gx", "gy")
    face = F.when(face < F.pi(), face + F.pi() / 2).otherwise(face)
    face = F.when(face < 0, face + 2 * F.pi()).otherwise(face)
    light = 256.0 * (F.cos(zenith) * F.cos(tilt) + F.sin(zenith) * F.sin(tilt) * F.cos(sun - face))
    return central_gradient(df, z, dx, dy).select(*df.columns, F.when(~ring(m, n), F.when(light < 0, 0.0).otherwise(light)).alias("shade"))


def laplacian(df: DataFrame, z: str = "z", h: float = 10.0) -> DataFrame:
    """df with lap: a quarter of the five-point Laplacian; one-sided second differences at edges, both added up at corners."""
    m, n = extent(df)
    x, two = F.col(z), {s: shifted(z, 2 * a, 2 * b) for s, (a, b) in {"n": (-1, 0), "s": (1, 0), "w": (0, -1), "e": (0, 1)}.items()}
    out = cross(df, z).withColumns({f"_{s}2": e for s, e in two.items()})
    second = lambda s: x - 2 * F.col(f"{z}_{s}") + F.col(f"_{s}2")
    inner = ((F.col(f"{z}_n") + F.col(f"{z}_s") + F.col(f"{z}_w") + F.col(f"{z}_e")) / 4 - x) / (h * h)
    across = F.when(F.col("c") == 0, second("e")).when(F.col("c") == n - 1, second("w")) if n >= 3 else F.lit(None)
    down = F.when(F.col("r") == 0, second("s")).when(F.col("r") == m - 1, second("n")) if m >= 3 else F.lit(None)
    edge_c, edge_r = (F.col("c") == 0) | (F.col("c") == n - 1), (F.col("r") == 0) | (F.col("r") == m - 1)
    if n < 3:
        edge_c = F.lit(False) if m >= 3 else edge_c
    lap = F.when(edge_c & edge_r, (across + down) / (2 * h * h)).when(edge_c, across / (2 * h * h)).when(edge_r, down / (2 * h * h)).otherwise(inner)
    return out.select(*df.columns, lap.alias("lap"))


def erosion(df: DataFrame, z: str = "z") -> DataFrame:
    """df with low: the least value of the 3 x 3 cells, no data left out."""
    return around(df, z).select(*df.columns, F.least(F.col(z), *sides(z)).alias("low"))


def dilation(df: DataFrame, z: str = "z") -> DataFrame:
    """df with high: the greatest value of the 3 x 3 cells, no data left out."""
    return around(df, z).select(*df.columns, F.greatest(F.col(z), *sides(z)).alias("high"))


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def dilate(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df with grown: any of the 3 x 3 cells set."""
    return around(df, mask).select(*df.columns, reduce(lambda a, b: a | b, map(_flag, [F.col(mask), *sides(mask)])).alias("grown"))


def erode(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df with shrunk: all of the 3 x 3 cells set, those outside the grid not being set."""
    return around(df, mask).select(*df.columns, reduce(lambda a, b: a & b, map(_flag, [F.col(mask), *sides(mask)])).alias("shrunk"))


def label_boundary(df: DataFrame, label: str = "label") -> DataFrame:
    """df with edge: a 4-neighbour in the grid has another label."""
    out = cross(df, label)
    return out.select(*df.columns, reduce(lambda a, b: a | b, [_flag(F.col(f"{label}_{s}") != F.col(label)) for s in "nswe"]).alias("edge"))


def code(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df with code: the neighbourhood as a number from 0 to 511, cells outside not set."""
    out = around(df, mask)
    terms = [F.when(_flag(F.col(f"{mask}_{s}" if s else mask)), w).otherwise(0) for s, w in WEIGHTS.items()]
    return out.select(*df.columns, reduce(lambda a, b: a + b, terms).cast("int").alias("code"))
