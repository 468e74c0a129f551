"""Cell tables: dense tables (r, c, attributes), null for no data, r and c from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbour suffixes and offsets (rows down, columns right).
SIDES = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def extent(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) of a grid; (0, 0) if it is empty."""
    m, n = df.agg(F.max("r"), F.max("c")).first()
    return (0, 0) if m is None else (m + 1, n + 1)


def idx(m: int, r: str | Column = "r", c: str | Column = "c") -> Column:
    """Column-major place from 1, the key that orders ties."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return c.cast("long") * m + r + 1


def row_of(m: int, i: str = "idx") -> Column:
    return ((F.col(i) - 1) % m).cast("int")


def column_of(m: int, i: str = "idx") -> Column:
    return F.floor((F.col(i) - 1) / m).cast("int")


def ring(m: int, n: int) -> Column:
    """True on the outermost cells."""
    return (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == m - 1) | (F.col("c") == n - 1)


def pad(df: DataFrame, column: str = "z") -> DataFrame:
    """The outermost ring set to no data."""
    return df.withColumn(column, F.when(~ring(*extent(df)), F.col(column)))


def read_rule(column: str = "z", nodata: float | None = None) -> Column:
    """What a raster reader keeps: neither the no-data value, nor NaN, nor anything below 0."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return F.when((x >= 0) & (F.lit(nodata is None) | (x != F.lit(nodata if nodata is not None else 0.0))), x)


def shifted(column: str, by_rows: int, by_columns: int) -> Column:
    """A neighbour in one direction along a row or a column; null outside the grid."""
    if by_rows and by_columns:
        raise ValueError("one direction at a time")
    line, along, by = ("c", "r", by_rows) if by_rows else ("r", "c", by_columns)
    return F.first(column).over(Window.partitionBy(line).orderBy(along).rangeBetween(by, by))


def around(df: DataFrame, *columns: str) -> DataFrame:
    """Eight neighbours of each column as ``<column>_<side>``: a window along rows, then one along columns."""
    rows = df.withColumns({f"{x}_{s}": shifted(x, 0, SIDES[s][1]) for x in columns for s in ("w", "e")})
    return rows.withColumns({f"{x}_{v}{s}": shifted(f"{x}_{s}" if s else x, SIDES[v][0], 0) for x in columns for v in ("n", "s") for s in ("w", "", "e")})


def cross(df: DataFrame, *columns: str) -> DataFrame:
    """Four neighbours of each column (n, s, w, e)."""
    return df.withColumns({f"{x}_{s}": shifted(x, *SIDES[s]) for x in columns for s in ("w", "e", "n", "s")})


def sides(column: str) -> list[Column]:
    return [F.col(f"{column}_{s}") for s in SIDES]


def misaligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that only one of two grids has: empty if the grids are aligned."""
    return a.select("r", "c").exceptAll(b.select("r", "c")).unionAll(b.select("r", "c").exceptAll(a.select("r", "c")))
