"""Statistics of maps, zones and pairs of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut
from talus.plans.order import ordered

from talus.operators.focal import label_boundary
from talus.plans.tiles import tiled


def threshold_counts(df: DataFrame, value: str = "sus", cell: float = 10.0) -> DataFrame:
    """One row: cells with data, above 0, at 50 and 90 or more, their shares in percent, the mean, and areas in square kilometres."""
    n, v = F.count(value), F.col(value)
    made = {"n": n, "n_pos": F.count_if(v > 0), "n50": F.count_if(v >= 50), "n90": F.count_if(v >= 90)}
    out = df.agg(*[x.alias(k) for k, x in made.items()], F.avg(value).alias("mean"))
    for k in ("n_pos", "n50", "n90"):
        out = out.withColumns({f"{k}_share": F.try_divide(100.0 * F.col(k), F.col("n")), f"{k}_km2": F.col(k) * (cell * cell / 1e6)})
    return out


def histogram(df: DataFrame, value: str = "sus", bins: int = 50) -> DataFrame:
    """(bin 1..bins, count) of positive values between the least and the greatest of them; the last bin is closed."""
    v = F.col(value).cast("double")
    some = df.where(v > 0).select(v.alias("v"))
    lo, hi = some.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return some.select(F.lit(1).alias("bin"), F.lit(0).cast("long").alias("count")).limit(0)
    at = F.least(F.lit(bins), F.floor((F.col("v") - lo) * bins / (hi - lo)) + 1) if hi > lo else F.lit(1)
    return some.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def empirical_cdf(df: DataFrame, value: str = "sus") -> DataFrame:
    """(value, share): share of values at or below each distinct value, ordered by ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    run = cut(ordered(counts, [F.col("value")], "at", {"upto": F.col("n")}))
    total = run.agg(F.max("upto")).first()[0]
    return run.select("value", (F.col("upto") / F.lit(total)).alias("share"))


def percentiles(df: DataFrame, value: str = "sus", at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """One row: exact percentiles, linear between values."""
    return df.agg(*[F.expr(f"percentile({value}, {p})").alias(f"p{round(100 * p)}") for p in at])


def unit_weight(df: DataFrame, by: str = "cluster", dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """(by, gamma): weight over volume of a cluster's columns, 0 without volume."""
    volume = F.sum(F.col("depth") * (dx * dy))
    return df.groupBy(by).agg(F.when(volume > 0, F.sum("w") / volume).otherwise(0.0).alias("gamma"))


def unit_areas(df: DataFrame, unit: str = "unit", cell_area: float = 100.0) -> DataFrame:
    return df.where(F.col(unit) > 0).groupBy(unit).agg(F.count("*").alias("n_cells"), (F.count("*") * cell_area).alias("area_m2"))


def zonal(df: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, n, least, greatest, mean, total): no data left out, totals 0 where all is."""
    v = F.col(value)
    return df.groupBy(zone).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"))


def termination_histogram(df: DataFrame, code: str = "code") -> DataFrame:
    return df.groupBy(code).agg(F.count("*").alias("clusters"))


def contingency(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, n) where both are above 0."""
    return df.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(a, b).agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> DataFrame:
    return table.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})


def adjusted_rand(table: DataFrame) -> DataFrame:
    """One row, ari, of a contingency table; 1 where nothing could differ."""
    two = lambda x: x * (x - 1) / 2
    cells = table.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    side = lambda k: table.groupBy(k).agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x"))).alias(k))
    one = cells.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))  # one row each
    chance = F.col("a") * F.col("b") / two(F.col("n"))
    gap = (F.col("a") + F.col("b")) / 2 - chance
    return one.select(F.when(gap == 0, 1.0).otherwise(F.try_divide(F.col("s") - chance, gap)).alias("ari"))


def variation_of_information(table: DataFrame) -> DataFrame:
    """One row, vi in bits."""
    every = _marginals(table).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return every.agg((-F.sum(F.col("p") * (F.log2(F.col("n") / F.col("na")) + F.log2(F.col("n") / F.col("nb"))))).alias("vi"))


def best_iou(table: DataFrame) -> DataFrame:
    """One row: mean best intersection over union from a to b and from b to a, weighted by size."""
    each = _marginals(table).withColumn("iou", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    side = lambda k, n: each.groupBy(k).agg(F.max("iou").alias("best"), F.first(n).alias("size")).agg((F.sum(F.col("best") * F.col("size")) / F.sum("size")))
    return side("a", "na").toDF("iou_ab").join(F.broadcast(side("b", "nb").toDF("iou_ba")))


def boundary_fscore(df: DataFrame, a: str = "a", b: str = "b", tolerance: int = 1) -> DataFrame:
    """One row: precision (of a's label borders, those near b's), recall (of b's, those near a's) and f; near is within ``tolerance`` steps."""
    import numpy as np

    edges = label_boundary(label_boundary(df, a).withColumnRenamed("edge", "ea"), b).withColumnRenamed("edge", "eb")
    valid = (F.col(a) > 0) & (F.col(b) > 0)
    edges = edges.select("r", "c", (F.col("ea") & valid).alias("ea"), (F.col("eb") & valid).alias("eb"))

    def kernel(grid: dict, place: dict) -> dict:
        out = {}
        for name, x in (("wa", grid["ea"]), ("wb", grid["eb"])):
            x = np.nan_to_num(x) > 0
            for _ in range(tolerance):
                p = np.pad(x, 1)
                x = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
            out[name] = x
        return out | {"xa": np.nan_to_num(grid["ea"]) > 0, "xb": np.nan_to_num(grid["eb"]) > 0}

    near = tiled(edges, ["ea", "eb"], kernel, "wa boolean, wb boolean, xa boolean, xb boolean", max(1, tolerance))
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count_if(of)), F.lit(0.0))
    out = near.agg(share(F.col("xa") & F.col("wb"), F.col("xa")).alias("precision"), share(F.col("xb") & F.col("wa"), F.col("xb")).alias("recall"))
    return out.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def by_label(df: DataFrame, value: str, label: str = "root") -> DataFrame:
    """(label, mean, top): mean and largest value of each label's cells; nulls don't count."""
    return df.groupBy(label).agg(F.avg(value).alias("mean"), F.max(value).alias("top"))
