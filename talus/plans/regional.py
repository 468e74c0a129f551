"""The whole regional run: surface and substrate, water, shaking, no-grow lines, scenarios, growth and the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.operators import grid, growth, labels, morphology, physics, scenarios
from talus.operators.focal import horn
from talus.plans.checkpoints import cut, release


def prepared(df: DataFrame, depth: DataFrame | float = 2.0, mode: int = 1, mw: float = 0.5, pga: DataFrame | float | None = None, scaling: float = 1.0, dx: float = 10.0, dy: float = 10.0, wedge: str = "matlab_local") -> DataFrame:
    """(r, c, z, depth, w, sigma_s, sigma_w, pga, subdx, subdy): what forces need, of a grid with z."""
    padded = grid.pad(df.select("r", "c", "z"))
    if isinstance(depth, DataFrame):
        padded = padded.join(depth.select("r", "c", "depth"), ["r", "c"], "left")
    else:
        padded = physics.uniform_depth(padded, depth)
    options = {"mw": mw, "wedge": wedge} if mode == 1 else {}
    padded = physics.hydrology(padded, mode, dx=dx, dy=dy, **options)
    if pga is None:
        padded = physics.pga_off(padded)
    elif isinstance(pga, DataFrame):
        padded = physics.pga_raster(padded, pga, scaling)
    else:
        padded = physics.pga_uniform(padded, pga, scaling)
    sub = horn(physics.substrate(padded), "z_sub", dx, dy)
    return sub.select("r", "c", "z", "depth", "w", "sigma_s", "sigma_w", "pga", F.col("dzdx").alias("subdx"), F.col("dzdy").alias("subdy"))


def by_run(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each cell and scenario. Scenarios are a small table; zero probabilities are left out."""
    live = runs.where("prob <> 0").agg(F.sort_array(F.collect_list(F.struct("run", "phi", "coh", "prob"))).alias("_runs"))
    return cells.join(F.broadcast(live)).withColumn("_run", F.explode("_runs")).select(*cells.columns, "_run.*")


def forces_by_run(cells: DataFrame, runs: DataFrame, dx: float = 10.0, dy: float = 10.0) -> DataFrame:
    """Column forces of each cell and scenario."""
    return physics.column_forces(by_run(cells, runs), F.col("phi"), F.col("coh"), dx, dy)


def candidates(forces: DataFrame, runs: DataFrame, m: int, cleanup: int = 5, least: int = 7, nogrow: DataFrame | None = None) -> DataFrame:
    """(run, cluster, r, c, phi, coh): clusters of unstable cells after the clean-up, numbered 1..K in each run.

    All runs are one grid of m rows each, with an empty row between them that no pass of the clean-up crosses. Runs
    after the first one without clusters do not count and are left out.
    """
    every = F.col("run") * (m + 1)
    stack = forces.select((F.col("r") + every).alias("r"), "c", (F.col("z").isNotNull() & (F.col("q") > 0)).alias("mask"))
    no = None if nogrow is None else by_run(nogrow.select("r", "c").distinct(), runs).select((F.col("r") + every).alias("r"), "c")
    live = runs.where("prob <> 0")
    top = live.agg(F.max("run")).first()[0] or 0
    found = labels.components(morphology.passed(stack, cleanup, no), m=(top + 1) * (m + 1))
    found = found.join(found.groupBy("root").count().where(F.col("count") >= least), "root", "left_semi")
    own = found.select(F.floor(F.col("r") / (m + 1)).cast("int").alias("run"), (F.col("r") % (m + 1)).cast("int").alias("r"), "c", "root")
    named = labels.numbered(own.withColumn("_first", F.struct("run", "root")), "_first", "_place")  # by run, then by first cell
    lowest = named.groupBy("run").agg(F.min("_place").alias("_low"))
    dims = live.select("run", "phi", "coh")
    stop = dims.join(lowest, "run", "left_anti").agg(F.min("run").alias("_stop"))
    return (
        named.join(F.broadcast(lowest), "run")
        .join(F.broadcast(dims), "run")
        .join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("run") < F.col("_stop")))
        .select("run", (F.col("_place") - F.col("_low") + 1).cast("long").alias("cluster"), "r", "c", "phi", "coh")
    )


def begun(df: DataFrame, runs: DataFrame, nogrow: DataFrame | None = None, settings: growth.Settings | None = None, cleanup: int = 5, **options) -> dict[str, DataFrame]:
    """What comes before growth: cells, forces, candidate clusters (packed: by tile), and summary (run, phi, coh, prob, n_clusters)."""
    s = settings or growth.Settings()
    cells = cut(prepared(df, dx=s.dx, dy=s.dy, **options))
    forces = forces_by_run(cells, runs, s.dx, s.dy)
    packed = cut(growth.packed(candidates(forces, runs, grid.extent(cells)[0], cleanup, s.least, nogrow)))
    clusters = growth.unpacked(packed)
    release(df.sparkSession)
    return {"cells": cells, "forces": forces, "clusters": clusters, "summary": scenarios.run_summary(clusters, runs.where("prob <> 0")), "packed": packed}


def regional(df: DataFrame, runs: DataFrame, nogrow: DataFrame | None = None, settings: growth.Settings | None = None, cleanup: int = 5, **options) -> dict[str, DataFrame]:
    """sus (r, c, z, sus), summary (run, phi, coh, prob, n_clusters) and clusters (run, cluster, r, c, kind, code, cycles)."""
    s = settings or growth.Settings()
    cells, _, clusters, summary, packed = begun(df, runs, nogrow, s, cleanup, **options).values()
    if nogrow is not None:
        rasters = cells.join(nogrow.select("r", "c").distinct().withColumn("nogrow", F.lit(True)), ["r", "c"], "left").withColumn("nogrow", F.coalesce("nogrow", F.lit(False)))
    else:
        rasters = cells.withColumn("nogrow", F.lit(False))
    grown = growth.grow_clusters(clusters, rasters, s, own=packed)
    slides = grown.where("kind = 'final' and code >= 0 and r is not null").select("run", "r", "c").distinct()
    return {"sus": scenarios.susceptibility(slides, summary, cells.select("r", "c", "z")), "summary": summary, "clusters": grown}
