"""Strength scenarios: probability-weighted maps and banked contributions."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strength(spark: SparkSession, rows: list[tuple[int, float, float, float]]) -> DataFrame:
    """(run, phi, coh, prob): a small dimension table; runs count from 1."""
    return spark.createDataFrame(rows, "run int, phi double, coh double, prob double")


def active_runs(summary: DataFrame) -> DataFrame:
    """Rows of (run, prob, n_clusters) that count: not of probability 0, and before the first such run without clusters."""
    live = summary.where("prob <> 0")
    stop = live.where("n_clusters = 0").agg(F.min("run").alias("stop"))
    return live.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("run") < F.col("stop")), "left_semi")


def susceptibility(slides: DataFrame, summary: DataFrame, grid: DataFrame) -> DataFrame:
    """grid (r, c, z) with sus in percent: slides (run, r, c) weighted by the probabilities of active runs; null without data."""
    runs = active_runs(summary).select("run", "prob")
    hit = slides.join(F.broadcast(runs), "run").groupBy("r", "c").agg(F.sum("prob").alias("_p"))
    return grid.join(hit, ["r", "c"], "left").withColumn("sus", F.when(F.col("z").isNotNull(), 100 * F.coalesce("_p", F.lit(0.0)))).drop("_p")


def bank(contribution: DataFrame, path: str) -> None:
    """Write (run, r, c, prob, n_runs, no_slides) by run; a run's files replace those of an earlier try."""
    contribution.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def contribution_gaps(banked: DataFrame, n_runs: int) -> DataFrame:
    """(run, problem): runs missing, beyond n_runs, or banked for another number of runs."""
    spark = banked.sparkSession
    want = spark.range(1, n_runs + 1).select(F.col("id").cast("int").alias("run"))
    have = banked.groupBy("run").agg(F.min("n_runs").alias("lo"), F.max("n_runs").alias("hi"), F.countDistinct("prob").alias("probs"))
    missing = want.join(have, "run", "left_anti").select("run", F.lit("missing").alias("problem"))
    extra = have.join(want, "run", "left_anti").select("run", F.lit("extra").alias("problem"))
    mixed = have.where((F.col("lo") != n_runs) | (F.col("hi") != n_runs)).select("run", F.lit("other n_runs").alias("problem"))
    twice = have.where("probs > 1").select("run", F.lit("duplicate").alias("problem"))
    return missing.unionAll(extra).unionAll(mixed).unionAll(twice)


def aggregate_contributions(banked: DataFrame, grid: DataFrame, n_runs: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """The map from banked contributions. With ``n_runs``: refused if runs are missing, banked twice, beyond or for another number.

    Refused too if a cell lies outside the grid; probabilities that do not add up to 1 give a warning.
    """
    if n_runs is not None and (gaps := contribution_gaps(banked, n_runs).collect()):  # a row a run at most four times
        raise ValueError("contributions are not complete: " + ", ".join(f"run {g.run} {g.problem}" for g in gaps))
    have, want = (x.agg(F.max("r"), F.max("c"), F.least(F.min("r"), F.min("c"))).first() for x in (banked, grid))
    if have[0] is not None and (want[0] is None or have[0] > want[0] or have[1] > want[1] or have[2] < 0):
        raise ValueError("contributions are of another grid")
    summary = banked.groupBy("run").agg(F.max("prob").alias("prob"), F.count("r").alias("n_clusters"))
    if n_runs is not None and (gap := probability_gap(summary)) > tolerance:
        warnings.warn(f"probabilities add up to 1 but for {gap:g}", stacklevel=2)
    return susceptibility(banked.where("r is not null").select("run", "r", "c"), summary, grid)


def probability_gap(summary: DataFrame) -> float:
    """How far the probabilities are from adding up to 1."""
    return abs((summary.agg(F.sum("prob")).first()[0] or 0.0) - 1.0)


def net_force(forces: DataFrame, slides: DataFrame, summary: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with force: the sum of prob * -q over active runs' slide cells; positive in compression. forces: run, r, c, q."""
    runs = active_runs(summary).select("run", "prob")
    each = slides.join(F.broadcast(runs), "run").join(forces, ["run", "r", "c"], "left")
    total = each.groupBy("r", "c").agg(F.sum(F.col("prob") * -F.coalesce("q", F.lit(0.0))).alias("_f"))
    return grid.join(total, ["r", "c"], "left").withColumn("force", F.when(F.col("z").isNotNull(), F.coalesce("_f", F.lit(0.0)))).drop("_f")


def run_summary(clusters: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with n_clusters: all candidate clusters (run, cluster) of a run, those skipped later too."""
    n = clusters.groupBy("run").agg(F.countDistinct("cluster").alias("_n"))
    return runs.join(n, "run", "left").withColumn("n_clusters", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
