"""Rasters, arrays and reports written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talus.operators import grid, hydrology, labels, scenarios, vector
from talus.plans.checkpoints import shared_dir
from talus.queries import surface  # noqa: F401  (its SQL for shaded relief is used here)
from talus.queries.fixtures import CELLS, ENDS, HOLES, ORACLES, RUNS, UNITS, cells, holes, query, runs, runs_sql, units, with_sql
from talus.queries.global_ import _BANK, _banked
from talus.sources import geotiff, mat, reports
from talus.sources.tiff import GeoRef


def folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query(with_sql(CELLS, HOLES, select="select r, c, case when z is not null then v end as z from holes"))
def geotiff_round_trip(spark, d):
    """A raster of single precision in files of 300 x 300 cells, and read again."""
    path = folder(spark)
    geotiff.write(holes(spark, d).withColumn("z", F.when(F.col("z").isNotNull(), F.col("v"))), path, ref=GeoRef(10.0, 10.0, 5e5, 4e6), tile=300)
    return geotiff.read(spark, path)


@query(with_sql(CELLS, select="select r, c, case when v >= 0 then v end as z from cells"))
def geotiff_read_dem(spark, d):
    path = f"{folder(spark)}/dem.tif"
    geotiff.write(cells(spark, d), path, "v")
    return geotiff.read_dem(spark, path)


@query(with_sql(CELLS, UNITS, select="select r, c, greatest(a - 300, 0)::bigint as unit from units"))
def geotiff_read_units(spark, d):
    """Labels as whole numbers; what is below 0 is no unit."""
    path = f"{folder(spark)}/units.tif"
    geotiff.write(units(spark, d).withColumn("a", F.col("a") - 300), path, "a", GeoRef(nodata=-300.0), "int32")
    return geotiff.read_units(spark, path)


@query(with_sql(CELLS, select="select 'tile_' || (r // 200) || '_' || (c // 40) || '.tif' as name, true as filled from cells group by r // 200, c // 40"))
def grid_listing(spark, d):
    path = folder(spark)
    for_tiles = cells(spark, d).withColumns({"tr": F.floor(F.col("r") / 200), "tc": F.floor(F.col("c") / 40)})
    geotiff.write(for_tiles.select("r", (F.col("tc") * 200 + F.col("c") % 40).cast("int").alias("c"), "v"), path, "v", tile=200)
    return reports.grids(spark, path).select("name", (F.col("bytes") > 0).alias("filled"))


@query(with_sql(CELLS, HOLES, select="select r, c, case when z is not null then 1 + v end as depth from holes"))
def mat_soil_depth(spark, d):
    path = f"{folder(spark)}/depth.mat"
    mat.write(holes(spark, d).withColumn("depth", F.when(F.col("z").isNotNull(), 1 + F.col("v"))), path, {"depth": "depth"})
    return mat.soil_depth(spark, path)


@query(with_sql(CELLS, select="select r, c, v > 0.1 as nogrow, v > 0.12 as ridge, false as valley from cells"))
def mat_no_grow(spark, d):
    """A file without valleys has none."""
    path = f"{folder(spark)}/nogrow.mat"
    mat.write(cells(spark, d).withColumns({"a": F.col("v") > 0.1, "b": F.col("v") > 0.12}), path, {"nogrow_io": "a", "ridge_io": "b"})
    return mat.no_grow(spark, path)


@query(with_sql(runs_sql(), select="select run, phi, coh, prob from runs"))
def mat_strength(spark, d):
    path = f"{folder(spark)}/strength.mat"
    one = runs(spark, RUNS).select((F.col("run") - 1).alias("r"), F.lit(0).alias("c"), "phi", "coh", "prob")
    mat.write(one, path, {"prob": "prob", "prob_phi": "phi", "prob_coh": "coh"})
    return mat.strength(spark, path)


@query(with_sql(CELLS, _BANK, runs_sql(), select="select run, phi, coh, prob, (select count(*) from bank where bank.run = runs.run) as n_clusters from runs"))
def summary_json(spark, d):
    path = folder(spark)
    n = _banked(spark, d).groupBy("run").agg(F.count("*").alias("n"))
    reports.write_summary(runs(spark).join(n, "run", "left").withColumn("n_clusters", F.coalesce("n", F.lit(0))), path)
    return reports.read_summary(spark, path)


@query(f"with shaded as ({ORACLES['hillshade']}), {CELLS} select r, c, 2 + v as depth, v > 0.1 as nogrow, abs(v) as pga, shade as hillshade from cells join shaded using (r, c)")
def intermediate_rasters(spark, d):
    path = folder(spark)
    wide = cells(spark, d).select("r", "c", "z", (2 + F.col("v")).alias("depth"), F.abs("v").alias("pga"), "v")
    reports.write_intermediates(wide, path, wide.where("v > 0.1").select("r", "c"))
    return spark.read.parquet(path).withColumn("hillshade", F.round("hillshade", 6))


@query(with_sql(CELLS, select="select r, c, v * 2 as twice, 1 as made from cells"))
def kept_intermediate(spark, d):
    """Made once, read the second time."""
    path, made = folder(spark), []

    def make():
        made.append(1)
        return cells(spark, d).select("r", "c", (F.col("v") * 2).alias("twice"))

    for _ in range(2):
        out = reports.kept(spark, path, "dem", "twice", make)
    return out.withColumn("made", F.lit(len(made)))


@query(with_sql(CELLS, _BANK, select="select r, c, round(100 * coalesce(p, 0), 6) as sus from cells left join (select r, c, sum(prob) as p from bank group by r, c) using (r, c)"))
def aggregate_whole_bank(spark, d):
    """Contributions of three runs, banked for three and refused unless all are there."""
    path = folder(spark)
    whole = _banked(spark, d).withColumns({"run": F.when(F.col("run") == 4, 3).otherwise(F.col("run")), "n_runs": F.lit(3)})
    scenarios.bank(whole, path)
    return scenarios.aggregate_contributions(spark.read.parquet(path), cells(spark, d).select("r", "c", "z"), 3).select("r", "c", F.round("sus", 6).alias("sus"))


@query(with_sql(CELLS, ENDS, "s as (select r, c, case when (r * 7 + c * 5) % 301 = 0 then r * 100 + c + 1 else 0 end as label from cells)",
    "near as (select s.r, s.c, min({'d': (s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c), 'l': t.label}) as x from s join s t on t.label > 0 and t.r between s.r - 400 and s.r + 400 group by s.r, s.c)",
    select="select r, c, (case when label > 0 then label when c % 6 > 0 then x.l else 0 end)::bigint as label from s join near using (r, c)"))
def fill_labels(spark, d):
    """Every open cell takes the nearest label, however far."""
    r, c = F.col("r"), F.col("c")
    s = cells(spark, d).select("r", "c", F.when((r * 7 + c * 5) % 301 == 0, r * 100 + c + 1).otherwise(0).cast("long").alias("label"), (c % 6 > 0).alias("room"))
    return labels.fill_labels(s).select("r", "c", "label")


@query(with_sql(CELLS, ENDS, UNITS, select="select a as unit, count(*) as n_cells, count(*) * 100.0::double as area_m2 from units where a > 0 group by a"))
def vector_sink(spark, d):
    """Units as GeoJSON, written and read again."""
    path = f"{folder(spark)}/units.geojson"
    vector.write_vector(vector.union_by_unit(vector.outlines(units(spark, d).withColumnRenamed("a", "unit"))), path)
    back = vector.read_geojson(spark, path, "unit int, n_cells bigint, area_m2 double")
    return back.where(F.col("geometry").startswith("{")).select("unit", "n_cells", "area_m2")


@query(with_sql(CELLS, HOLES, ENDS, select="select r, c, row_number() over (order by coalesce(z, '-inf'::double) desc, c, r) as rank from holes"))
def upstream_order(spark, d):
    """Cells from the highest, without flats."""
    h = holes(spark, d)
    own = h.select("r", "c", F.col("z").alias("filled"), F.lit(None).cast("double").alias("aux")).withColumn("idx", grid.idx(grid.extent(h)[0]))
    return hydrology.upstream_order(own).select("r", "c", "rank")
