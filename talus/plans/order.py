"""Places and running sums over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut


def ordered(df: DataFrame, order: list[Column], place: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``place`` (from 0) in ``order`` and running sums up to and with each row.

    Rows are dealt by ranges of the first keys and written, counted within a range, and shifted by the
    totals of the ranges before, of which there are as many as partitions. Equal rows of
    ``order`` get their places in any order, so it should tell rows apart. An empty table stays empty.
    """
    sums = sums or {}
    part = "_range"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.count("*").alias(place), *(F.sum(c).alias(k) for k, c in sums.items())).collect()  # a row a partition
    before, rows = {place: 0} | dict.fromkeys(sums, 0), []
    for t in sorted(totals, key=lambda t: t[part]):
        rows.append((t[part], *before.values()))
        before = {k: v + (t[k] or 0) for k, v in before.items()}
    up = Window.partitionBy(part).orderBy(*order)
    run = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {place: "long"} | {k: "double" if any(isinstance(t[k], float) for t in totals) else "long" for k in sums}
    shift = df.sparkSession.createDataFrame(rows, ", ".join([f"{part} int", *(f"_before_{k} {t}" for k, t in kinds.items())]))
    counted = dealt.select("*", (F.row_number().over(up) - 1).cast("long").alias(place), *(F.sum(c).over(run).alias(k) for k, c in sums.items()))
    moved = {k: F.col(k) + F.col(f"_before_{k}") for k in kinds}
    return counted.join(F.broadcast(shift), part).select(*df.columns, *(v.alias(k) for k, v in moved.items()))
