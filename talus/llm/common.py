"""Things the training-data operators share: reading, checkpoints, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.plans.checkpoints import cut, shared_dir  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def word_count(c: str = "text") -> Column:
    """Words of a whole text; null has none."""
    return F.regexp_count(text_or_empty(c), F.lit(WORD)).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, altered where ``df`` has such a column already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows or fewer, else as it is. It should be written already."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
