"""A training corpus from documents: toxic ones out, one of each near-duplicate group kept, benchmark text out, sources mixed, rows sharded.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of documents. ``run`` writes each stage's rows to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common, decontamination, mixing, sharding, simhash, toxicity
from talus.plans.checkpoints import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the rejection threshold; labels come from the labels table, their texts from documents."""
    model = toxicity.fitted(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(toxicity.made(docs)[0]) < toxicity.REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike to 0.8 or more."""
    return simhash.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return decontamination.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every whole copy that the sources' quotas take."""
    return mixing.copies(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: The stages learn, link and cut by ways that SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. What a stage writes goes once the next one's rows are written; the last folder stays, as the result reads it."""
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{name}")
            docs = spark.read.parquet(f"{where}/{name}")
            if k:
                remove(spark, f"{where}/{STAGES[k - 1][0]}")
    return docs
