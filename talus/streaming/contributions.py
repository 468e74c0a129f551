"""Streams over banked contributions and logs: additions, as the reference method has no streams of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "r int, c int, prob double, n_runs int, no_slides boolean, run int"


def accumulate(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    """A query that adds up probabilities of contributions banked so far into the in-memory table ``name``, then ends."""
    rows = spark.readStream.schema(SCHEMA).parquet(path).dropDuplicates(["run", "r", "c"])
    total = rows.where("r is not null").groupBy("r", "c").agg(F.sum("prob").alias("prob"))
    return total.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Fixed patterns of progress lines; a leading time stamp is dropped first.
STAMP = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\s+"
PATTERNS = {
    "clusters": r"^Found (\d+) candidate clusters",
    "run": r"^\[run (\d+)/(\d+)\]",
    "cluster": r"^LS Cluster (\d+)/(\d+)",
    "parallel": r"^PARALLEL progress: ([\d.]+)/(\d+)",
    "elapsed": r"^Total elapsed: ([\d.]+) min",
}


def parse_progress(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with event (null for other lines), first and second number."""
    text = F.regexp_replace(line, STAMP, "")
    found = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in PATTERNS.items()))
    number = lambda i: F.coalesce(*(F.when(text.rlike(p), F.regexp_extract(text, p, i)) for p in PATTERNS.values() if i == 1 or p.count("(") > 1)).try_cast("double")
    return lines.withColumns({"event": found, "first": number(1), "second": number(2)})


def fraction(run: Column, runs: Column, done: Column, clusters: Column) -> Column:
    """Progress of a serial run, 0.99 at most before its end."""
    part = F.coalesce(F.try_divide(done.cast("double"), clusters), F.lit(0.0))
    return F.least(F.lit(0.99), ((run - 1) + part) / F.greatest(F.lit(1), runs))


def tail(spark: SparkSession, path: str, lines: int = 25, most: int = 256 << 10) -> DataFrame:
    """The last lines of a text file, in order; only its last ``most`` bytes are read, and a line that they cut is left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    stream.seek(max(0, size - most))
    text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
    stream.close()
    rows = text.splitlines()[1 if size > most else 0 :][-lines:] if lines > 0 else []
    return spark.createDataFrame([(x,) for x in rows], "value string")
