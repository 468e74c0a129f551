"""Cross-site boilerplate lines by distinct-site spread.

A line is trimmed (ASCII white space) and known by its 64-bit hash, without a look at the text (two lines of one hash
would count as one: among 10^9 different lines the chance of any such two is 0.03); blank lines are none. Per
hash, HyperLogLog sketches of the sites merge by aggregation. Lines whose estimate is clear
of ``SITES`` by more than ``BAND`` are decided by it; lines near the threshold get an exact distinct
count. Lines on ``SITES`` sites or more are removed from all documents.

Sketches are of fixed size, so a line in a third of all rows costs no more than any other;
the removal joins hashes, not texts, and a document's hits are at most its own lines.

A null site counts as one site of its own. Null texts stay null and have no lines. Repeated rows are cleaned
each and add no site. Columns n_lines and n_removed of the input give way to the counts; other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common

SITES, LOG_SIZE, BAND = 5, 10, 0.15
FEW = 1 << 20  # hashes that are broadcast: 8 MB


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hashes(text: str) -> Column:
    kept = F.filter(F.transform(_lines(text), _trimmed), lambda x: F.length(x) > 0)
    return F.transform(kept, lambda x: F.xxhash64(x))


def spread_lines(docs: DataFrame, site: str = "source", text: str = "text", sites: int = SITES) -> DataFrame:
    """Hashes ``h`` of lines found on ``sites`` distinct sites or more."""
    # sketches leave empty strings out, so that a null or empty site has another mark
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("?")).alias("site"), F.explode(F.array_distinct(_hashes(text))).alias("h"))
    spread = common.cut(rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SIZE))).alias("n")).where(F.col("n") >= sites * (1 - BAND)))
    near = spread.where(F.col("n") <= sites * (1 + BAND)).select("h")
    # (line, site) pairs are made distinct before they are dealt by line, so that a line of all rows is one pair a site by then;
    # few lines near the threshold are sent to all tasks, more are met after that
    few = near.limit(FEW + 1).count() <= FEW
    pairs = (rows.join(F.broadcast(near), "h", "left_semi") if few else rows).distinct()
    exact = (pairs if few else pairs.join(near, "h", "left_semi")).groupBy("h").count().where(F.col("count") >= sites).select("h")
    return spread.where(F.col("n") > sites * (1 + BAND)).select("h").union(exact)


def remove_spread_lines(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", sites: int = SITES) -> DataFrame:
    """docs without those lines, and n_lines (lines that aren't blank) and n_removed."""
    mark, hit_key, hit_mark, hits = common.unused(docs, "_mark", "_key", "_hit_mark", "_hits")
    spread = common.cut(spread_lines(docs, site, text, sites))
    marked = docs.withColumn(mark, F.xxhash64(text))
    found = (
        marked.select(F.col(key).alias(hit_key), F.col(mark).alias(hit_mark), F.explode(F.array_distinct(_hashes(text))).alias("h"))
        .join(spread, "h", "left_semi")
        .groupBy(hit_key, hit_mark)
        .agg(F.collect_set("h").alias(hits))
    )
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    bad = lambda x: (F.length(_trimmed(x)) > 0) & F.array_contains(F.col(hits), F.xxhash64(_trimmed(x)))
    cleaned = F.when(F.col(hits).isNull(), F.col(text)).otherwise(F.array_join(F.filter(_lines(text), lambda x: ~bad(x)), "\n"))
    joined = marked.join(found, marked[key].eqNullSafe(found[hit_key]) & (marked[mark] == found[hit_mark]), "left")
    return joined.select(
        *[cleaned.alias(text) if c == text else F.col(c) for c in own],
        F.coalesce(F.size(_hashes(text)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(hits).isNull(), F.lit(0)).otherwise(F.size(F.filter(_lines(text), bad))).cast("long").alias("n_removed"),
    )


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_spread_lines(docs).select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


ORACLE = f"""
with d as (select *, row_number() over () as row, string_split(text, chr(10)) as parts from documents),
l as (select row, source, k, parts[k] as line, trim(parts[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from (select *, unnest(range(1, len(parts) + 1)) as k from d)),
s as (select t from l where t <> '' group by t having count(distinct coalesce('=' || source, '')) >= {SITES}),
m as (select l.*, t <> '' as is_line, s.t is not null as bad from l left join s using (t)),
g as (
  select row, count(*) filter (is_line) as n_lines, count(*) filter (bad) as n_removed,
    coalesce(string_agg(line, chr(10) order by k) filter (not bad), '') as kept
  from (select row, k, line, is_line, coalesce(bad, false) as bad from m) group by row)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when text is not null then length(kept) end as n_chars,
  case when text is not null then sha256(kept) end as text_sha256
from d left join g using (row)
"""

QUERIES = {"op6_site_spread": op6_site_spread}
ORACLES = {"op6_site_spread": ORACLE}
