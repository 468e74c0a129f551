"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is cut into blocks of equal token counts: ``total / BLOCKS`` words, or less, so that the source of the
smallest target has ``FINE`` blocks or more. Seats (blocks) go to sources by the highest quotients
``target / (2 j - 1)``, never beyond ``epochs`` passes over a source. The sequence of seats is cut into equal
runs, one per shard of the mix; how many seats of a run are a source's is its integer quota there. Quotas
are found by divisor search: all seats whose quotients are clear of a run's end are counted, and only the few of each
source around it are listed and ranked.

A source's documents stand in a seeded order and its blocks are cut from that stream; the quotas of the shards take them
one after another from the start, and again from the start after the last. So a document is taken whole in each full
pass, and at most one document of a source is taken in part (its first words).

Sources may be null (last in order). Null texts have no words. Repeated rows count each.
Empty tables and tables without a word give targets of 0. A source may hold any share of
the rows: running totals are taken in 4096 seeded buckets per source and then shifted. There may be any number of sources:
they are ordered by ranges, not in one task. Columns of docs stay as they are; what the mix
adds is one struct, whose name is altered where docs has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm import common
from talus.plans.order import ordered

BLOCKS, FINE, SHARDS, EPOCHS, SEED = 1 << 16, 64, 24, 3, 7


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size): place, weight, total, target. A row per source."""
    placed = ordered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "place")
    placed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("long")).withColumn("cap", epochs * F.col("source_size"))
    every = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    water = (
        common.cut(ordered(placed, [F.col("cap") / F.col("weight"), F.col("place")], "nth", {"caps": F.col("cap"), "weighed": F.col("weight")}))
        .withColumn("left", F.lit(every.total) - F.col("caps") + F.col("cap"))
        .withColumn("sharers", F.lit(every.weights) - F.col("weighed") + F.col("weight"))
        .withColumn("full", F.col("cap") * F.col("sharers") < F.col("weight") * F.col("left"))
    )
    first = water.where(~F.col("full")).agg(F.min(F.struct("nth", "left", "sharers")).alias("x")).first().x  # where the water stands
    share = (F.col("weight") * first.left).cast("double") / F.lit(float(first.sharers)) if first else F.lit(None).cast("double")
    target = F.when(F.lit(first is None) | (F.col("nth") < F.lit(first.nth if first else 0)), F.col("cap").cast("double")).otherwise(share)
    return water.select("source", "source_size", "place", F.lit(every.total).cast("long").alias("total"), target.alias("target"))


def blocked(goals: DataFrame, blocks: int = BLOCKS) -> tuple[DataFrame, int, int]:
    """Sources that have words, with n_blocks; the block's words; the seats in all."""
    total, least = goals.where("source_size > 0").agg(F.max("total"), F.min("target")).first()
    if not total:
        return goals.limit(0).withColumn("n_blocks", F.lit(0).cast("long")), 1, 0
    block = max(1, min(-(-total // blocks), int(least) // FINE))
    return goals.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")), block, (total + block // 2) // block


def quotas(goals: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, epochs: int = EPOCHS) -> DataFrame:
    """(place, block, n_blocks, upto): upto lists how many of a source's blocks the shards up to each take, in order of shards."""
    made, block, house = blocked(goals, blocks)
    made = common.cut(made)
    if not house:
        return made.select("place", F.lit(block).cast("long").alias("block"), "n_blocks", F.array_repeat(F.lit(0).cast("long"), shards).alias("upto"))
    n, whole = made.agg(F.count("*"), F.sum("target")).first()
    cap, end = epochs * F.col("n_blocks"), F.floor((F.col("run") + 1) * house / shards).cast("long")
    upto = lambda seats: F.floor((F.col("target") * 2 * seats / F.lit(whole) + 1) / 2).cast("long")  # noqa: E731 - a source's seats among about so many, give or take one
    runs = made.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("end", end)
    # seats that are surely among the first ``end``, and a number beyond which none is, if the span is wide enough
    sure = F.greatest(F.lit(0).cast("long"), F.least(cap, upto(F.greatest(F.lit(0).cast("long"), F.col("end") - n)) - 1))
    wide = n + 1
    while True:
        near = runs.withColumn("sure", sure).withColumn("last", F.least(cap, upto(F.col("end") + wide) + 1))
        per = {r.run: r for r in near.groupBy("run").agg(F.first("end").alias("end"), F.sum("sure").alias("sure"), F.sum("last").alias("last"), F.sum(cap).alias("cap")).collect()}  # a row a shard
        most = {k: min(r.end, r.cap) for k, r in per.items()}
        if all(r.last >= most[k] for k, r in per.items()):
            break
        wide *= 4
    listed = near.where("last > sure").select("run", "place", "target", F.explode(F.sequence(F.col("sure") + 1, F.col("last"))).alias("j"))
    ranked = common.cut(ordered(listed, [F.col("run"), (F.col("target") / (2 * F.col("j") - 1)).desc(), F.col("place"), F.col("j")], "at"))
    open_, before = [], 0
    counts = {r.run: r.n for r in ranked.groupBy("run").agg(F.count("*").alias("n")).collect()}  # a row a shard
    for k in range(shards):
        open_.append(F.when(F.col("run") == k, F.col("at") < before + most[k] - per[k].sure))
        before += counts.get(k, 0)
    won = ranked.where(F.coalesce(*open_)).groupBy("run", "place").agg(F.count("*").alias("won"))
    each = near.join(won, ["run", "place"], "left").select("place", "n_blocks", "run", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("upto"))
    listed = F.array_sort(F.collect_list(F.struct("run", "upto")))  # a number a shard
    return each.groupBy("place", "n_blocks").agg(F.transform(listed, lambda x: x["upto"]).alias("upto")).select("place", F.lit(block).cast("long").alias("block"), "n_blocks", "upto")


def mix(docs: DataFrame, blocks: int = BLOCKS, epochs: int = EPOCHS, seed: int = SEED, shards: int = SHARDS) -> tuple[DataFrame, str]:
    """``docs`` with a struct (its name is given back): size, source_size, target, passes (whole copies), part (first words taken once more), taken, shard.

    shard is that of the mix to whose quota a document's first word goes; null if none is taken.
    """
    name, size, key, bucket, mark, tie, before, plan = common.unused(docs, "mix", "_size", "_key", "_bucket", "_mark", "_tie", "_before", "_plan")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = (
        docs.withColumn(size, common.word_count())
        .withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn(mark, drawn)
        .withColumn(tie, F.xxhash64("text"))
        .withColumn(bucket, F.substring(mark, 1, 3))
    )
    sums = common.cut(rows.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.first("source").alias("source"), F.sum(size).alias("words")))
    goals = common.cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), epochs))
    quota = F.col("upto")[shards - 1]
    plans = (
        goals.join(quotas(goals, blocks, shards, epochs), "place", "left")
        .withColumn("passes", F.coalesce(F.floor(quota / F.col("n_blocks")), F.lit(0)).cast("long"))
        .withColumn("open", F.coalesce((quota % F.col("n_blocks")) * F.col("block"), F.lit(0)).cast("long"))
        .select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), F.struct("source_size", "target", "passes", "open", "block", "upto").alias("plan"))
    )
    shifted = sums.select("key", "bucket", (F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")).alias("before"))
    starts = common.cut(shifted.join(plans, "key")).select(F.col("key").alias(key), F.col("bucket").alias(bucket), F.col("before").alias(before), F.col("plan").alias(plan))
    within = Window.partitionBy(key, bucket).orderBy(mark, size, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = lambda field: F.col(f"{plan}.{field}")
    part = F.greatest(F.lit(0), F.least(F.col(size), p("open") - F.col(before))).cast("long")
    taken = p("passes") * F.col(size) + part
    at = F.floor(F.col(before) / p("block"))
    shard = F.when(taken > 0, F.size(F.filter(p("upto"), lambda u: u <= at)))
    placed = rows.join(starts, [key, bucket]).withColumn(before, F.col(before) + F.sum(size).over(within) - F.col(size))
    fields = F.struct(F.col(size).alias("size"), p("source_size").alias("source_size"), p("target").alias("target"), p("passes").alias("passes"), part.alias("part"), taken.alias("taken"), shard.alias("shard"))
    return placed.select(*docs.columns, fields.alias(name)), name


def copies(docs: DataFrame, **settings) -> DataFrame:
    """The mix of ``docs`` itself, in its columns: a row for every pass over a document.

    Texts stay whole: the document of a source that its last block cuts is taken once more if half of it or more is, so that
    a source's words are within half a document of its quotas.
    """
    mixed, name = mix(docs, **settings)
    (copy,) = common.unused(mixed, "_copy")
    times = F.col(f"{name}.passes") + ((F.col(f"{name}.part") > 0) & (2 * F.col(f"{name}.part") >= F.col(f"{name}.size"))).cast("long")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, name = mix(docs)
    return mixed.select("doc_id", *(F.col(f"{name}.{c}").alias(c) for c in ("size", "source_size", "target", "taken", "shard")))


ORACLE = f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as mark from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
p as (select *, row_number() over (order by source asc nulls last) - 1 as place from s),
w as (select *, place % 3 + 1 as weight, {EPOCHS} * source_size as cap, (sum(source_size) over ())::bigint as total from p),
v as (
  select *, row_number() over up as nth,
    (total - sum(cap) over up + cap)::bigint as remain, (sum(weight) over () - sum(weight) over up + weight)::bigint as sharers
  from w window up as (order by cap / weight, place rows between unbounded preceding and current row)),
u as (select min(nth) as nth from v where not (cap * sharers < weight * remain)),
g as (
  select v.source, v.source_size, v.place, v.total,
    case when u.nth is null or v.nth < u.nth then v.cap::double else (v.weight * f.remain)::double / f.sharers::double end as target
  from v cross join u left join v f on f.nth = u.nth),
b as (
  select *, ceil(source_size / block)::bigint as n_blocks, (total + block // 2) // block as house
  from (
    select *, greatest(1, least((total + {BLOCKS} - 1) // {BLOCKS}, (floor(min(target) over ()))::bigint // {FINE}))::bigint as block
    from g where source_size > 0)),
e as (select *, unnest(range(1, {EPOCHS} * n_blocks + 1)) as j from b),
r as (select *, row_number() over (order by target / (2 * j - 1) desc, place, j) - 1 as seat from e),
k as (select place, block, n_blocks, run, count(*) filter (seat < (run + 1) * house // {SHARDS}) as upto from r, range({SHARDS}) t(run) group by place, block, n_blocks, run),
q as (select place, any_value(block) as block, any_value(n_blocks) as n_blocks, max(upto) as quota, list(upto order by run) as upto from k group by place),
o as (
  select g.*, block, upto, coalesce(quota // n_blocks, 0) as passes, coalesce((quota % n_blocks) * block, 0) as open
  from g left join q using (place)),
c as (
  select d.*, (sum(size) over (partition by source order by mark, size rows between unbounded preceding and current row) - size)::bigint as start from d),
t as (
  select doc_id, size, source_size, target, (passes * size + greatest(0, least(size, open - start)))::bigint as taken, start // block as nth_block, upto
  from c join o on c.source is not distinct from o.source)
select doc_id, size, source_size, target, taken, case when taken > 0 then len(list_filter(upto, lambda x: x <= nth_block)) end::int as shard from t
"""

QUERIES = {"op3_sainte_lague_mix": op3_sainte_lague_mix}
ORACLES = {"op3_sainte_lague_mix": ORACLE}
