"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 32-bit positions; a row's key falls on an
arc, which belongs to the point that ends it. Rows are offered clockwise, and where an
arc's shard is full, the rest of the arc's rows go on clockwise to the next shard that
has room. Loads are bounded by ``capacities``: with the bounds used here they add up to the
number of rows, so that shards differ by one row at most.

Only counts of bins (arc and sub-bin, ``shards * vnodes * SUBS`` at most whatever the
input) reach the driver; rows meet their bin's segments by a broadcast of that bounded
table, and ranks are taken within bins, so that no task holds a shard.

Null keys count as the word ``null``; null texts have no bytes. Repeated rows are rows of
their own. An empty table gives an empty result. Extra columns pass through; helper names
are altered where they clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm import common

SHARDS, VNODES, SUBS = 24, 64, 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's points do not depend on the number of shards."""
    at = lambda s, v: int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16)
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def sweep(counts: dict[tuple[int, int], int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, sub, first rank, end rank, shard, first slot) of each run of rows, in clockwise order."""
    loads, out = [0] * len(room), []
    bins: dict[int, list[tuple[int, int]]] = {}
    for (arc, sub), n in sorted(counts.items()):
        bins.setdefault(arc, []).append((sub, n))
    for arc, subs in bins.items():
        j = arc
        for sub, n in subs:
            done = 0
            while done < n:
                shard = points[j % len(points)][1]
                take = min(n - done, room[shard] - loads[shard])
                if take:
                    out.append((arc, sub, done, done + take, shard, loads[shard]))
                    loads[shard] += take
                    done += take
                if done < n:
                    j += 1
    return out


def key_position(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def arc_of(position: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after ``position``, 0 beyond the last: a binary search over a literal array."""
    n, edges = len(points), F.lit([p for p, _ in points])
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    before = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda i, step: F.when((i + step <= n) & (F.get(edges, F.least(i + step, F.lit(n)) - 1) < position), i + step).otherwise(i),
    )
    return before % n


def shard_rows(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", crc: Column | None = None, size: Column | None = None, vnodes: int = VNODES, load: int | None = None) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (from 0, gapless in each shard); ``load``: rows a shard may hold, else evenly bounded.

    crc and size tell rows of equal keys apart; by default those of ``text``.
    """
    pos, arc, sub, rank, lo, hi, first, shard, slot = common.unused(df, "_pos", "_arc", "_sub", "_rank", "_lo", "_hi", "_first", "shard", "slot")
    points = ring(shards, vnodes)
    (own_crc, own_size) = common.unused(df, "_crc", "_size")
    df, columns = df.withColumns({own_crc: F.crc32(common.text_or_empty()) if crc is None else crc, own_size: F.octet_length("text") if size is None else size}), df.columns
    placed = df.withColumn(pos, key_position(F.col(key))).withColumn(arc, arc_of(F.col(pos), points)).withColumn(sub, F.pmod(F.col(own_crc), F.lit(SUBS)).cast("int"))
    counts = {(r[0], r[1]): r[2] for r in placed.groupBy(arc, sub).count().collect()}  # bounded: len(points) * SUBS
    total = sum(counts.values())
    room = [load] * shards if load else capacities(total, shards)
    if sum(room) < total:
        raise ValueError(f"{shards} shards of {load} rows cannot hold {total} rows")
    segments = df.sparkSession.createDataFrame(sweep(counts, points, room), f"`{arc}` int, `{sub}` int, `{lo}` long, `{hi}` long, `{shard}` int, `{first}` long")
    order = Window.partitionBy(arc, sub).orderBy(pos, key, own_crc, own_size)
    ranked = placed.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    return (
        ranked.join(F.broadcast(segments), [arc, sub])
        .where((F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
        .withColumn(slot, F.col(first) + F.col(rank) - F.col(lo))
        .select(*columns, shard, slot)
    )


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(common.text_or_empty()).alias("text_crc32"),
    )
    return shard_rows(docs, crc=F.col("text_crc32"), size=F.col("size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc_nibbles() -> list[int]:
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _oracle() -> str:
    points = ring(SHARDS)
    n = len(points)
    return f"""
with recursive base as (
  select doc_id, coalesce(octet_length(encode(text)), 0) + 8 as size, coalesce(text, '') as t, octet_length(encode(text)) as bytes,
    ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 8))::bigint as pos
  from documents),
crc as (
  select *, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(regexp_extract_all(hex(encode(t)), '..'),
      lambda b: [('0x' || b[2])::bigint, ('0x' || b[1])::bigint]))),
    lambda c, v: xor(({_crc_nibbles()}::bigint[])[(xor(c, v) & 15) + 1], c >> 4))) as text_crc32
  from base),
placed as (
  select *, text_crc32 % {SUBS} as sub,
    (len(list_filter({[p for p, _ in points]}::bigint[], lambda p: p < pos)) % {n})::int as arc
  from crc),
ranked as (
  select *, row_number() over (partition by arc order by sub, pos nulls first, doc_id nulls first, text_crc32, bytes nulls first) - 1 as rank from placed),
counts as (
  select list(coalesce(c, 0) order by a) as c, sum(coalesce(c, 0))::bigint as n
  from range({n}) r(a) left join (select arc, count(*) as c from placed group by arc) on arc = a),
room as (select list((n // {SHARDS}) + (case when s < n % {SHARDS} then 1 else 0 end) order by s) as room from counts, range({SHARDS}) q(s)),
walk as (
  select -1::bigint as arc, 0::bigint as j, 0::bigint as rest, list_transform(range({SHARDS}), lambda x: 0::bigint) as loads, 0::bigint as lo, 0::bigint as take, 0::int as shard, 0::bigint as first
  union all
  select arc, j + 1, rest - take, list_transform(loads, lambda l, i: case when i = shard + 1 then l + take else l end), lo, take, shard, loads[shard + 1]
  from (
    select *, least(rest, room[shard + 1] - loads[shard + 1]) as take from (
      select w.loads, room.room,
        case when w.rest > 0 then w.arc else w.arc + 1 end as arc,
        case when w.rest > 0 then w.j else w.arc + 1 end as j,
        case when w.rest > 0 then w.rest else c.c[w.arc + 2] end as rest,
        c.c[(case when w.rest > 0 then w.arc else w.arc + 1 end) + 1] - (case when w.rest > 0 then w.rest else c.c[w.arc + 2] end) as lo,
        ({[s for _, s in points]}::int[])[((case when w.rest > 0 then w.j else w.arc + 1 end) % {n}) + 1] as shard
      from walk w, counts c, room where w.rest > 0 or w.arc + 1 < {n})))
select doc_id, size, text_crc32, 'rows' as law, shard, first + rank - lo as slot, null::int as grown_shard
from ranked join (select * from walk where take > 0) w on ranked.arc = w.arc and rank >= lo and rank < lo + take
"""


QUERIES = {"op1_ring_sharding": op1_ring_sharding}
ORACLES = {"op1_ring_sharding": _oracle()}
