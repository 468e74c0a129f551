"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprint bits are set by majority over hashes of a text's word shingles: XXH64, and for longer fingerprints
further words mixed from it. Texts of one fingerprint are one node. Bits that vary together (correlations
over all fingerprints) are grouped into partitions; thresholds per partition, which must add up to ``tau - parts + 1`` (-1: not
probed), are allotted by dynamic programming on probe rows and candidate counts estimated from the partitions' value
counts and bit frequencies. Where the number of partitions is open, the programme takes the cheapest. Fingerprints within
``tau`` bits then meet in at least one partition; they are probed by equal keys and verified within the join.

``grouped``: 64 bits, links at ``TAU`` bits or fewer. Keys that more than ``CROWD`` rows share do not form pairs. Their
fingerprints are linked exactly by centres: two of them differ in at most two bits if and only if flipping one bit or
none in each gives a common value, which 65 fingerprints at most can share.

``keep_one``: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. Such texts differ
in about 15 % of the bits, too many for a bound that the pigeonhole principle could hold, so fingerprints have ``WORDS`` x 64
bits in ``PARTS`` partitions: texts that differ in fewer bits than there are partitions always meet, others with a
chance that the number of partitions makes high (measured in README). What meets and differs in few of the first
``CHECKED`` words' bits (in crowded keys, of all bits) is verified on the shingle sets themselves. Members of a crowded key meet the one of
them that is in most crowded keys, and after that all members that these links have not brought into one component, so that no
key drops a pair.

Null and empty texts have the fingerprint zero, which is linked like any other; they are one group. Repeated
rows are nodes' members each. An empty table gives an empty result. Null keys are members too; a component of
null keys alone has a null id. Extra columns pass through ``keep_one``; its own names give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common
from talus.llm.text import let_go, pieces
from talus.plans.components import components

BITS, TAU, CROWD, SEED, SHINGLE = 64, 2, 128, 42, 3
#: Of ``keep_one``: percent of shingles in common, words in a shingle, 64-bit words of a fingerprint and of its checked part, most bits that differ there and, in crowded keys, in all words (the mean at that similarity and 1.8 standard deviations); together they find 9 in 10 pairs that are just alike enough.
ALIKE, STAGE_SHINGLE, WORDS, PARTS, CHECKED, CHECK_BITS, ALL_BITS = 80, 5, 14, 50, 4, 49, 155
FEW = 1 << 16  # keys or ids that are broadcast: 2 MB
PAIR = 0.02  # cost of a candidate, which is compared where it is met, against that of a probe row, which is shuffled
_LANES = np.uint64(0x0001000100010001)


def shingles(text: bytes | None, size: int) -> list[int]:
    """XXH64 of a whole text's word shingles, in order."""
    words = text.lower().split() if text else []
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes)
    starts = (stops - sizes)[:n].tolist()
    stops = (stops[-n:] - 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``counts`` (above 0) hashes: the bits that are set in over half of them."""
    most = (1 << 16) - 1  # what a lane holds
    runs = -(-counts // most)
    whole = np.repeat(np.arange(len(counts)), runs)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(runs) - runs, runs)
    first = (np.cumsum(counts) - counts)[whole] + nth * most
    head = np.cumsum(runs) - runs
    out = np.zeros(len(counts), np.uint64)
    for s in range(16):
        sums = np.add.reduceat(hashes >> np.uint64(s) & _LANES, first)
        for lane in range(4):
            ones = np.add.reduceat((sums >> np.uint64(16 * lane) & np.uint64(most)).astype(np.int64), head)
            out |= (2 * ones > counts).astype(np.uint64) << np.uint64(s + 16 * lane)
    return out


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, words: int = 1, distinct: bool = False) -> np.ndarray:
    """(texts, words) unsigned 64-bit words of the fingerprints of whole texts; distinct: a shingle counts once."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = shingles(text, shingle)
        own = list(set(own)) if distinct else own
        counts[i] = len(own)
        hashes += own
    out = np.zeros((len(texts), words), np.uint64)
    full = counts > 0
    if hashes:
        h = np.array(hashes, np.uint64)
        for w in range(words):
            out[full, w] = _majority(h, counts[full])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return out


def _columns(words: int) -> list[str]:
    return ["fp"] if words == 1 else [f"fp{w}" for w in range(words)]


def fingerprinted(df: DataFrame, carry: list[str], text: str = "text", shingle: int = SHINGLE, words: int = 1, distinct: bool = False) -> DataFrame:
    """Columns ``carry`` of ``df`` and the fingerprint's words as signed longs ``fp`` or ``fp0``, ``fp1`` ..."""
    (raw,) = common.unused(df, "_raw")
    names = _columns(words)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema), *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, raw, 1 << 20):
            fp = fingerprints(part.column(raw).to_pylist(), shingle, words, distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(x) for x in fp.T.copy())], names=[*carry, *names])
            let_go()

    return df.select(*carry, F.col(text).cast("binary").alias(raw)).mapInArrow(run, schema)


def bit_statistics(fps: DataFrame, names: list[str]) -> np.ndarray:
    """How many fingerprints have bits i and j, for all i, j."""
    bits = BITS * len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits))
        for batch in batches:
            fp = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            for i in range(0, len(fp), 1 << 13):
                some = np.unpackbits(np.ascontiguousarray(fp[i : i + (1 << 13)]).view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little").astype(np.float32)
                total += some.T @ some
        yield pa.RecordBatch.from_arrays([pa.array(range(bits), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["bit", "n"])

    def added(table):  # no type hints: they would choose another form of call
        n = sum(np.frombuffer(x, np.float64) for x in table.column("n").to_pylist())
        return pa.table({"bit": table.column("bit")[:1], "n": pa.array([n.tobytes()], pa.binary())})

    out = np.zeros((bits, bits))
    few = fps.select(*names).coalesce(max(1, fps.sparkSession.sparkContext.defaultParallelism))  # a matrix a task
    for r in few.mapInArrow(sums, "bit int, n binary").groupBy("bit").applyInArrow(added, "bit int, n binary").collect():  # a row a bit
        out[r.bit] = np.frombuffer(r.n)
    return out


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size, each bit beside those that it correlates with most."""
    bits = len(both)
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, groups = np.ones(bits, bool), []
    for i in range(parts):
        size = bits // parts + (i < bits % parts)
        near = np.where(left, np.where(left[None, :], r, 0).max(axis=1), -1.0)
        group = [int(near.argmax())]
        left[group[0]] = False
        total = r[group[0]].copy()
        while len(group) < size:
            b = int(np.where(left, total, -1.0).argmax())
            group.append(b)
            left[b] = False
            total += r[b]
        groups.append(sorted(group))
    return groups


def allot(widths: list[int], same: list[float], differ: list[list[float]], n: int, tau: int = TAU, most: int = TAU) -> tuple[float, list[int]]:
    """The least cost and its thresholds per partition (``most`` at most), which add up to tau - parts + 1.

    same: pairs of one value, per partition; differ: chances that two fingerprints differ in each of its bits.
    """
    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        ratios, sym = [q / max(1e-9, 1 - q) for q in differ[i]], [1.0] + [0.0] * t
        for x in ratios:
            for k in range(t, 0, -1):
                sym[k] += sym[k - 1] * x
        return n * sum(comb(widths[i], k) for k in range(t + 1)) + PAIR * same[i] * sum(sym)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        nxt: dict[int, tuple[float, list[int]]] = {}
        costs = [cost(i, t) for t in range(-1, most + 1)]
        for total, (c, ts) in best.items():
            for t in range(-1, most + 1):
                got = (c + costs[t + 1], [*ts, t])
                if total + t not in nxt or got < nxt[total + t]:
                    nxt[total + t] = got
        best = nxt
    return best[tau - len(widths) + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(words: int, bits: tuple[int, ...] | list[int]) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    for b in bits:
        out[b // BITS] |= np.uint64(1) << np.uint64(b % BITS)
    return out


def _hashed(fp: np.ndarray, part: int) -> np.ndarray:
    """A 64-bit hash of rows of words, by partition; what hashes bring together is verified like all else."""
    h = np.full(len(fp), part + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w in range(fp.shape[1]):
        h = (h ^ fp[:, w]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _keyed(fps: DataFrame, names: list[str], carry: list[str], probes: list[tuple[int, list[int], tuple[int, ...]]]) -> DataFrame:
    """probe (place in ``probes``), key and columns ``carry``, a row for each fingerprint and probe (partition, its bits, those flipped)."""
    masks = [(part, _masks(len(names), bits), _masks(len(names), flip)) for part, bits, flip in probes]
    used = [(part, np.flatnonzero(m), m, f) for part, m, f in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(i, 1 << 12)
                fp = np.stack([part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in names], axis=1)
                keys = np.concatenate([_hashed((fp[:, w] & m[w]) ^ f[w], k) for k, w, m, f in used])
                place, row = np.repeat(np.arange(len(used), dtype=np.int32), len(fp)), np.tile(np.arange(len(fp)), len(used))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(keys.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in carry)], names=["probe", "key", *carry])

    return fps.select(*dict.fromkeys([*names, *carry])).mapInArrow(run, ", ".join(["probe int, key long", *(f"{c} long" for c in carry)]))


def _plan(fps: DataFrame, names: list[str], tau: int, choices: list[int], most: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, for the cheapest number of partitions among ``choices``."""
    n = fps.count()
    both = bit_statistics(fps, names)
    grouped = {m: group_bits(both, n, m) for m in choices}
    places = [(m, i) for m, groups in grouped.items() for i in range(len(groups))]
    rows = _keyed(fps, names, [], [(k, grouped[m][i], ()) for k, (m, i) in enumerate(places)]).groupBy("probe", "key").count()
    same = {places[r.probe]: r.pairs for r in rows.groupBy("probe").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    plans = [
        (*allot([len(g) for g in groups], [same.get((m, i), 0.0) for i in range(m)], [[2 * p[b] * (1 - p[b]) for b in g] for g in groups], n, tau, most), groups)
        for m, groups in grouped.items()
    ]
    _, thresholds, groups = min(plans, key=lambda x: x[0])
    return groups, thresholds


def _probed(fps: DataFrame, names: list[str], carry: list[str], groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """key, own and columns ``carry``: own keys of all fingerprints, and those of their neighbours within the partitions' thresholds."""
    probes = [(i, g, flip) for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)) for k in range(t + 1) for flip in combinations(g, k)]
    own = [k for k, (_, _, flip) in enumerate(probes) if not flip]
    rows = _keyed(fps, names, carry, probes)
    return rows.select("key", (F.lit(True) if len(own) == len(probes) else F.col("probe").isin(own)).alias("own"), *carry)


def links(fps: DataFrame, crowd: int = CROWD, choices: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` within TAU bits, directly or by others.

    With more than TAU + 1 partitions thresholds would have to be below -1 on the whole, so ``choices`` end there.
    """
    groups, thresholds = _plan(fps, ["fp"], TAU, list(choices), TAU)
    rows = _probed(fps, ["fp"], ["fp"], groups, thresholds)
    crowded = common.small(common.cut(rows.groupBy("key").count().where(F.col("count") > crowd).select("key")), FEW)
    few = rows.join(crowded, "key", "left_anti")
    one, two = few.where("own").select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU
    # a pair of thresholds 0 comes from both sides; one order is enough, but with flips either side may be the prober
    pairs = one.join(two, "key").where(near & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    crowd_fps = rows.join(crowded, "key", "left_semi").select("fp").distinct()
    centres = crowd_fps.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)))).alias("centre"))
    stars = centres.groupBy("centre").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    star = stars.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.union(star).distinct()


def grouped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows: ``key`` and fp. Adds component_id, the smallest ``key`` that links reach (null if all are null)."""
    fps = common.cut(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(fps.select("fp")))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root").drop("root"), "fp")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of (id, raw): the distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "raw", 1 << 20):
            own = [np.unique(np.array(shingles(x, shingle), np.uint64)).view(np.int64) for x in part.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) whose sets have ``alike`` percent or more of their shingles in common."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    n, m = F.size("x"), F.size("y")
    possible = 100 * F.least(n, m) >= alike * F.greatest(n, m)
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(one, "a").join(two, "b").where(possible)
    return met.where(100 * both >= alike * (n + m - both)).select("a", "b")


def candidates(nodes: DataFrame, crowd: int = CROWD, words: int = WORDS, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (id and fingerprint words) that meet and pass the check, a above b; and crowded rows (key, id, fingerprint words)."""
    names = _columns(words)
    groups, thresholds = _plan(nodes, names, parts - 1, [parts], 1)
    checked = names[:CHECKED]
    rows = _probed(nodes, names, ["id", *checked], groups, thresholds)
    crowded = common.small(common.cut(rows.groupBy("key").count().where(F.col("count") > crowd).select("key")), FEW)
    few = rows.join(crowded, "key", "left_anti")
    many = common.cut(rows.join(crowded, "key", "left_semi").select("key", "id").distinct().join(nodes.select("id", *names), "id"))
    if max(thresholds) > 0:
        once = (F.col("x.id") > F.col("y.id")) | (~F.col("y.own") & (F.col("x.id") != F.col("y.id")))  # own keys of both meet both ways
        pairs = _near(few.where("own"), few, checked, CHECK_BITS, once)
    else:  # own keys alone: both sides are one shuffle
        few = few.drop("own")
        pairs = _near(few, few, checked, CHECK_BITS, F.col("x.id") > F.col("y.id"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held = many.groupBy("id").agg(F.count("*").alias("held"))
    pivot = many.join(held, "id").groupBy("key").agg(F.max_by(F.struct("id", *names), F.struct(F.col("held"), -F.col("id"))).alias("p")).select("key", "p.*")
    hubs = _near(many, pivot, names, ALL_BITS, F.col("x.id") != F.col("y.id")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return common.cut(pairs.union(hubs).distinct()), many


def _near(one: DataFrame, two: DataFrame, checked: list[str], most: int, rule: Column) -> DataFrame:
    """(a, b): ids of rows x of one and y of two that share a key, keep the rule and differ in ``most`` bits of the checked words or fewer."""
    bits = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in checked[1:]), F.bit_count(F.col(f"x.{checked[0]}").bitwiseXOR(F.col(f"y.{checked[0]}"))))
    met = one.alias("x").join(two.alias("y"), (F.col("x.key") == F.col("y.key")) & rule & (bits <= most))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def similar(nodes: DataFrame, texts, shingle: int = STAGE_SHINGLE, alike: int = ALIKE, crowd: int = CROWD) -> DataFrame:
    """(node, root) of the nodes (id and fingerprint words) that have links; texts gives the texts (id, raw) of nodes whose ids (id) it gets."""
    pairs, many = candidates(nodes, crowd)
    involved = pairs.select("a").union(pairs.select("b")).union(many.select("id")).distinct().withColumnRenamed("a", "id")
    sets = common.cut(_sets(texts(common.cut(involved)), shingle))
    edges = common.cut(_alike(pairs, sets, alike))
    roots = common.cut(components(edges))
    if many.limit(1).count():  # what hubs have not linked in crowded keys
        own = many.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        mixed = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        own = common.cut(own.join(mixed, "key", "left_semi"))
        rest = _near(own, own, _columns(WORDS), ALL_BITS, F.col("x.root") > F.col("y.root"))
        more = _alike(common.cut(rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), sets, alike)
        of = own.select("id", "root").distinct()
        more = more.join(of.toDF("a", "p"), "a").join(of.toDF("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
        higher = components(more)  # of components
        moved = roots.join(higher.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = moved.union(higher.join(roots, "node", "left_anti"))  # nodes that had no link before
    return roots


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row of each group of near-duplicates: the smallest key, of those the smallest hash of the row."""
    mark, k, m = common.unused(docs, "_mark", "_k", "_m")
    names = _columns(WORDS)
    marked = docs.withColumn(mark, F.xxhash64(*docs.columns))
    own = marked.select(F.col(key).alias("k"), F.col(mark).alias("m"), F.col(text).alias("text"))
    rows = common.cut(fingerprinted(own, ["k", "m"], shingle=STAGE_SHINGLE, words=WORDS, distinct=True))
    first = rows.groupBy(*names).agg(F.min(F.struct("k", "m")).alias("first"))
    nodes = common.cut(first.withColumn("id", F.monotonically_increasing_id()))

    def texts(ids: DataFrame) -> DataFrame:
        one = nodes.join(common.small(ids, FEW), "id", "left_semi").select("id", F.col("first.k").alias("k_"), F.col("first.m").alias("m_"))
        # rows of one key and hash are equal rows, so either text is the node's
        found = own.join(common.small(common.cut(one), FEW), F.col("k").eqNullSafe(F.col("k_")) & (F.col("m") == F.col("m_")))
        return found.select("id", F.col("text").cast("binary").alias("raw")).dropDuplicates(["id"])

    roots = similar(nodes.select("id", *names), texts, crowd=crowd)
    named = nodes.select("id", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = common.cut(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias(k), F.col("first.m").alias(m)))
    chosen = common.small(chosen, FEW)
    kept = marked.join(chosen, marked[key].eqNullSafe(chosen[k]) & (marked[mark] == chosen[m]), "left_semi").drop(mark)
    twice = rows.groupBy("k", "m").count().where("count > 1").join(chosen, F.col("k").eqNullSafe(F.col(k)) & (F.col("m") == F.col(m)), "left_semi")
    return kept.dropDuplicates() if twice.limit(1).count() else kept


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = common.cut(fingerprinted(docs, ["doc_id"]))
    return grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_groups": op8_simhash_groups}
ORACLES: dict[str, str] = {}
