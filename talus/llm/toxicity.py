"""Toxic passages by maximum-scoring segments.

Weights: log-odds of a word in toxic against other texts, with a Dirichlet prior of ``PRIOR`` times
the pooled counts (texts that have the word count, not occurrences), kept where the z-score of
the difference is ``Z`` or more either way. Words without a weight of their own take that of their longest
prefix that has one (6, 5 or 4 bytes); any other word costs ``NEUTRAL``.

Scan: all maximal segments of the word scores (Ruzzo and Tompa's rule) in time linear in
the words: each kept segment points to the nearest one before it that starts from a lower sum. Calibration: segment scores of texts that are not toxic follow an extreme-value law;
its lambda solves ``sum p(s) exp(lambda s) = 1`` over their words' scores, and K is the likelihood
estimate from their best segments. A text's evidence is the sum over its segments of
``lambda S - ln(K n)`` where positive; a logistic curve, fitted on the labelled rows, turns it
into a score from 0 to 1.

Fitting reads at most ``BOUND`` labelled rows (those of the smallest hashes of doc_id), so
what is collected and broadcast has a fixed bound; scoring covers whole texts of all rows.

Several labels of one document count as toxic if one is; null labels and labels without a
document are left out. Without labels of both kinds no word has a weight. Null and empty
texts have no words and get the score of no evidence. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common
from talus.llm.text import let_go, pieces, plain_words, raw_texts

BOUND, PRIOR, Z, NEUTRAL, REJECT, PREFIXES = 20_000, 0.1, 3.0, 0.25, 0.7, (6, 5, 4)
CACHE = 150_000


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.01
    slope: float = 0.0
    offset: float = -2.0

    def weight(self, word: bytes) -> float:
        w = self.weights.get(word)
        for n in PREFIXES:
            if w is not None:
                break
            w = self.weights.get(word[:n] + b"*") if len(word) > n else None
        return -NEUTRAL if w is None else w


def features(words: list[bytes]) -> set[bytes]:
    return {*words, *(w[:n] + b"*" for w in words for n in PREFIXES if len(w) > n)}


def segments(scores: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score); scores: (word's place, weight) of the words that aren't neutral."""
    kept: list[list] = []  # first, last, sum before, sum after, nearest place in kept of a smaller sum before (or -1)
    total, last = 0.0, -1
    for at, w in scores:
        total -= NEUTRAL * (at - last - 1)
        last = at
        before, total = total, total + w
        if w <= 0:
            continue
        new, j = [at, at, before, total, -1], len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]  # what lies between starts no lower
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new, next_j = [kept[j][0], at, kept[j][2], total, -1], kept[j][4]
            del kept[j:]
            j = next_j
    return [(a, b, after - before) for a, b, before, after, _ in kept]


class Scanner:
    """Scans texts with a model; keeps the weights of words met, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.met = model, {}

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        words, met, scores = plain_words(text), self.met, []
        if len(met) > CACHE:
            met.clear()
        for at, w in enumerate(words):
            s = met.get(w)
            if s is None:
                s = met[w] = self.model.weight(w)
            if s != -NEUTRAL:
                scores.append((at, s))
        return len(words), segments(scores)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        least = math.log(max(1.0, self.model.k * n))
        return sum(max(0.0, self.model.lam * s - least) for _, _, s in found)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.model.offset + self.model.slope * math.log1p(evidence)))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for part in pieces(batches, "raw"):
        for text, toxic in zip(part.column("raw").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(features(plain_words(text)))
    names = list(counts[0] | counts[1])
    for i in range(0, len(names), 50_000):
        some = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([counts[k][x] for x in some], pa.int64()) for k in (1, 0))], names=["feature", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), already without rows that may not be learned from."""
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(F.broadcast(sample), "doc_id")
    rows = common.cut(rows.groupBy("raw").agg(F.max("toxic").alias("toxic")))  # equal texts count once
    counts = common.cut(rows.mapInArrow(_counts, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")))
    nt, nc = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    model = Model()
    if not nt or not nc:
        return model
    a, a0 = PRIOR * (F.col("t") + F.col("c")), PRIOR * (nt + nc)
    odds = lambda y, n: F.log((y + a) / (n + a0 - y - a))
    delta = odds(F.col("t"), nt) - odds(F.col("c"), nc)
    z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    learned = counts.select("feature", "c", delta.alias("w"), z.alias("z")).where(F.abs("z") >= Z).orderBy("feature").collect()
    model.weights = {bytes(r.feature): r.w for r in learned}
    # words that tell nothing more than a longer-known prefix stay as they are; what is left out is neutral
    share = {bytes(r.feature): (r.c + 0.5) / (nc + 1) for r in learned}
    s, p = np.array([model.weights[x] for x in share]), np.array(list(share.values()))
    if len(s) and (s > 0).any():
        rest, lo, hi = max(0.0, 1 - p.sum()), 1e-3, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            above = np.log(p).max() + mid * s.max() > 300 or (p * np.exp(np.minimum(mid * s, 300))).sum() + rest * math.exp(-mid * NEUTRAL) > 1
            lo, hi = (lo, mid) if above else (mid, hi)
        model.lam = lo
    got = [(n, best, list(found), t) for n, best, found, t in _scanned(rows, model)]
    clean = [(n, best) for n, best, _, t in got if not t and n]
    if clean:
        model.k = min(1.0, len(clean) / max(1e-9, sum(n * math.exp(-model.lam * best) for n, best in clean)))
    scanner = Scanner(model)
    x = np.log1p([scanner.evidence(n, [(0, 0, f) for f in found]) for n, _, found, _ in got])
    y = np.array([t for *_, t in got], float)
    model.offset, model.slope = _logistic(x, y)
    return model


def _scanned(rows: DataFrame, model: Model) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for part in pieces(batches, "raw"):
            got = [scanner.scan(x) for x in part.column("raw").to_pylist()]
            found = [[s for *_, s in f] for _, f in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in got], pa.int64()), pa.array([max(f, default=0.0) for f in found], pa.float64()), pa.array(found, pa.list_(pa.float64())), part.column("toxic")],
                names=["n", "best", "found", "toxic"],
            )

    return rows.mapInArrow(run, "n long, best double, found array<double>, toxic int").collect()  # BOUND rows at most


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope (not below 0) by Newton's method with a small penalty on the slope."""
    a, b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = (y - p).sum(), ((y - p) * x).sum() - ridge * b
        haa, hab, hbb = w.sum() + 1e-9, (w * x).sum(), (w * x * x).sum() + ridge
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, max(0.0, b)


def made(df: DataFrame) -> list[str]:
    """Names of the columns that ``score`` adds: toxicity and passages, altered where ``df`` has them."""
    return common.unused(df, "toxicity", "passages")


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with toxicity (0 to 1) and passages, the significant segments by word places; their names as ``made`` gives them."""
    own = list(carry or df.columns)
    names = made(df)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema), f"{names[0]} double, {names[1]} array<struct<first:int,last:int,score:double>>"])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for part in pieces(batches, text):
            scores, found = [], []
            for x in raw_texts(part, text):
                n, all_found = scanner.scan(x)
                scores.append(scanner.score(scanner.evidence(n, all_found)))
                found.append([{"first": a, "last": b, "score": s} for a, b, s in all_found if scanner.evidence(n, [(a, b, s)]) > 0])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*own, *names])
            let_go()

    return df.select(*dict.fromkeys([*own, text])).mapInArrow(run, schema)


def _remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the rows that may be learned from: remainder of crc32(doc_id) by 3 not 1."""
    return fit(docs, labels.where(_remainder() != 1))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, carry=["doc_id"]).select(
        "doc_id",
        F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


QUERIES = {"op2_toxic_segments": op2_toxic_segments}
ORACLES: dict[str, str] = {}
