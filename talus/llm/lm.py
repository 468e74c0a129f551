"""Language-model scoring: a gated recurrent model beside a unigram base.

1. One pass numbers the words of chunks of about ``CHUNK`` tokens and writes, in the shared
   folder, the chunks' documents as packed word numbers and their distinct words (64-bit hash, count in
   training texts, tail class). Words never travel as strings.
2. One shuffle of the chunks' words by hash gives the counts over all training tokens of the corpus, and the
   chunks that a word of several chunks goes back to; a word of one chunk has its count there. Counts fix
   the head vocabulary, the tail classes' masses, the unigram base and the model's first biases.
3. ``ROUNDS`` rounds of training: every chunk trains the common weights by truncated backpropagation on the next
   share of all its training documents, and the weights are averaged by an aggregation. The rounds together take
   every training token, whatever the size of the input; what reaches the driver is one set of weights a round.
4. Counts go back to the chunks, whose documents are scored whole, the recurrent state carried from start to end.

The model's probability of a tail word is that of its class times the share of its count (plus 0.1; all
unseen words of a class are one word of count 0.1), so that probabilities add up to 1.

Null and empty texts hold the end alone. A null doc_id is not held out. Repeated rows are
counted and scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm import common, gru
from talus.llm.text import let_go, pieces

CHUNK, ROUNDS, SMOOTH, SPREAD, GROUP = 2_000_000, 3, 0.1, 2, 4096
END = b""  # no word is empty
_PUNCTUATION = b".,;:!?\"')]}&$#*%|"


def word_hash(word: bytes) -> int:
    """Unsigned; columns hold it as a signed long."""
    return xxhash.xxh64_intdigest(word)


def tail_class(word: bytes) -> int:
    """By the last bytes of a word without its punctuation: endings tell languages apart."""
    if word and word[-1] < 65:
        word = word.rstrip(_PUNCTUATION)
    return zlib.crc32(word[-4:]) % gru.TAILS


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte in planes (small numbers leave empty planes), compressed."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Codes(dict):
    """Word numbers in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbered(raw: str, key: str):
    names = ["chunk", key, "held_out", "tokens", "first", "h", "n", "tail", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, codes, n, key_type = TaskContext.get().partitionId(), 0, _Codes({END: 0}), 0, pa.null()
        counts = np.zeros(1, np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            have = np.zeros(len(codes), np.int64)
            have[: len(counts)] = counts
            hashes = np.fromiter(map(word_hash, codes), np.uint64, len(codes)).view(np.int64)
            tails = np.fromiter(map(tail_class, codes), np.int16, len(codes))
            for i in range(0, len(codes), 1 << 16):
                h, c, t = hashes[i : i + (1 << 16)], have[i : i + (1 << 16)], tails[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 20) + seq]), pa.nulls(1, key_type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.array([i]),
                        pa.array([h], pa.list_(pa.int64())), pa.array([c.astype(np.int32)], pa.list_(pa.int32())), pa.array([t], pa.list_(pa.int16())), pa.array([packed(c)], pa.binary()),
                    ],
                    names=names,
                )

        for batch in pieces(batches, raw, 2 << 20):
            key_type, encoded, learned = batch.column(key).type, [], []
            for text, held in zip(batch.column(raw).to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                ids = list(map(codes.__getitem__, text.lower().split())) if text else []
                ids.append(0)
                ids = np.array(ids, np.int64)
                n += len(ids)
                if not held:
                    learned.append(ids)
                encoded.append(packed(ids))
            if learned:
                new = np.bincount(np.concatenate(learned), minlength=len(codes))
                new[: len(counts)] += counts
                counts = new
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 20) + seq] * k, pa.int64()), batch.column(key), batch.column("held_out"), pa.array(encoded, pa.binary()), pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int16())), pa.nulls(k, pa.binary()),
                ],
                names=names,
            )
            if n >= CHUNK:
                yield from words()
                codes, n, seq, counts = _Codes({END: 0}), 0, seq + 1, np.zeros(1, np.int64)
                let_go()
        if n:
            yield from words()
        codes.clear()
        let_go()

    return run


def _model_ids(shape: gru.Shape):
    """Stretches of a chunk's words as model numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [packed(shape.ids(h.values.to_numpy(), t.values.to_numpy().astype(np.int64))) for h, t in zip(b.column("h"), b.column("tail"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("first"), pa.array(made, pa.binary()), b.column("own")], names=["chunk", "first", "ids", "own"])

    return run


def _joined(words: pa.Table, column: str) -> np.ndarray:
    """A chunk's packed stretches end to end."""
    parts = sorted(zip(words.column("first").to_pylist(), words.column(column).to_pylist(), strict=True))
    return np.concatenate([unpacked(x) for _, x in parts]) if parts else np.zeros(0, np.int64)


def _lessons(_, left, right):
    """A chunk's training documents as model numbers."""
    texts = [unpacked(x) for x in left.column("tokens").to_pylist()]
    if not texts or not right.num_rows:
        return pa.table({"ids": pa.array([], pa.binary()), "ends": pa.array([], pa.binary())})
    ids = _joined(right, "ids")[np.concatenate(texts)]
    return pa.table({"ids": pa.array([packed(ids)], pa.binary()), "ends": pa.array([packed(np.cumsum([len(x) for x in texts]))], pa.binary())})


def _trainer(shape: gru.Shape, flat: np.ndarray, turn: int):
    like = shape.start()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, e in zip(b.column("ids").to_pylist(), b.column("ends").to_pylist(), strict=True):
                ids, ends = unpacked(x), unpacked(e)
                let_go()
                done = gru.train(shape, gru.unpack(flat, like), ids, ends, turn, ROUNDS)
                yield pa.RecordBatch.from_arrays([pa.array([gru.pack(done)], pa.list_(pa.float32())), pa.array([len(ids)], pa.int64())], names=["weights", "size"])

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs: ``key``, ``text`` and held_out (true: not learned from). Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    (raw,) = common.unused(docs, "_raw")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"chunk long, `{key}` {kind}, held_out boolean, tokens binary, first long, h array<long>, n array<int>, tail array<short>, own binary"
    where = f"{common.shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    docs.select(key, "held_out", F.col(text).cast("binary").alias(raw)).mapInArrow(_numbered(raw, key), schema).write.option("compression", "zstd").parquet(f"{where}/chunks")
    texts = spark.read.parquet(f"{where}/chunks").where("tokens is not null").select("chunk", key, "held_out", "tokens")
    lists = spark.read.parquet(f"{where}/chunks").where("h is not null").select("chunk", "first", "h", "n", "tail", "own")
    chunks = lists.select("chunk").distinct().count()
    n = max(1, SPREAD * chunks)  # chunks meet their words in as many tasks as there are chunks, or more
    place = (F.col("chunk") * (1 << 24) + F.col("first") + F.col("at")).alias("place")
    words = lists.select("chunk", "first", F.posexplode(F.arrays_zip("h", "n", "tail")).alias("at", "x")).select("chunk", place, "x.h", "x.n", "x.tail")
    # a word's places, one a chunk at most, stand in rows of about GROUP chunks; each row knows the whole word
    parts = -(-chunks // GROUP) or 1
    keys = ["h", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part")] if parts > 1 else ["h"]
    found = words.repartition("h").groupBy(*keys).agg(F.sum(F.col("n").cast("long")).alias("c"), F.min("tail").alias("tail"), F.collect_list("place").alias("places"))
    found = found.withColumns({"times": F.size("places"), "main": F.lit(True)})
    if parts > 1:
        word = Window.partitionBy("h")
        found = found.withColumns({"c": F.sum("c").over(word), "times": F.sum("times").over(word), "main": F.col("part") == F.min("part").over(word)})
    found.write.option("compression", "zstd").parquet(f"{where}/counts")
    counts = spark.read.parquet(f"{where}/counts")
    known = counts.where("c > 0 and main")
    head = known.select("h", "c", "tail").orderBy(F.desc("c"), "h").limit(gru.HEAD).collect()
    mass = {r.tail: (r.c, r.v) for r in known.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    total, kinds = sum(c for c, _ in mass.values()), sum(v for _, v in mass.values())
    rest, more = np.zeros(gru.TAILS), np.zeros(gru.TAILS)
    for t, (c, v) in mass.items():
        rest[t], more[t] = c - sum(r.c for r in head if r.tail == t), v - sum(1 for r in head if r.tail == t)
    shape = gru.Shape(np.array([r.h for r in head], np.int64), np.array([r.c for r in head], float), rest)
    flat = gru.pack(shape.start())
    named = common.cut(lists.select("chunk", "first", "h", "tail", "own").mapInArrow(_model_ids(shape), "chunk long, first long, ids binary, own binary"))
    of = lambda rows: rows.repartition(n, "chunk")
    taught = of(texts.where("not coalesce(held_out, false)").select("chunk", "tokens")).groupBy("chunk")
    lessons = common.cut(taught.cogroup(of(named.select("chunk", "first", "ids")).groupBy("chunk")).applyInArrow(_lessons, "ids binary, ends binary"))
    for turn in range(ROUNDS if total else 0):
        got = lessons.mapInArrow(_trainer(shape, flat, turn), "weights array<float>, size long")
        each = got.select("size", F.posexplode("weights").alias("at", "w")).groupBy("at").agg((F.sum(F.col("w") * F.col("size")) / F.sum("size")).alias("w"))
        new = {r.at: r.w for r in each.collect()}  # one set of weights
        flat = np.array([new[i] for i in range(len(flat))], np.float32) if new else flat
    tail_log = np.log(rest + SMOOTH * more + SMOOTH)
    base_log = float(np.log10(total + SMOOTH * (kinds + 1)))
    back = counts.where("times > 1").select("c", F.explode("places").alias("place"))
    back = back.select(F.shiftright("place", 24).alias("chunk"), F.col("place").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("w"), "c")
    shared = of(back).groupBy("chunk").agg(F.collect_list(F.struct("w", "c")).alias("found"))  # a chunk's own words at most
    meet = of(named).join(shared, "chunk", "left").select("chunk", "first", "ids", "own", F.when(F.col("first") == 0, F.col("found")).alias("found"))
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = of(texts).groupBy("chunk").cogroup(meet.groupBy("chunk")).applyInArrow(_scoring(shape, flat, tail_log, base_log, key), out)
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def _scoring(shape: gru.Shape, flat: np.ndarray, tail_log: np.ndarray, base_log: float, key: str):
    """tail_log: natural log of each tail class's smoothed mass; base_log: log10 of the base's denominator."""
    like = shape.start()

    def run(_, left, right):
        local, c = _joined(right, "ids"), _joined(right, "own").astype(np.float64)
        for cell in right.column("found"):
            if cell.is_valid:
                c[cell.values.field("w").to_numpy()] = cell.values.field("c").to_numpy()
        base, known, tail = np.log10(c + SMOOTH) - base_log, c > 0, local >= shape.n
        within = np.zeros(len(c))
        within[tail] = np.log(c[tail] + SMOOTH) - tail_log[local[tail] - shape.n]
        texts = [unpacked(x) for x in left.column("tokens").to_pylist()]
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        every = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        first = ends - np.diff(ends, prepend=0)
        bases, n_known, added = (np.add.reduceat(v[every], first) if texts else np.zeros(0) for v in (base, known.astype(np.int64), within))  # no text is without a token
        ids = local[every]
        model = gru.score(shape, gru.unpack(flat, like), ids, ends)
        let_go()
        return pa.table(
            {
                key: left.column(key), "held_out": left.column("held_out"), "n_tokens": pa.array(np.diff(ends, prepend=0), pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(bases, pa.float64()), "score": pa.array((model + added) / np.log(10), pa.float64()),
            }
        )

    return run


def op7_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op7_gru_scores": op7_gru_scores}
ORACLES: dict[str, str] = {}
