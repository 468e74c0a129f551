"""Benchmark decontamination with an FM-index per training shard.

Benchmark items are cut into windows of ``WINDOW`` consecutive words (an item of fewer words
is one window). A training shard is a stretch of documents of about ``SHARD_WORDS`` words of
one task. Its words are numbered by the benchmark's vocabulary; words that no item has
end a run, and runs shorter than the shortest window can hold none, so they are left
out without loss. The runs are put in an FM-index; all windows are sought backward through wavelet-tree
ranks, occurrences are located by sampled suffix positions, and spans are merged per document.

The benchmark reaches workers in blocks of at most ``BLOCK_BYTES`` of text, each broadcast within
that bound. A shard's words are split once and sought for one block after another, of which a worker keeps the windows
of ``KEPT`` at a time. Items are read from the driver one block at a time.

Null texts have no words; items without words (or null) have no windows; an item id that
is null is not listed, though its words are hit; repeated item ids count once. Repeated documents are
searched each. Empty tables work on either side. Bytes that are not UTF-8 are characters of words, and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common
from talus.llm.fmindex import FMIndex
from talus.llm.text import PLAIN, code_points, let_go, pieces, plain_words, raw_texts, text_column

WINDOW, SHARD_WORDS, BLOCK_BYTES = 10, 1_000_000, 2 << 20
KEPT = 2


class Phrases:
    """Windows of a block of items, as rows of word numbers by length, with the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for name, text in items:
            ids = [self.codes.setdefault(w, len(self.codes) + 1) for w in plain_words(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if ids else ():
                owners.setdefault(tuple(ids[i : i + size]), set()).add(name)
        self.by_length: dict[int, tuple[np.ndarray, list[set]]] = {}
        for size in sorted({len(k) for k in owners}):
            keys = sorted(k for k in owners if len(k) == size)
            self.by_length[size] = (np.array(keys, np.int64), [owners[k] - {None} for k in keys])

    def find(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each document: merged spans of hit words (start, end) and the items found."""
        out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in docs]
        ends = np.cumsum([len(d) for d in docs])
        if not self.by_length or not len(ends) or not ends[-1]:
            return out
        code = self.codes.get
        ids = np.fromiter((code(w, 0) for d in docs for w in d), np.int64, ends[-1])
        doc = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
        known = ids > 0
        begins = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1])))
        run = np.cumsum(begins)[known] - 1
        if not len(run):
            return out
        sizes = np.bincount(run)
        keep = (sizes >= min(self.by_length))[run]
        place = np.flatnonzero(known)[keep]  # places of words that stand in runs long enough
        if not len(place):
            return out
        run = run[keep]
        shift = np.concatenate(([0], np.cumsum(np.diff(run) != 0)))
        at = np.arange(len(place)) + shift
        text = np.zeros(at[-1] + 2, np.int64)
        text[at] = ids[place]
        back = np.zeros(len(text), np.int64)
        back[at] = place
        index = FMIndex(text, len(self.codes) + 1)
        steps = np.zeros(len(ids) + 1, np.int64)
        for size, (patterns, owners) in self.by_length.items():
            lo, hi = index.search(patterns)
            found = np.flatnonzero(hi > lo)
            n = (hi - lo)[found]
            rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            for i in range(0, len(rows), 1 << 20):
                start = back[index.locate(rows[i : i + (1 << 20)])]
                np.add.at(steps, start, 1)
                np.add.at(steps, start + size, -1)
                which = np.repeat(found, n)[i : i + (1 << 20)]
                for d, w in np.unique(np.stack((doc[start], which)), axis=1).T.tolist():
                    out[d][1].update(owners[w])
        hit = np.cumsum(steps[:-1]) > 0
        same = np.concatenate(([False], doc[1:] == doc[:-1]))
        starts = np.flatnonzero(hit & ~(np.concatenate(([False], hit[:-1])) & same))
        stops = np.flatnonzero(hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((same[1:], [False])))) + 1
        base = ends - np.diff(ends, prepend=0)
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            d = doc[a]
            out[d][0].append((a - int(base[d]), b - int(base[d])))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    block, size, some = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        n = len(r.t or b"")
        if block and size + n > most:
            yield block
            block, size, some = [], 0, True
        block.append((r.i, bytes(r.t) if r.t is not None else None))
        size += n
    if block or not some:
        yield block


class _Finder:
    """Finds the windows of all blocks; keeps the prepared windows of ``KEPT`` blocks at a time."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.ready = blocks, window, {}

    def phrases(self, k: int) -> Phrases:
        if k not in self.ready:
            if len(self.ready) >= KEPT:
                self.ready.clear()
            self.ready[k] = Phrases(self.blocks[k].value, self.window)
        return self.ready[k]

    def find(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        found = self.phrases(0).find(docs)
        for k in range(1, len(self.blocks)):
            found = [(merged([*a, *b]) if b else a, x | y) for (a, x), (b, y) in zip(found, self.phrases(k).find(docs), strict=True)]
        return found


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[tuple[pa.RecordBatch, list[bytes | None], list[list[bytes]]]]]:
    """Training shards: pieces of batches with their texts and words, which are split once for all blocks."""
    group, n = [], 0
    for part in pieces(batches, text):
        texts = raw_texts(part, text)
        words = [plain_words(t) for t in texts]
        group.append((part, texts, words))
        n += sum(map(len, words))
        if n >= SHARD_WORDS:
            yield group
            group, n = [], 0
    if group:
        yield group


def made(docs: DataFrame) -> list[str]:
    """Names of the columns that ``search`` adds: _n_words, _spans, _items, altered where docs has them."""
    return common.unused(docs, "_n_words", "_spans", "_items")


def _broadcast(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, block_bytes)]


def search(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``carry`` of docs with _n_words, _spans (flat: start, end, start, end ... in words) and _items, by the names that ``made`` gives."""
    names = made(docs)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]
    blocks = _broadcast(docs, benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(blocks, window)
        for group in _shards(batches, text):
            found = iter(finder.find([d for *_, words in group for d in words]))
            for part, _, words in group:
                own = [next(found) for _ in words]
                spans, items = [[x for ab in s for x in ab] for s, _ in own], [sorted(names) for _, names in own]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), pa.array([len(w) for w in words], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=[*carry, *names],
                )
            let_go()

    schema = ", ".join([*kept, f"{names[0]} long", f"{names[1]} array<int>", f"{names[2]} array<string>"])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def removed(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without its words in spans (from the first byte of a span's first word to the last of its last)."""
    plain = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], plain, [False])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = stops[b - 1]
    return b"".join([*out, raw[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (same columns) without the words of benchmark windows; a document that loses its last word goes, others stay.

    What a removal brings together is sought again, until no document holds a window. n_chars, where there, follows changed texts.
    """
    schema, names = docs.schema, docs.columns
    blocks = _broadcast(docs, benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(blocks, window)
        for group in _shards(batches, text):
            texts, words = [t for _, own, _ in group for t in own], [w for *_, own in group for w in own]
            todo, gone, changed = list(range(len(texts))), set(), set()
            while todo:
                found = finder.find([words[i] for i in todo])
                todo = [i for i, (s, _) in zip(todo, found, strict=True) if s]
                for i, s in zip(todo, (s for s, _ in found if s), strict=True):
                    texts[i] = removed(texts[i], s)
                    words[i] = plain_words(texts[i])
                changed.update(todo)
                gone.update(i for i in todo if not words[i])
                todo = [i for i in todo if words[i]]
            first = 0
            for part, own, _ in group:
                mine = range(first, first + len(own))
                first += len(own)
                if any(i in changed for i in mine):
                    at = names.index(text)
                    part = part.set_column(at, part.schema.field(at), text_column([texts[i] for i in mine], part.schema.field(at).type))
                    if "n_chars" in names:
                        at = names.index("n_chars")
                        sizes = [code_points(texts[i]) if i in changed else n for i, n in zip(mine, part.column(at).to_pylist(), strict=True)]
                        part = part.set_column(at, part.schema.field(at), pa.array(sizes, part.schema.field(at).type))
                    part = part.take(pa.array([k for k, i in enumerate(mine) if i not in gone], pa.int64()))
                yield part
            let_go()

    return docs.mapInArrow(run, schema)


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search(docs, common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_words, spans, items = (F.col(c) for c in made(docs))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.lit(0).cast("long"), lambda n, i: n + F.when(i == F.size(spans), F.lit(0)).when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)))
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"),
    )


ORACLE = f"""
with w as (
  select doc_id, rowid as row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from (select *, row_number() over () as rowid from documents)),
i as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from benchmark),
p as (
  select distinct item_id, least({WINDOW}, len(words)) as size, array_to_string(words[k:k + least({WINDOW}, len(words)) - 1], ' ') as phrase
  from (select *, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) as k from i where len(words) > 0)),
g as (
  select row, k, size, array_to_string(words[k:k + size - 1], ' ') as phrase
  from (select w.*, size, unnest(range(1, len(words) - size + 2)) as k from w cross join (select distinct size from p) s where len(words) >= size)),
h as (select row, k, g.size, item_id from g join p on g.phrase = p.phrase and g.size = p.size),
hit as (select row, count(distinct x) as n_hit from (select row, unnest(range(k, k + size)) as x from h) group by row),
its as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct row, item_id from h where item_id is not null) group by row)
select doc_id, coalesce(len(words), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (row) left join its using (row)
"""

QUERIES = {"op10_fm_decontamination": op10_fm_decontamination}
ORACLES = {"op10_fm_decontamination": ORACLE}
