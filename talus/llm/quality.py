"""Quality rules by repetition coverage.

Word sequences are numbered, and rolling polynomial hashes over the numbers (prefix sums
times inverse powers, modulo 2^64) find the word windows of several lengths that a text
repeats. A window that repeats at one length starts with windows that repeat at every
smaller length, so only the starts that repeat go on to the next length; equal hashes are
compared word by word. A text is rejected if repeats (first occurrences not counted) hold
more than ``LIMITS`` of its word characters, or repeated lines more than their limits.

Null and empty texts have no words, hence fail the base rule. Bytes that are not UTF-8 count as the characters that
they start. Repeated rows are judged each for itself; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common
from talus.llm.text import code_points, pieces, spaced_words

#: Share of word characters inside repeated windows of so many words.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
BASE_WINDOW, BASE_LEAST, BASE_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
BASE = 0x9E3779B97F4A7C15
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_share double, line_char_share double, repeat_shares array<double>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def repeated(ids: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: starts of windows found twice or more in their text, and those of them that are not the first.

    ids: word numbers of texts laid end to end; ends: where each text ends.
    """
    n = len(ids)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    end = ends[doc] if n else np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(ids) * _powers(BASE, n), out=sums[1:])
    back, salt = _powers(pow(BASE, -1, 1 << 64), n), _mixed(doc + (1 << 40))
    starts = np.arange(n)
    for k in lengths:
        starts = starts[starts + k <= end[starts]]
        keys = (sums[starts + k] - sums[starts]) * back[starts] ^ salt[starts]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        pair = np.flatnonzero(keys[1:] == keys[:-1])
        a, b = starts[order[pair]], starts[order[pair + 1]]
        same = doc[a] == doc[b]
        for i in range(k):
            same &= ids[a + i] == ids[b + i]
        if not same.all():  # different windows of one hash: told apart exactly
            later, found = [], {}
            for s in starts.tolist():
                found.setdefault((doc[s], *ids[s : s + k].tolist()), []).append(s)
            groups = [g for g in found.values() if len(g) > 1]
            starts, later = np.array(sorted(s for g in groups for s in g), np.int64), np.array(sorted(s for g in groups for s in g[1:]), np.int64)
        else:
            starts, later = np.union1d(a, b), np.sort(b)
        yield k, starts, later


def _covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[ends] - run[np.concatenate(([0], ends[:-1]))]


def measure(texts: list[bytes | None]) -> dict[str, list]:
    """The columns of FIELDS for texts."""
    codes: dict[bytes, int] = {}
    ids, ends, symbols, lines = [], [], [], []
    for text in texts:
        ids += [codes.setdefault(w, len(codes)) for w in spaced_words(text)]
        ends.append(len(ids))
        text = text or b""
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        seen, dup, n, dup_chars, chars = set(), 0, 0, 0, 0
        for line in text.split(b"\n"):
            if line and not line.isspace():
                n += 1
                size = code_points(line)
                chars += size
                if line in seen:
                    dup += 1
                    dup_chars += size
                else:
                    seen.add(line)
        lines.append((dup, n, dup_chars, chars))
    ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
    size = np.array([code_points(w) for w in codes], np.int64)[ids] if len(ids) else ids
    n_words, chars = np.diff(ends, prepend=0), _per_text(size, ends)
    repeat, shares, kept = np.zeros(len(texts), np.int64), [], np.ones(len(texts), bool)
    for k, every, later in repeated(ids, ends, tuple(LIMITS)):
        if k == BASE_WINDOW:
            repeat = _per_text(_covered(len(ids), every, k), ends)
        shares.append(_per_text(size * _covered(len(ids), later, k), ends) / np.maximum(chars, 1))
        kept &= shares[-1] <= LIMITS[k]
    dup, n, dup_chars, all_chars = np.array(lines, np.int64).reshape(-1, 4).T
    line_share, line_char_share = dup / np.maximum(n, 1), dup_chars / np.maximum(all_chars, 1)
    failed = (n_words < BASE_LEAST) | (100 * repeat > BASE_PERCENT * n_words)
    kept &= (line_share <= LINE_SHARE) & (line_char_share <= LINE_CHAR_SHARE) & ~failed
    columns = (n_words, chars, np.array(symbols), dup, repeat, failed, kept, line_share, line_char_share, np.array(shares).T)
    return {f.split()[0]: x.tolist() for f, x in zip(FIELDS.split(", "), columns, strict=True)}


def judge(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``carry``) with the columns of FIELDS; of the same names, the measured ones stay."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    own = [c for c in carry or df.columns if c.lower() not in names]
    (raw,) = common.unused(df, "_raw")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema] + [FIELDS])
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, raw):
            got = measure(part.column(raw).to_pylist())
            made = [pa.array(got[n], types[f.split()[1]]) for n, f in zip(names, FIELDS.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in own] + made, names=[*own, *names])

    return df.select(*own, F.col(text).cast("binary").alias(raw)).mapInArrow(run, schema)


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, carry=["doc_id"]).drop("repeat_shares", "line_share", "line_char_share")


ORACLE = f"""
with d as (select *, row_number() over () as row, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as (select row, i, length(words[i]) as size from (select row, words, unnest(range(1, len(words) + 1)) as i from d)),
g as (
  select row, k, i, count(*) over s as times, row_number() over (partition by row, k, phrase order by i) as nth
  from (
    select row, k, i, array_to_string(words[i:i + k - 1], ' ') as phrase
    from (select row, words, k, unnest(range(1, len(words) - k + 2)) as i from d, (values {", ".join(f"({k})" for k in LIMITS)}) t(k) where len(words) >= k))
  window s as (partition by row, k, phrase)),
hit as (select distinct row, k, unnest(range(i, i + k)) as i, false as later from g where times > 1 and k = {BASE_WINDOW}),
late as (select distinct row, k, unnest(range(i, i + k)) as i from g where nth > 1),
covered as (select row, k, sum(size) as chars from late join w using (row, i) group by row, k),
l as (
  select row, length(line) as size, row_number() over (partition by row, line order by k) > 1 as dup
  from (select row, k, parts[k] as line from (select row, parts, unnest(range(1, len(parts) + 1)) as k from (select row, string_split(text, chr(10)) as parts from d)))
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
s as (
  select d.row, d.doc_id, len(words) as n_words, coalesce((select sum(size) from w where w.row = d.row), 0)::bigint as word_chars,
    coalesce(length(text) - length(regexp_replace(text, '[{SYMBOLS.decode()}]', '', 'g')), 0) as n_symbols
  from d),
f as (
  select s.*, coalesce(n_dup, 0) as n_dup_lines, coalesce(n_hit, 0) as n_repeat_words,
    coalesce(n_dup / n_lines, 0) as line_share, coalesce(dup_chars / line_chars, 0) as line_char_share
  from s left join (select row, count(*) as n_hit from hit group by row) using (row)
    left join (select row, count(*) as n_lines, count(*) filter (dup) as n_dup, sum(size) as line_chars, coalesce(sum(size) filter (dup), 0) as dup_chars from l group by row) using (row)),
b as (
  select row, bool_or(chars / word_chars > bound) as much
  from covered join s using (row) join (values {", ".join(f"({k}, {v}::double)" for k, v in LIMITS.items())}) t(k, bound) using (k) group by row),
v as (select *, n_words < {BASE_LEAST} or 100 * n_repeat_words > {BASE_PERCENT} * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(much, false) and line_share <= {LINE_SHARE}::double and line_char_share <= {LINE_CHAR_SHARE}::double as kept
from v left join b using (row)
"""

QUERIES = {"op4_repetition_rules": op4_repetition_rules}
ORACLES = {"op4_repetition_rules": ORACLE}
