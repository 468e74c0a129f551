"""Nulls, ties, repeated rows, long texts, clashing names, and models against plain restatements."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import gru, htmltext, linededup, lm, quality, sharding, simhash, toxicity


def slow_labels(found):
    """Both passes, each ambiguous block looking outward by itself."""
    first = [htmltext.verdict(b, htmltext.told(found)) for b in found]
    out = []
    for i, b in enumerate(found):
        if first[i] is not None:
            out.append(first[i])
            continue
        left = next((j for j in range(i - 1, -1, -1) if first[j] is not None), None)
        right = next((j for j in range(i + 1, len(found)) if first[j] is not None), None)
        near = [j for j in (left, right) if j is not None and not (b.article and found[j].article != b.article)]
        if not near:
            out.append(b.article > 0)
        elif all(first[j] for j in near) or not any(first[j] for j in near):
            out.append(first[near[0]])
        elif b.heading:
            out.append(first[near[1]])
        elif i - near[0] != near[1] - i:
            out.append(first[near[0] if i - near[0] < near[1] - i else near[1]])
        else:
            out.append(b.article > 0)
    return out


def test_html_second_pass():
    rng = np.random.default_rng(1)
    parts = ["<p>Short one.</p>", "<p>" + "The tale of the day is that it was as it had been in the night. " * 3 + "</p>", "<h2>Title</h2>", "<nav>Home About</nav>", "<article>", "</article>", '<div class="sidebar">More of it</div>', "<p><a href=x>Link link link</a></p>", "<p>" + "Zxq wvb " * 25 + "</p>", "<footer>End</footer>"]
    for _ in range(300):
        found = htmltext.blocks("".join(rng.choice(parts, int(rng.integers(0, 14)))))
        assert htmltext.labels(found) == slow_labels(found)


def test_html_of_odd_pages(spark):
    run = "The story of the day is that it was in the end as it had been. " * 4
    assert htmltext.main_text(f"<body><p>{'これは長い段落です。' * 30}</p></body>").startswith("これは")
    for tag in ("canvas", "svg", "select", "object"):
        assert htmltext.main_text(f"<body><{tag}><p>{run}</p></body>") == run.strip()
    assert htmltext.main_text(f"<body><p>{run}</p><script>never ended <p>{run}</p>") == run.strip()
    deep = "<div>" * 20_000 + f"<p>{run}</p>" + "</span>" * 20_000 + "</div>" * 20_000
    assert htmltext.main_text(deep) == run.strip()
    long = f"<article>{'<p>' + run + '</p>'}</article>" * 3000
    assert len(htmltext.main_text(long)) == 3000 * len(run) - 1
    rows = spark.createDataFrame([(1, "mine", f"<p>{run}</p>", 9)], "page_id long, text string, html string, n_chars int")
    got = htmltext.extract(rows, ["page_id", "text", "n_chars"])
    assert got.columns == ["page_id", "text", "n_chars", "text_", "n_chars_"] and got.first()[:4] == (1, "mine", 9, run.strip())


def test_lines_of_repeated_rows(spark):
    rows = [(1, "a", "Common\nown 1"), (1, "a", "Common\nown 1"), (2, "b", "Common"), (None, "c", "Common\nCommon"), (3, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"n_lines": F.lit("x"), "_hits": F.lit(7)})
    assert linededup.remove_spread_lines(d, sites=4).agg(F.sum("n_removed")).first()[0] == 0  # repeated rows add no site
    got = linededup.remove_spread_lines(d, sites=3).select("doc_id", "text", "n_lines", "n_removed", "_hits").collect()
    assert Counter(map(tuple, got)) == Counter([(1, "own 1", 2, 1, 7), (1, "own 1", 2, 1, 7), (2, "", 1, 1, 7), (None, "", 2, 2, 7), (3, None, 0, 0, 7)])


def slow_score(shape, p, ids):
    """One text's log probability, token by token."""
    h, total = np.zeros(gru.HIDDEN), 0.0
    soft = lambda x: np.log(np.exp(x - x.max()) / np.exp(x - x.max()).sum())
    sig = lambda x: 1 / (1 + np.exp(-x))
    n = gru.HIDDEN
    for t in ids:
        k = shape.class_of[t] if t < shape.n else gru.HEAD_CLASSES + t - shape.n
        total += soft(h @ p["cls"] + p["cls_b"])[k]
        if t < shape.n:
            a, b = shape.first[k], shape.first[k + 1]
            total += soft(p["out"][a:b] @ h + p["out_b"][a:b])[t - a]
        x, u = p["embed"][t] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = new + z * (h - new)
    return total


def test_gru_scores_token_by_token():
    rng = np.random.default_rng(2)
    shape = gru.Shape(np.arange(50, dtype=np.int64), np.arange(50, 0, -1) * 2.0, np.full(gru.TAILS, 3.0))
    p = gru.train(shape, shape.start(), rng.integers(0, 50 + gru.TAILS, 5000), np.arange(500, 5001, 500))
    lengths = [1, 40, 3, 17, 200]
    ids = rng.integers(0, 50 + gru.TAILS, sum(lengths))
    ends = np.cumsum(lengths)
    got = gru.score(shape, p, ids, ends)
    want = [slow_score(shape, p, ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    assert got == pytest.approx(want, rel=1e-4)


def test_softmax_with_far_logits():
    x = np.array([[0.0, -500.0, 1.0], [-900.0, -901.0, -902.0]], np.float32)
    got = gru._log_share(x.copy(), np.array([2, 1]))
    assert got == pytest.approx([1 - np.log(np.exp(0) + np.exp(1)), -1 - np.log(1 + np.exp(-1) + np.exp(-2))], rel=1e-4)


def test_lm_of_null_keys_and_repeated_rows(spark):
    rows = [(None, "a b c"), (None, None), (5, "a b c"), (5, "a b c"), (7, "A  b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.coalesce(F.col("doc_id") == 7, F.lit(False)))
    got = lm.score(d).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {13}
    assert len({round(r.score, 6) for r in got if r.n_tokens == 4}) == 1 and next(r.n_known for r in got if r.doc_id == 7) == 3


def test_lm_of_words_in_many_chunks(spark, monkeypatch):
    """Counts are the same however the places of a word are dealt to rows."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.geometric(0.05, 30)) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12, "doc_id").withColumn("held_out", F.col("doc_id") % 10 == 0)
    counts = Counter(w for i, t in enumerate(texts) if i % 10 for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for group in (4096, 1, 5):
        monkeypatch.setattr(lm, "GROUP", group)
        for r in lm.score(d).collect():
            w = [*texts[r.doc_id].split(), ""]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))


def test_lm_learns_from_the_documents(spark):
    """On held-out documents the model is better than the unigram base."""
    got = lm.op7_gru_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]


def test_repeated_labels(spark):
    d = spark.createDataFrame([(i, f"plain words here n{i} " + ("vile filth " * 3 if i % 3 == 0 else "")) for i in range(60)], "doc_id long, text string")
    once = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    twice = once.unionAll(once).unionAll(spark.createDataFrame([(None, 1), (3, None), (0, 0), (999, 1)], "doc_id long, toxic int"))
    a, b = toxicity.fit(d, once), toxicity.fit(d, twice)
    assert a == b and a.weights[b"filth"] > 0


def test_ring_moves_little_at_the_bound_of_the_query(spark):
    """Loads as even as can be: one more shard takes its share, and few keys go elsewhere."""
    some = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(some, n).collect()} for n in (24, 25))
    moved = sum(a[k] != b[k] for k in a)
    assert 20_000 / 25 <= moved + 1 and moved < 3 * 20_000 / 25


def test_links_of_two_bits_only(spark):
    d = spark.createDataFrame([(1 << k,) for k in range(5)] + [(0,)], "fp long")
    for crowd in (128, 1):
        assert simhash.links(d, crowd=crowd).where("bit_count(a ^ b) > 2").count() == 0


def test_quality_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "word " * 50_000, "x"), (1, None, "y"), (1, None, "y")], "doc_id long, text string, kept string")
    rows = quality.judge(d).collect()
    assert sorted((r.n_words, r.kept) for r in rows) == [(0, False), (0, False), (50_000, False)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (None, "", None, None, 0), (2, None, "en", None, None)]])
def test_pipeline_of_odd_rows(spark, sf, rows):
    """Empty tables, nulls and repeated rows; other columns pass through all stages but the last, which adds its own."""
    import corpus_pipeline

    names = ["toxicity", "passages", "_spans", "mix", "size", "_mark", "_k", "shard", "slot"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(f"own {n}") for n in names})
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        if name != "sharding":
            assert now.columns == docs.columns
        assert now.where(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0
    assert now.columns == [*docs.columns, "shard_", "slot_"]
    assert now.where("text is not null and text <> ''").select("text").distinct().count() == (1 if len(rows) > 1 else 0)


def test_pipeline_leaves_one_folder(spark, sf, tmp_path, monkeypatch):
    """Each stage's rows go when the next one's are written; the result reads the last."""
    import corpus_pipeline
    from talus.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    n = corpus_pipeline.run(spark, sf).count()
    (own,) = tmp_path.glob("pipeline-*")
    assert n > 0 and [x.name for x in own.iterdir()] == ["mixing"]
