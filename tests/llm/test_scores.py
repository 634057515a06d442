import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cellframe.llm.html_text import Forest, fit, labelled_pages, main_texts, parse
from cellframe.llm.ppm import ORDER, ByteModel, gram_keys, language_scores
from cellframe.llm.quality import quality_scores
from cellframe.llm.toxicity import reject_toxic, toxicity_scores


def test_byte_model_sums_to_one():
    texts = [b"the cat and the hat", b"that that is", b""]
    keys, sizes = gram_keys(texts)
    assert len(keys) == sizes.sum() == sum(len(t) + 1 for t in texts)
    tables = {}
    for order in range(ORDER + 1):
        k, c = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
        tables[order] = (k, c)
    model = ByteModel(tables)
    for context in (b"\xff" * 5, b"e the", b"zzzzz", b" that"):
        k = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** model.log10(k)).sum() == pytest.approx(1, abs=1e-4)


def test_language_scores_by_brute_force(frame):
    texts = ["The cat", "the CAT\x0b sat down", "", None, "dog " * 50, "the cat", "ünï ünï"] * 4
    docs = list(enumerate(texts)) + [(2, "x y"), (2, "x y"), (None, "the cat")]
    rows = language_scores(frame(docs, "doc_id long, text string"), run_size=40).collect()
    split = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if i is not None and not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, held(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in docs)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want and all(r.score < 0 for r in rows)


def test_byte_scores_by_one_whole_trie(frame, monkeypatch):
    from cellframe.llm import ppm

    monkeypatch.setattr(ppm, "ENTRIES", 50, raising=False)  # no bound may count
    rng = random.Random(2)
    docs = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(30))) for i in range(60)]
    train = [t.encode() for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    keys, _ = gram_keys(train)
    model = ByteModel({order: np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True) for order in range(ORDER + 1)})
    rows = language_scores(frame(docs, "doc_id long, text string"), run_size=300).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        assert r.score == pytest.approx(model.log10(gram_keys([texts[r.doc_id].encode()])[0]).sum(), rel=1e-5)


def test_language_scores_of_nothing(frame):
    assert language_scores(frame([], "doc_id long, text string")).count() == 0


def test_messages_give_exact_marginals():
    nodes = parse("<div><p>one</p><p>two <a href=x>three</a></p></div>")
    forest = Forest([nodes])
    rng = np.random.default_rng(1)
    w, edges = rng.normal(size=forest.x.shape[1]), rng.normal(size=(2, 2, 2))
    got, _ = forest.marginals(w, edges)
    n, total, ones = len(nodes), 0.0, np.zeros(len(nodes))
    for state in range(1 << n):
        y = [(state >> i) & 1 for i in range(n)]
        s = math.exp(sum((forest.x[i] @ w) * y[i] + (edges[forest.kind[i], y[forest.parent[i]], y[i]] if forest.parent[i] >= 0 else 0) for i in range(n)))
        total += s
        ones += s * np.array(y)
    assert np.allclose(got, ones / total)


def test_held_out_pages():
    w, edges = fit(labelled_pages(200))
    held = Forest(labelled_pages(80, seed=77))
    p, _ = held.marginals(w, edges)
    leaves = held.kind == 1
    assert ((p >= 0.5) == held.y)[leaves].mean() > 0.96


def test_main_texts(frame):
    body = "".join(f"<p>Sentence {i} of the article, with &amp; some\n more words in it.<br>" for i in range(6))
    page = f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Title here</h1>{body}</article><div class=comments><p>I like this very much, thanks a lot.</p></div><footer>&copy; us</footer>"
    rows = {r.page_id: r for r in main_texts(frame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (1, "u", page)], "page_id long, url string, html string")).collect()}
    assert rows[1].text == "\n\n".join(["Title here"] + [f"Sentence {i} of the article, with & some more words in it." for i in range(6)])
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == rows[3].text == ""
    assert main_texts(frame([], "page_id long, url string, html string")).count() == 0


def _labelled(n=400):
    docs, labels, rng = [], [], random.Random(8)
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 7))) for _ in range(40)]
        if rude:
            words[5] = "nastyword" + "abc"[i % 3]
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + "."))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), int(rude)))
    return docs + [(1000, None), (1001, ""), (None, "text")], labels


def test_quality_and_toxicity(frame):
    docs, labels = _labelled()
    d, y = frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality_scores(d, y).collect()}
    assert len(q) == len(docs) and np.mean([q[i].predicted == int(i % 4 != 0) for i in range(400)]) > 0.97
    t = {r.doc_id: r for r in toxicity_scores(d, y).collect()}
    assert np.mean([t[i].predicted == int(i % 5 == 0) for i in range(400)]) > 0.97
    assert all(0 <= r.score <= 1 for r in [*q.values(), *t.values()]) and not q[None].held_out
    assert t[7].held_out == (zlib.crc32(b"7") % 3 == 1) and q[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    kept = reject_toxic(d, y)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in t.values())
    none = frame([], "doc_id long, quality int, toxic int")
    assert quality_scores(d, none).count() == toxicity_scores(d, none).count() == reject_toxic(d, none).count() == len(docs)
    assert quality_scores(d.limit(0), y).count() == 0


def test_quality_learns_from_every_labelled_row(spark):
    """All pairs count: the loss of the ranges is that of brute force over all rows, of which a sample saw 4,000 a label."""
    from pyspark.sql import functions as F

    from cellframe.llm.quality import FEATURES, PairwiseRanker

    seen = []
    rows = spark.range(12_000).select((F.col("id") % 5 != 0).cast("long").alias("y"), F.transform(F.sequence(F.lit(1), F.lit(len(FEATURES))), lambda i: F.hash(F.col("id"), i) / 2.0**31 + (F.col("id") % 5 != 0).cast("double") * (i < 4).cast("double")).alias("x"))
    ranker = PairwiseRanker()
    loss = ranker._loss
    ranker._loss = lambda rows, w: seen.append((w, *loss(rows, w))) or seen[-1][1:]
    ranker.fit(rows)
    x, y = (np.array(c) for c in zip(*[(r.x, r.y) for r in rows.collect()]))
    for w, value, slope in seen[:: max(1, len(seen) - 1)]:
        f = ranker._phi(x)
        gap = (f[y == 1] @ w)[:, None] - (f[y == 0] @ w)[None, :]
        assert value == pytest.approx(np.logaddexp(0, -gap).mean() + ranker.l2 / 2 * w @ w, rel=2e-3)
        pull = 1 / (1 + np.exp(gap))
        want = -(pull.mean(axis=1) @ f[y == 1] / (y == 1).sum() - pull.mean(axis=0) @ f[y == 0] / (y == 0).sum()) + ranker.l2 * w
        assert np.allclose(slope, want, atol=2e-3)
    assert np.mean((ranker.score(x) >= ranker.best_quantile(rows)) == (y == 1)) > 0.8


def test_blocks_of_keys_are_small():
    from cellframe.llm import ppm

    rng = random.Random(9)
    words = ["".join(rng.choice("aabcdeeefghiiklmnooprsttu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(rng.choice(words) for _ in range(60_000)).encode()
    keys = np.unique(gram_keys([text])[0])
    order, rng_of = ppm._range_order(keys, 16)
    assert (ppm._turned(ppm._turned(keys)) == keys).all() and (np.sort(order) == np.arange(len(keys))).all() and (rng_of == ppm._gram_range(keys[order], 16)).all()
    blocks = [keys[order[rng_of == r]] for r in range(16)]
    packed = [ppm._pack_keys(b) for b in blocks]
    assert all((ppm._unpack_keys(p) == b).all() for p, b in zip(packed, blocks))
    assert sum(map(len, packed)) < 0.75 * sum(len(ppm._pack(np.sort(b), True)) for b in blocks)  # rising as numbers
    logs = -np.log10(np.arange(1, 3000) / 3000).astype(np.float32).repeat(2)
    assert (ppm._unpack_repeated(ppm._pack_repeated(logs)) == logs).all()
    hashes = np.unique(ppm.word_hashes([text])[0])
    assert (np.diff(ppm._word_range(hashes, 16)) >= 0).all() and set(ppm._word_range(hashes, 16)) == set(range(16))
