from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import hmm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_base_scores_and_gain_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (None, "the the"), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("block", F.lit(2))
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    count = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    whole = sum(count.values()) + 0.5 * (len(count) + 1)
    corpus = hmm.encode(docs)
    assert abs(corpus.base.sum() - 1) < 1e-9
    model, trace = hmm.baum_welch(corpus)
    assert all(b > a for a, b in itertools.pairwise(trace))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.step.sum(axis=1), 1)
    got = sorted(hmm.score(corpus, model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        w = tokens(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held[d], len(w), sum(count[x] > 0 for x in w), sum(count.values()))
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / whole) for x in w), rel=1e-9)
    gain = [(r.score - r.base_score) / r.n_tokens for r in got if r.held_out]
    assert np.mean(gain) > 0.05


def test_forward_and_counts_match_enumeration():
    r = np.random.default_rng(2)
    m = hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (r.random(3), r.random((3, 3)))), (lambda e: e / e.sum(axis=0))(r.random((5, 3))))
    texts = [r.integers(0, 5, n).astype("<u2") for n in (4, 1, 6, 2, 4)]
    packed = hmm.Packed(texts)
    first, steps, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t, got in zip(texts, packed.log_likelihoods(m), strict=True):
        ways = {}
        for path in itertools.product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for a, b, x in zip(path, path[1:], t[1:], strict=False):
                p *= m.step[a, b] * m.emit[x, b]
            ways[path] = p
        total = sum(ways.values())
        assert got == pytest.approx(math.log(total), rel=1e-12)
        for path, p in ways.items():
            first[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                steps[a, b] += p / total
            for x, k in zip(t, path, strict=True):
                emitted[x, k] += p / total
    got = packed.expected(m)
    for a, b in zip(got, (first, steps, emitted), strict=False):
        assert np.allclose(a, b, rtol=1e-4)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 100])
def test_segments_compose(n):
    r = np.random.default_rng(n)
    m = hmm.Model(*(x / x.sum(axis=-1, keepdims=True) for x in (r.random(3), r.random((3, 3)))), (lambda e: e / e.sum(axis=0))(r.random((5, 3))))
    text = r.integers(0, 5, n).astype("<u2")
    assert hmm.long_log_likelihood(m, text, 8) == pytest.approx(hmm.Packed([text]).log_likelihoods(m)[0], rel=1e-12)


def test_long_texts_and_words_that_polynomials_confuse(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LONG", 300)
    monkeypatch.setattr(hmm, "SEGMENT", 64)
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    train, held = ([i for i in range(60) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (False, True))
    words = [f"w{k % 37}" for k in range(2000)]
    docs = spark.createDataFrame([(train[0], " ".join(words)), (train[1], f"{morse} a"), (held[0], other), (held[1], " ".join(words[5:1500])), (held[2], "w1 w2")], "doc_id long, text string")
    corpus = hmm.encode(docs)
    model, _ = hmm.baum_welch(corpus, 2)
    got = {r.doc_id: r for r in hmm.score(corpus, model).collect()}
    assert got[held[0]].n_known == 1 and got[train[1]].n_known == 3
    monkeypatch.setattr(hmm, "LONG", 10**6)
    for d, r in {x.doc_id: x for x in hmm.score(corpus, model).collect()}.items():
        assert got[d].score == pytest.approx(r.score, rel=1e-9)


def test_empty_and_untrained(spark):
    assert hmm.score_documents(spark.createDataFrame([], "doc_id long, text string"), 1).count() == 0
    d = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = hmm.score_documents(spark.createDataFrame([(d, "never seen")], "doc_id long, text string"), 1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, pytest.approx(0.0, abs=1e-9))
