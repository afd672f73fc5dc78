from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import suffix_dedup

L = suffix_dedup.LENGTH


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows with different ids."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - L + 1):
            w = raw[i : i + L]
            if w in seen:
                gone[i : i + L] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((d, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(80)
    out = [base, base, base + "!", "x" + base, text(5), "", None, "a" * 450, "b" + "a" * 300, "ab" * 200, "ba" * 130 + "c", base[:99], base[:100], base[7:120]]
    for _ in range(25):
        t = list(base)
        for _ in range(r.randrange(1, 5)):
            t[r.randrange(len(t))] = "#"
        out += ["".join(t), text(30) + passage + text(10), text(10) + passage[r.randrange(50) :][: r.randrange(90, 250)] + text(20)]
    twice = text(50)
    return [*out, twice + text(3) + twice, text(20) * 3]


@pytest.mark.parametrize("settings", [{}, {"HOT": 3}, {"PIECE": 400, "CHUNK": 2000}, {"IDS": 1}])
def test_matches_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rows = [(i * 2 - 9, t) for i, t in enumerate(corpus(4))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("pos", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(map(tuple, suffix_dedup.digests(docs).collect()))
    assert got == brute(rows)


def test_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, suffix_dedup.digests(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_sort_sees_no_window_of_a_hot_anchor_twice(spark, monkeypatch):
    """A footer of 130 bytes between different neighbours: its windows must not meet in one task, a row for each document."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    sort = suffix_dedup._sorted_parts

    def checked(batches):
        seen = set()

        def each():
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if row in seen:
                        raise ValueError("a window came twice")
                    seen.add(row)
                yield batch

        yield from sort(each())

    monkeypatch.setattr(suffix_dedup, "_sorted_parts", checked)
    r = random.Random(2)
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(150))
    footer = noise()[:130]
    rows = [(k, noise() + footer + noise()) for k in range(200)]
    got = sorted(map(tuple, suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows) and sum(g[2] >= 130 for g in got) == 199


def test_nulls_repeats_and_empty_tables(spark):
    t = corpus(9)[0]
    docs = spark.createDataFrame([(None, t), (3, t), (3, t), (3, "y" + t), (5, None), (5, t)], "doc_id long, text string")
    n = len(t.encode())
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digests(docs).collect()), key=str)
    assert got == sorted([(None, n, 0), (3, n, n), (3, n, n), (3, n + 1, n), (5, 0, 0), (5, n, n)], key=str)
    assert suffix_dedup.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_sort_and_prefixes(seed):
    r = np.random.default_rng(seed)
    data = r.integers(97, [98, 99, 100, 110, 100, 98][seed], 400).astype(np.uint8)
    data = np.concatenate([data, data[50:250], np.zeros(1, dtype=np.uint8)])
    wanted = r.random(len(data)) < [1, 0.3, 1, 0.5, 0.05, 0.7][seed]
    order = suffix_dedup.two_stage_sort(data, wanted, 16)
    raw = data.tobytes()
    assert set(np.flatnonzero(wanted)) <= set(order) and len(set(order)) == len(order)
    pad = lambda i: raw[i : i + 16].ljust(16, b"\0")
    assert [pad(i) for i in order] == sorted(pad(i) for i in order)
    got = suffix_dedup.common_prefixes(suffix_dedup._words(data), order, 16)
    for a, b, n in zip(order, order[1:], got[1:], strict=False):
        assert n == next((k for k in range(16) if pad(a)[k] != pad(b)[k]), 16)
