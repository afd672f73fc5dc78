from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import hashing, jaccard_join


def brute(rows, threshold=0.8):
    """class_id and n_links of (doc_id, text) rows, all pairs compared."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in range(n)]
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *(part[j] for j in links[i])]) for i in range(n)]
        if new == part:
            break
        part = new
    ids = lambda p: [rows[i][0] for i in range(n) if part[i] == p and rows[i][0] is not None]
    return sorted(((d, min(ids(part[i]), default=None) if sets[i] else d, len(links[i])) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=12, size=9, words=120, vocab=400):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randrange(vocab)}" for _ in range(r.choice([words, 30, 7]))]
        for _ in range(r.randrange(1, size)):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
            out.append(" ".join(t))
    return out


def test_words_hash_alike_wherever_they_stand():
    a, at = hashing.words_of(["One two\nTHREE", None, "", "  two  ", "one"])
    assert at.tolist() == [0, 3, 3, 3, 4, 5]
    assert a[1] == a[3] and a[0] == a[4] and len(set(a.tolist())) == 3


@pytest.mark.parametrize("block", [4, 256])
def test_join_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = [*near_copies(5), None, "", " ", "a", "A", "a b c d", "a b c d e", "same text here again and again", "same text here again and again", "x " * 5000]
    rows = [(i * 3 + 7, t) for i, t in enumerate(texts)]
    rows += [(None, rows[0][1]), (None, "alone with no id of its own here"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted((tuple(r) for r in jaccard_join.join(docs).collect()), key=str)
    assert got == brute(rows)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept >= {d for d, c, _ in got if d == c and d is not None} and not kept & {d for d, c, _ in got if d is not None and d != c}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 0 and jaccard_join.keep_one(docs).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_nodes_stop_where_the_recall_is_met_and_no_deeper(threshold):
    rate = lambda s, d: 1 - (1 - s**d) ** jaccard_join.TREES
    for size in [*range(1, 40), 500]:
        pairs = [i / (size + o - i) for o in range(1, 2 * size) for i in range(1, min(size, o) + 1) if not i == o == size and i >= threshold * (size + o - i) - 1e-9]
        least = min(pairs, default=None) if size < 40 else threshold
        d = jaccard_join.stop(size, threshold)
        assert (d is None) == (least is None)
        if d:
            assert rate(least, d) >= jaccard_join.RECALL or d == 1
            assert d == jaccard_join.LABEL or rate(least, d + 1) < jaccard_join.RECALL
            assert d in jaccard_join.levels(size, threshold)


def test_recall_against_all_pairs(spark):
    """Sets of 60 to 200 n-grams at similarities of 0.8 to 0.9, where a pair is hardest to meet."""
    r, rows = random.Random(11), []
    for k in range(400):
        base = [f"g{k}w{j}" for j in range(r.randrange(60, 200))]
        changed = list(base)
        for _ in range(max(1, len(base) // r.randrange(55, 90))):
            changed[r.randrange(len(changed))] = f"x{r.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    sets = jaccard_join.gram_sets([t for _, t in rows], 5)
    near = [k for k in range(400) if 0.8 <= len(np.intersect1d(sets[2 * k], sets[2 * k + 1])) / len(np.union1d(sets[2 * k], sets[2 * k + 1])) <= 0.9]
    got = {x.doc_id: x.class_id for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 80 and sum(got[2 * k + 1] == 2 * k for k in near) >= 0.99 * len(near)


def test_rows_without_ids_and_words_that_polynomials_confuse(spark):
    """Two words in Thue-Morse order, which all hashes by a polynomial modulo a power of two take for one."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, morse), (2, other)] + [(None, f"row {k} {'of its own ' * (k % 3)} {k * k}") for k in range(3000)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.n_links == 0 for r in got)


def test_links_by_matrix():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    got = jaccard_join.linked(sets, 0.5)
    for i in range(40):
        for j in range(40):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (i != j and len(a & b) >= 0.5 * len(a | b))


def test_components_of_long_chains(spark):
    """Chains of shuffled and of ascending names, a star and a loose pair: rounds must not run out."""
    r = random.Random(3)
    names = [r.randrange(-(2**62), 2**62) for _ in range(2000)]
    chain, star, ordered = names[:1500], names[1500:1900], list(range(600))
    edges = [*zip(chain, chain[1:]), *((star[0], x) for x in star[1:]), *zip(ordered, ordered[1:]), (names[1990], names[1991]), (names[1999], names[1999])]
    want = {x: min(c) for c in (chain, star, ordered, names[1990:1992]) for x in c}
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {x.node: x.part for x in got} == want
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_drifting_versions(spark):
    """600 versions, each similar to its neighbours alone, are one class."""
    words = [f"w{k}" for k in range(600 * 6 + 100)]
    rows = [(k + 1, " ".join(words[k * 6 : k * 6 + 100])) for k in range(600)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {1} and all(r.n_links == (1 if r.doc_id in (1, 600) else 2) for r in got)


def boilerplate(n, common=100, own=100):
    shared = [f"site{k}" for k in range(common)]
    return [(k, " ".join(shared + [f"d{k}w{j}" for j in range(own)])) for k in range(n)]


def test_loosely_similar_texts_are_seldom_compared(spark):
    """Texts of one template, half of whose words are their own, are alike by a third: of 4 times as many, the rows of units
    stay below a few for each text, and no part gathers them."""
    counts = []
    for n in (1000, 4000):
        docs = spark.createDataFrame(boilerplate(n), "doc_id long, text string")
        rows = jaccard_join.stored(jaccard_join.sketches(docs), "test-sketches")
        counts.append(jaccard_join._units(rows, 0.8).count())
    assert counts[0] < 2_000 and counts[1] < 5 * 4_000
    got = jaccard_join.join(docs).filter("n_links > 0 or doc_id <> class_id")
    assert got.isEmpty()


def test_keep_one_judges_rows_without_id_by_their_texts(spark):
    base = [f"w{k}" for k in range(100)]
    near = " ".join([*base[:-1], "x"])
    lone, lone_near = " ".join(f"n{k}" for k in range(100)), " ".join([*(f"n{k}" for k in range(99)), "y"])
    rows = [(1, " ".join(base)), (None, near), (None, near), (None, lone), (None, lone_near), (None, lone_near), (None, "quite another text"), (None, None), (2, "one more"), (2, near)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, part long")
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and {(1, rows[0][1]), (2, "one more"), (None, "quite another text"), (None, None)} <= set(kept)
    assert (None, near) not in kept and sum(t in (lone, lone_near) for _, t in kept) == 1 and len(kept) == 6
