from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from ledgerspark.llm import periodic_runs as P


def brute(words: list) -> list[tuple[int, int, int]]:
    """Every stretch of at least max(6, 4 q) words with period q that no neighbour extends; q is its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n_, q) for (s, n_), q in best.items()), key=lambda r: (r[0], r[2]))


def some_words(rng: random.Random) -> list[bytes]:
    out: list[bytes] = []
    for _ in range(rng.randint(0, 6)):
        part = [rng.choice(b"abc").to_bytes(1, "big") for _ in range(rng.randint(1, 12))]
        out += (part * rng.randint(1, 9))[: rng.randint(1, 200)]
        if rng.random() < 0.5 and out:  # a period that is periodic itself, but for its end
            out += ((rng.randint(2, 9) * [b"a", b"b"] + [b"c"]) * rng.randint(1, 6))[: rng.randint(1, 120)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [some_words(rng) for _ in range(400)] + [[b"a"] * n for n in (0, 1, 5, 6, 7, 64, 1000)] + [[b"a", b"b"] * 500 + [b"a"], [bytes([97 + bin(i).count("1") % 2]) for i in range(600)]]
    found = P.text_runs(texts)
    assert found == [brute(t) for t in texts]
    assert sum(map(len, found)) > 300


def test_long_periods_in_long_texts():
    rng = np.random.default_rng(1)
    part = [b"%d" % x for x in rng.integers(0, 500, 3001)]
    words = [b"x", b"y"] + part * 5 + part[:17] + [b"z"]
    assert P.text_runs([words])[0] == brute_one(words, 3001)


def brute_one(words: list[bytes], q: int) -> list[tuple[int, int, int]]:
    same = [k for k in range(len(words) - q) if words[k] == words[k + q]]
    assert same == list(range(same[0], same[-1] + 1))
    return [(same[0], same[-1] + 1 + q - same[0], q)]


def test_wavelet_tree_queries():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 500):
        values = rng.permutation(n)
        tree = P.WaveletTree(values)
        for _ in range(50):
            lo = int(rng.integers(0, n))
            hi = int(rng.integers(lo, n)) + 1
            bound = int(rng.integers(0, n + 1))
            part = sorted(values[lo:hi])
            one = np.array([lo]), np.array([hi])
            assert tree.below(*one, np.array([bound]))[0] == sum(v < bound for v in part)
            k = int(rng.integers(0, len(part)))
            assert tree.nth(*one, np.array([k]))[0] == part[k]


def expected(doc_id: int | None, text: str | None, plant: bool) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = best[1] * 1000 // best[2] if runs else None
    text_ = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *best, milli, hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest(), hashlib.sha256(text_).hexdigest())


def test_digests_with_odd_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a " * 30, "a\x0bb\x0ca\rb\na b a b", "a\x85 " * 9, "ü ö " * 8 + "x", " ".join(w.decode() for w in some_words(rng))]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [(None if k == 3 else k, t, "x", 1) for k, t in enumerate(texts)] + [(7, texts[7], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, runs int")
    for plant in (False, True):
        got = sorted(map(tuple, P.digests(docs, P.planted if plant else None).collect()), key=str)
        assert got == sorted(((k, *expected(k, t, plant)) for k, t, *_ in rows), key=str)
        assert any(r[1] for r in got if r[0] is not None and r[0] > 10) == plant
    assert P.digests(docs.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go on on on on on on on now"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in P.runs(docs).collect()] == [(1, 0, 1, 7, 1)]
    assert [tuple(r) for r in P.collapsed(docs).orderBy("doc_id").collect()] == [(1, "go on now"), (2, "")]


def test_query_on_given_documents(spark):
    from ledgerspark.llm.queries import queries

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in queries()["op11_periodic_runs"](spark, path).collect()}
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(got) == len(docs) and len(short) > len(docs) // 2
    assert all(got[r.doc_id] == expected(r.doc_id, r.text, True) for r in short)
    assert sum(r[0] > 0 for r in got.values()) > len(docs) // 20
