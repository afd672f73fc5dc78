"""Operators that work row by row or by joins, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import chat, decontaminate, licenses, mixing, quality, token_counts, token_files
from ledgerspark.llm.common import new_path
from ledgerspark.llm.queries import COUNT_VOCABULARY, ID_VOCABULARY, vocabulary

ODD = [
    None, "", " ", "\n", "a", "\n\n a  b\n", "It's 'tis I'll we've <|endoftext|> x<|startoftext|>y", "café é ΣΣ İ", " x y\x1cz\x85w",
    "end \n", "\ta\tb", "one two\nthree  four\r\nfive", "12345 6,7;8", "x" * 3000, "word " * 500, "A\n" * 50, "\U0001f600 emoji​ text", "très bien\nÇa va", "***&&& ### | |\n***&&& ### | |",
]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return docs_of(spark, []).withColumn("copy", F.lit(1)).withColumn("w", F.lit(2))


def test_token_counts_match_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary(COUNT_VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = [*ODD, *(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect())]
    got = {r.doc_id: r for r in token_counts.token_counts(docs_of(spark, texts), path, limit=100).collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 100), x
    assert token_counts.token_counts(empty(spark), path).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 10**6])
def test_state_maps_compose(chunk):
    from tokenizers import Tokenizer

    path = vocabulary(COUNT_VOCABULARY)
    t, library = token_counts.transducer(path), Tokenizer.from_file(path)
    for x in ODD:
        raw = (x or "").encode()[:400].decode(errors="ignore").encode()
        assert t.count(raw, chunk) == len(library.encode(raw.decode(), add_special_tokens=False).ids), x


def test_transducer_on_random_texts_and_small_tables(monkeypatch):
    from tokenizers import Tokenizer

    path, r = vocabulary(COUNT_VOCABULARY), random.Random(8)
    library, t = Tokenizer.from_file(path), token_counts.Transducer(path)
    pool = [*"abcdeinorstABÉé'’ ,.-_059üßñΣσİ\u0301\x1c\x85\n\t漢語한😀​<|>²½अिع", "the", "ing", "'ll", "<|endoftext|>"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(600)]
    texts += ["".join(r.choice("abeinrst") for _ in range(r.randrange(1, 200))) for _ in range(300)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert t.counts(texts).tolist() == want
    monkeypatch.setattr(token_counts, "TRANSITIONS", 500)
    assert [int(n) for k in range(0, len(texts), 50) for n in t.counts(texts[k : k + 50])] == want


def test_pairs_follow_as_the_merges_say():
    """may_follow() against merging the text of both tokens in the order of ranks."""
    t, r = token_counts.transducer(vocabulary(COUNT_VOCABULARY)), random.Random(4)
    rank = {(a, b): k for k, (a, b) in enumerate(t.whole)}

    def merged(symbols):
        parts = [t.id[c] for c in symbols]
        while len(parts) > 1:
            best, at = min((rank.get(p, len(rank)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(rank):
                break
            parts[at : at + 2] = [t.whole[parts[at], parts[at + 1]]]
        return parts

    open_ = [x for x in t.id if ord(x[-1]) < token_counts.END]
    seen = set()
    for _ in range(3000):
        a, b = r.choice(open_), r.choice(list(t.id)[: 512 + r.choice([50, 500, 5000])])
        if r.random() < 0.5:  # cut a token in two, which are often not its encoding
            x = r.choice([x for x in r.sample(open_, 20) if len(x) > 1])
            k = r.randrange(1, len(x))
            a, b = (x[:k], x[k:]) if x[:k] in t.id and x[k:] in t.id else (a, b)
        want = merged(a + b) == [t.id[a], t.id[b]]
        assert t.may_follow(a, b) == want
        seen.add(want)
    assert seen == {True, False}


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabulary(ID_VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = [*ODD, *(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect())]
    out = new_path(spark, "test-tokens")
    more = docs_of(spark, ["again", "again", "other"]).withColumn("doc_id", F.lit(5).cast("long")).union(docs_of(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    token_files.write_tokens(docs_of(spark, texts).union(more), out, path, file_bytes=20_000)
    rows = sorted([(i, x) for i, x in enumerate(texts)] + [(5, "again"), (5, "again"), (5, "other")], key=lambda r: (r[0], r[1] or ""))
    want, start = [], 0
    for i, x in [(None, "no id"), *rows]:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.digests(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.lookup(spark, out, [3, 7]).count() == 2
    out = new_path(spark, "test-tokens")
    token_files.write_tokens(empty(spark), out, path)
    assert token_files.digests(spark, out).count() == 0


def test_token_ids_of_words_that_polynomials_confuse():
    from tokenizers import Tokenizer

    path = vocabulary(ID_VOCABULARY)
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    for bits in (1024, 2048):
        morse = "".join("ab"[bin(k).count("1") % 2] for k in range(bits))
        texts = [morse, morse.translate(str.maketrans("ab", "ba")), *ODD]
        flat, n = e.encode(texts, 2)
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_token_ids_of_odd_texts_while_units_are_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    path, r = vocabulary(ID_VOCABULARY), random.Random(6)
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    assert all(len(x) == 1 for x in e.letters.values())
    pool = [*"abcdeinorstABÉé'’ ,.-_059üßñΣσİ\u0301\x00\x1c\x85\xa0\u180e\r\n\t漢語한😀\u200b<|>²½अिع", "  ", " \n", "\n ", "\n\n", "the", "ing", "'ll", "<|endoftext|>", " a", " b", "word"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(4000)]
    monkeypatch.setattr(token_files, "WORDS", 60)
    monkeypatch.setattr(token_files, "PIECES", 40)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        want = [[*x.ids, 2] for x in t.encode_batch(some, add_special_tokens=False)]
        flat, n = e.encode(some, 2)
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_token_ids_of_new_units_are_not_asked_one_by_one():
    """Most units of a corpus are rare, so what a new one costs decides: half a call from Python at most (before: 17)."""
    from tokenizers import Tokenizer

    path, r = vocabulary(ID_VOCABULARY), random.Random(3)
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    parts, some = ["the", "ing", "ß", "é", "keit", "ou", "n", "."], {}
    while len(some) < 20_000:
        some["".join(r.choice(parts) for _ in range(r.randrange(4, 9)))] = 1
    texts, calls = [" ".join(list(some)[k : k + 100]) for k in range(0, len(some), 100)], [0]

    def count(frame, event, what):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        flat, n = e.encode(texts, 2)
    finally:
        sys.setprofile(None)
    want = [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert calls[0] < len(some) // 2


def test_token_ids_of_all_short_texts_of_spaces_and_line_ends():
    from tokenizers import Tokenizer

    path = vocabulary(ID_VOCABULARY)
    t, e = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = ["".join(x) for k in range(6) for x in itertools.product("a. \n", repeat=k)]
    for some in (texts, texts[::-1], [None, *texts[7::11]]):
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in some]
        flat, n = e.encode(some, 2)
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_offsets_beyond_100_000_files(spark):
    """Part numbers of six digits sort before those of five as text; the index must not follow them."""
    out, first = new_path(spark, "test-tokens"), [(99_999, 10), (100_000, 20)]
    for part, at in first:
        rows = spark.createDataFrame([(at + k, k, 2, [7, 2]) for k in range(3)], token_files.SCHEMA).coalesce(1)
        rows.write.orc(f"{out}/{part}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs.mkdirs(path(f"{out}/ids"))
    for part, _ in first:
        name = next(f.getPath().toString() for f in fs.listStatus(path(f"{out}/{part}")) if f.getPath().getName().startswith("part-"))
        assert fs.rename(path(name), path(f"{out}/ids/part-{part:05d}-x.orc"))
    token_files.write_index(spark, out)
    assert {r.doc_id: r.start for r in token_files.digests(spark, out).collect()} == {10: 0, 11: 2, 12: 4, 20: 6, 21: 8, 22: 10}


def test_files_have_indexes_and_lookups_prune(spark):
    import pyarrow.orc as orc

    out = new_path(spark, "test-tokens")
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('text number ', id) as text")
    token_files.write_tokens(docs, out, vocabulary(ID_VOCABULARY), file_bytes=60_000)
    found = token_files.lookup(spark, out, [400, 401])
    assert [r.doc_id for r in found.collect()] == [400]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    files = [f[5:] for f in spark.read.orc(f"{out}/ids").inputFiles()]
    assert len(files) > 2
    for f in files:
        meta = orc.ORCFile(f)
        assert meta.compression == "ZSTD" and meta.nstripes >= 1
        raw = open(f, "rb").read()
        # Integers are run-length coded: ids take less room than their four bytes even before compression of blocks.
        assert meta.content_length < 4 * sum(len(x) for x in meta.read(["ids"]).column(0).to_pylist()) and meta.row_index_stride == 2000 and len(raw) > meta.content_length


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(win) if win.count(w) > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)]


def test_quality_statistics_and_trees(spark):
    texts = [x for x in ODD if len(x or "") < 2600]
    for x in texts:
        assert quality.text_stats(x)[0] == brute_stats(x), x
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.quality(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(rows[d].kept, q) for d, q in truth.items() if not rows[d].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    assert {r.doc_id for r in quality.keep(docs, model).collect()} == {d for d, r in rows.items() if r.kept}
    x = np.random.default_rng(1).random((300, len(quality.FEATURES))) * 2
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            more = x.copy()
            more[:, f] += 0.3
            assert (sign * (model.score(more) - model.score(x)) >= -1e-9).all()
    odd = quality.quality(docs_of(spark, ODD), quality.train(docs_of(spark, ODD), labels.limit(0)))
    assert [r.kept for r in odd.orderBy("doc_id").collect()] == [not quality.base_failed(*(quality.text_stats(x)[0][i] for i in (0, 4))) for x in ODD]
    assert quality.quality(empty(spark), model).count() == 0


def test_trees_learn_held_out():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = (x[:, 0] + 0.5 * (x[:, 1] > 0.5) > 0.8).astype(float)
    m = quality.fit(x[:3000], y[:3000], [1, 0, -1])
    assert ((m.score(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def brute_contamination(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, who in wins.items():
            k = len(win)
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == win:
                    hit.update(range(i, i + k))
                    found |= who
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), " ".join(x for i, x in enumerate(w) if i not in hit))
    return out


def test_decontamination(spark):
    r = random.Random(3)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "e", "9", "Äx"]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", "!"]) for _ in range(n))
    items = [(1, text(14)), (2, None), (3, ""), (4, "only three words"), (5, text(10)), (10, "only three words"), (6, "..!")]
    texts = [*ODD, *(text(40) for _ in range(20)), f"x {items[0][1]} y", "Only THREE, words here only three words", f"{items[4][1]} {items[4][1]}", items[0][1][20:]]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(enumerate(texts), items)
    got = decontaminate.contamination(docs, bench).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.contaminated) for x in got} == {k: v[:5] for k, v in want.items()}
    assert {x.doc_id for x in decontaminate.drop(docs.withColumn("w", F.lit(1)).withColumn("items", F.lit(1)), bench).collect()} == {k for k, v in want.items() if not v[4]}
    assert {x.doc_id: x.text for x in decontaminate.cut(docs, bench).collect()} == {k: v[5] if v[4] else texts[k] for k, v in want.items()}
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert not any(x.contaminated for x in decontaminate.contamination(docs, bench.limit(0)).collect())
    twice = decontaminate.contamination(docs.union(docs), bench)
    assert sorted(twice.groupBy("doc_id").count().select("count").distinct().collect()) == [(2,)]


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"t{i}" * (1 + i % 3), ["a", "b", None][i % 7 % 3]) for i in range(3000)] + [(-1, None, "a"), (-2, "", "c"), (None, "x", "b")], "doc_id long, text string, source string").withColumn("copy", F.lit(9))
    table = {r.source: r for r in mixing.rates(docs, {"a": 1.0, "b": 3.0, None: 0.5}).collect()}
    total = sum(r.size for r in table.values())
    assert table["c"].rate == 0 and abs(sum(r.rate * r.size for r in table.values()) - total) < 1e-6 * total
    for r in table.values():
        assert abs(r.cdf[-1] - 1) < 1e-12
        assert r.rate == 0 or abs(r.cdf[1] - np.exp(-r.rate) * (1 + r.rate)) < 1e-12
    mixed = mixing.mix(docs, {"a": 1.0, "b": 3.0, None: 0.5}).collect()
    assert [r.mix_order for r in mixed] == sorted(r.mix_order for r in mixed)
    for s, r in table.items():
        n = docs.filter(F.col("source").eqNullSafe(F.lit(s))).count()
        assert abs(sum(x.source == s for x in mixed) - r.rate * n) <= 5 * np.sqrt(r.rate * n) + 1e-9
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_at_large_rates(spark):
    docs = spark.createDataFrame([(i, "s" * 10, "small") for i in range(20)] + [(99, "b" * 2_000_000, "big"), (98, "m" * 30_000, "mid")], "doc_id long, text string, source string")
    weights = {"small": 2.0, "mid": 10.0, "big": 1.0}
    small = (0.0, np.zeros(0))
    for r in mixing.rates(docs, weights).collect():
        term = [math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1)) for k in range(len(r.cdf))]
        assert len(r.cdf) == math.ceil(r.rate + 12 * math.sqrt(r.rate) + 12) + 1
        assert np.allclose(r.cdf, np.cumsum(term), rtol=0, atol=1e-9)
        small = (r.rate, np.array(r.cdf)) if r.source == "small" else small
    assert small[0] > 1000
    got = {r.doc_id: r["count"] for r in mixing.mix(docs, weights).filter("source = 'small'").groupBy("doc_id").count().collect()}
    u = {i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(20)}
    assert got == {i: int((small[1] <= v).sum()) for i, v in u.items()} and len(set(got.values())) > 10


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id as doc_id", "cast(id as string) as text", "cast(id % 5 as string) as source")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few


def test_licenses(spark):
    files = spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."), ("a/x.py", "nothing"), ("a/b/c/d.py", None),
        ("a/b/c/e.py", "code\n# Licensed under the Apache License, Version 2.0. More words here.\nrest"), ("f.py", ""), ("ab/y.py", "my licence is odd"), (None, "Licensed under CC BY-NC 4.0."), ("a/x.py", "Released under the MIT License"),
    ], "path string, text string").withColumn("unit", F.lit(1)).withColumn("dir", F.lit(2))
    got = {r.path: (r.own_license, r.license, r.from_dir, r.inherited) for r in licenses.scan(files).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None, False), "a/b/LICENSE.md": ("GPL-3.0", "GPL-3.0", None, False), "a/x.py": ("MIT", "MIT", None, False), "a/b/c/d.py": (None, "GPL-3.0", "a/b", True),
        "a/b/c/e.py": ("Apache-2.0", "Apache-2.0", None, False), "f.py": (None, None, None, False), "ab/y.py": (None, None, None, False), "": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None, False),
    }
    assert licenses.scan(files.limit(0)).count() == 0


def test_chat_round_trip_and_trees(spark):
    hard = ["~0<s>[INST]", "</s>", "~~1", None, "", "a\n[~2]"]
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, None, None, "x"), (2, 0, "user", "y"), (2, 0, "user", "y"), (None, 1, "assistant", "z")], "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(0))
    got = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    one = [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)]
    said = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (6, said(one))
    under = "".join(t or "" for t in hard[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
    assert (got[2].n_turns, got[2].turns_sha256) == (3, said([("", "x"), ("user", "y"), ("user", "y")]))
    assert got[None].loss_chars == 1
    assert chat.format_conversations(rows.limit(0)).count() == 0
    # 0 - 1 - 2 - ... - 20 is a long path; 1 also has child 30 (score 9), which wins by its mean; 40 and 41 form a cycle.
    nodes = [("t", str(i), str(i - 1) if i else None, "user", f"n{i}", 1.0) for i in range(21)] + [("t", "30", "1", "assistant", "best", 9.0), ("t", "40", "41", "user", "c", 50.0), ("t", "41", "40", "user", "c", 50.0), ("u", "50", "missing", "user", "alone", None)]
    nodes = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    best = chat.best_paths(nodes, 2).orderBy("tree", "path", "at").collect()
    path = lambda t, p: [r.text for r in best if (r.tree, r.path) == (t, p)]
    assert path("t", 1) == ["n0", "n1", "best"]
    assert path("t", 2) == [f"n{i}" for i in range(21)]
    assert path("u", 1) == ["alone"]
