from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

import public_tokenizers
from ledgerspark.llm import merge_replay as M

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The least rank first, the leftmost of equals."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def check(words: list[bytes], ranks: dict[bytes, int]) -> None:
    ids, count = M.replay(words, M.Merges(ranks))
    ends = np.cumsum(count)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, count, strict=True)] == [brute(w, ranks) for w in words]


def test_replay_equals_brute_force():
    rng = random.Random(3)
    ranks = {t: r for r, t in M.merges(PATH).tokens.items()}
    tokens = sorted(ranks)
    words = [bytes(rng.choice(b"abno .-=") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words += [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    words += [bytes([rng.choice(b"aeo =-*_0")]) * rng.randint(1, 200) for _ in range(100)]
    check(words, ranks)


def test_merges_that_bring_up_lower_ranks():
    """Vocabularies in arbitrary order, in which a merge's result is often part of a lower rank."""
    rng = random.Random(4)
    for _ in range(40):
        tokens = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 25))}
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: k for k, t in enumerate([b"a", b"b", *order])}
        check([bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(60)], ranks)


def library():
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text: str | None, encoding) -> tuple[int, str, str]:
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_and_decode_odd_rows(spark):
    texts = [None, "", " ", "a", "it's  we'LL 12ab３\x85\x1c .. <|endoftext|>\n\n x ", "́e‍👩‍👩‍👧 ß日本", "a" * 5000, " " * 3000 + "x", "-=" * 2000, "word " * 3000]
    rows = [(None if k == 4 else k, t, "x") for k, t in enumerate(texts)] + [(9, texts[9], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoding = library()
    encoded = M.encode(docs, PATH)
    key = lambda r: (r[0] is None, r[0])
    assert sorted(((r.doc_id, *tuple(r)[1:]) for r in M.digests(encoded, PATH).collect()), key=key) == sorted(((k, *expected(t, encoding)) for k, t, _ in rows), key=key)
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in M.decode(encoded, PATH).collect()), key=key) == sorted(((k, t or "") for k, t, _ in rows), key=key)
    assert M.digests(M.encode(docs.limit(0), PATH), PATH).count() == 0


def test_shares_do_not_change_ids():
    m, rng = M.merges(PATH), random.Random(6)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    one, many = M.Words(m), M.Words(m)
    numbers = np.array([one[w] for w in words])
    one.replay_new()
    whole, parts = one.spell(numbers), []
    for k in range(0, 500, 50):
        numbers = np.array([many[w] for w in words[k : k + 50]])
        many.replay_new()
        parts.append(many.spell(numbers))
    assert whole.tolist() == np.concatenate(parts).tolist()


def test_unknown_bytes_and_ids_are_errors():
    m = M.Merges({b"a": 0, b"b": 1, b"ab": 2})
    with pytest.raises(ValueError):
        M.replay([b"abc"], m)
    with pytest.raises(KeyError):
        M._digest_one(np.array([7]), m.tokens)


def test_query_on_given_documents(spark):
    from ledgerspark.llm.queries import queries

    path, encoding = "/root/testdata/sf0.001", library()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, queries()["op12_merge_replay"](spark, path).collect()))
    assert got == sorted((r.doc_id, *expected(r.text, encoding)) for r in docs)
