"""The pipeline's stages, each against plain Python on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from ledgerspark.llm import mixing, quality
from ledgerspark.llm.common import stored
from ledgerspark.llm.queries import ID_VOCABULARY, vocabulary

from .test_jaccard_join import brute
from .test_simple_operators import brute_contamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "test")
        steps[name] = (before.collect(), docs.collect())
        assert name == "token_output" or docs.columns == columns

    rows, kept = steps["quality_rules"]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in rows:
        counts, x = quality.text_stats(r.text)
        if not quality.base_failed(counts[0], counts[4]) and model.score(np.array([x]))[0] >= 0:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept} == want and len(kept) > len(rows) / 2

    rows, kept = steps["near_duplicates"]
    assert {r.doc_id for r in kept} == {d for d, c, _ in brute([(r.doc_id, r.text) for r in rows]) if d == c} and len(kept) < len(rows)

    rows, kept = steps["benchmark_decontamination"]
    dirty = brute_contamination([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert {r.doc_id for r in kept} == {d for d, v in dirty.items() if not v[4]} and len(kept) < len(rows)

    rows, mixed = steps["source_mixing"]
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text.encode())
    shares = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    import hashlib

    want = Counter()
    for r in rows:
        rate = shares[r.source] / sum(shares.values()) * sum(size.values()) / size[r.source]
        u, p, n = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52, np.exp(-rate), 0
        c = p
        while u >= c:
            n += 1
            p *= rate / n
            c += p
        want[r.doc_id] += n
    assert Counter(r.doc_id for r in mixed) == +want

    rows, out = steps["token_output"]
    t, start, want = Tokenizer.from_file(vocabulary(ID_VOCABULARY)), 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
