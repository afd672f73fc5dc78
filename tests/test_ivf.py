"""Approximate search against search that scores every vector."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import ivf, retrieval
from ledgerspark.queries import search
from ledgerspark.sources.readers import table


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    """Queries are the vectors whose id is divisible by 100, against all rows."""
    path = f"/root/testdata/{sf}"
    v = table(spark, path, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = search.ivf_topk(spark, path)
    truth = retrieval.dense_search(v, asked, 10)
    got = ivf.recall(found, truth).first()
    assert got.n == 10 * asked.count() and got.recall >= 0.9, got
    assert found.count() == got.n
    # Scores are exact, whatever was found.
    both = found.join(truth.withColumnRenamed("score", "exact"), ["qid", "vec_id"])
    assert both.filter("score <> exact").count() == 0


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(80, 32))
    x = centres[rng.integers(0, 80, 6000)] + rng.normal(size=(6000, 32)) * 0.25
    v = spark.createDataFrame([(k, [float(a) for a in r]) for k, r in enumerate(x)], "vec_id int, embedding array<float>")
    index = ivf.build(v, "vec_id", "embedding", 64, str(tmp_path / "c"))
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    read = ivf.probes(index, asked, "qid", 4).join(index.rows.groupBy("list").count(), "list").agg(F.sum("count")).first()[0]
    assert read < 0.15 * 6000 * 60 and index.rows.count() == 6000
    assert ivf.recall(ivf.search(index, asked, 10, 4), retrieval.dense_search(v, asked, 10)).first().recall >= 0.9


def test_all_lists_give_exact_results(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 16)), np.tile(rng.normal(size=(1, 16)), (300, 1))])  # a third are equal
    rows = [(k, [float(a) for a in r]) for k, r in enumerate(x)] + [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    ivf.build(v, "vec_id", "embedding", 12, str(tmp_path / "i"))
    index = ivf.load(spark, str(tmp_path / "i"))
    asked = v.filter("vec_id < 580").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")).filter("qid % 20 = 0 or qid < 0")
    truth = retrieval.dense_search(ivf.usable(v, "embedding"), ivf.usable(asked, "q"), 5)
    got = ivf.search(index, asked, 5, 12)
    assert sorted(map(tuple, got.select("qid", "vec_id", "rank").collect())) == sorted(map(tuple, truth.select("qid", "vec_id", "rank").collect()))


def test_bytes_keep_directions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 64)).astype(np.float32) * rng.uniform(1e-3, 1e3, (50, 1)).astype(np.float32)
    c = ivf.codes(x).astype(np.float32)
    cos = (x * c).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(c, axis=1)
    assert cos.min() > 0.999


def test_empty_tables(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id int, embedding array<float>")
    asked = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    none = ivf.build(v.limit(0), "vec_id", "embedding", 4, str(tmp_path / "n"))
    assert ivf.search(none, asked.limit(0), 3, 2).count() == 0 and none.rows.count() == 0
    index = ivf.build(v, "vec_id", "embedding", 4, str(tmp_path / "v"))
    assert ivf.search(index, asked.limit(0), 3, 2).count() == 0
    assert sorted((r.qid, r.vec_id) for r in ivf.search(index, asked, 3, 2).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("rows", [3, 10_000])
def test_products_of_matrices_give_each_pair_its_cosine(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(5)
    made = [(k, [round(float(rng.normal()), 1) for _ in range(4)]) for k in range(60)] + [(70, None), (71, [1.0, None, 2.0, 0.0]), (72, [1.0, 2.0]), (73, []), (74, [1.0, 0.0, 0.0, 0.0]), (75, [2.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3)
    queries = vectors.filter("vec_id % 7 = 0 or vec_id in (72, 74)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    pairs = vectors.filter("vec_id <> 73").join(queries).select("qid", "vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    want = sorted(map(repr, retrieval.top_k(pairs, 5, "qid", "vec_id").collect()))
    got = retrieval.dense_search(vectors.filter("vec_id <> 73"), queries, 5)
    assert sorted(map(repr, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    near = retrieval.near(vectors, queries, lambda c: c >= 0.9 - 2e-6).filter("score >= 0.9")
    assert sorted(map(repr, near.select("qid", "vec_id", "score").collect())) == sorted(map(repr, pairs.filter("score >= 0.9").collect()))
