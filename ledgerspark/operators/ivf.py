"""Approximate nearest vectors by cosine: an inverted file of centroids, one byte a dimension, and exact scores at the end.

Centroids are fitted on a bounded sample (`FIT_ROWS` rows, those with the least hashes of their keys); every row is then
indexed: it goes to the folder of its nearest centroid, with its direction as signed bytes beside the vector itself. A query
looks into the folders of its nearest centroids. Rows of a folder come in chunks and queries in blocks of bounded size; a
chunk meets a block as one matrix product over the bytes, and only the best of each go on. The best few of a query over all
chunks get their exact cosine, so every score that is returned is exact; what can be missing are rows whose folder was not
looked into or whose bytes scored too low.

A folder may hold a third of all rows: it is written by ranges of (folder, hash), and its chunks are rows of their own.
Defined results: null vectors, and those of length 0 or with other than finite numbers, are not indexed and find nothing. All
vectors have one dimension.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir, tier
from .retrieval import cosine, top_k

#: Rows that centroids are fitted on, and rounds of fitting; rows of a chunk and queries of a block; bytes of query blocks
#: that are broadcast at most; candidates that are scored exactly, for each result.
FIT_ROWS, ROUNDS, CHUNK, QUERIES, BROADCAST_BYTES, RESCORED = 20_000, 12, 4096, 512, 32 << 20, 4


@dataclass
class Index:
    """rows: list (folder), key, code (a byte a dimension), embedding; centroids: one in each row, of length 1."""

    rows: DataFrame
    centroids: np.ndarray


def fit(vectors: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of length 1 (spherical k-means). Begins with rows far apart, refills empty lists with the worst-placed rows."""
    rng = np.random.default_rng(seed)
    x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    lists = min(lists, len(x))
    chosen, near = [int(rng.integers(len(x)))], np.full(len(x), -1, np.float32)
    for _ in range(lists - 1):
        near = np.maximum(near, x @ x[chosen[-1]])
        far = np.maximum(1 - near, 1e-12).astype(np.float64)
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    centroids = x[chosen]
    for _ in range(ROUNDS):
        score = x @ centroids.T
        best = score.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        sums[empty] = x[np.argsort(score.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids).astype(np.float32)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float32)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def codes(x: np.ndarray) -> np.ndarray:
    """Directions as signed bytes: the largest part of each is 127."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def usable(vectors: DataFrame, embedding: str) -> DataFrame:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vectors.filter(F.col(embedding).isNotNull() & F.forall(embedding, number) & F.exists(embedding, lambda v: v != 0))


def build(vectors: DataFrame, key: str, embedding: str, lists: int, path: str | None = None) -> Index:
    """Writes an index of vectors to a folder and opens it."""
    spark = vectors.sparkSession
    path = path or f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    rows = usable(vectors.select(F.col(key).alias("key"), F.col(embedding).cast("array<float>").alias("embedding")), "embedding")
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("embedding").collect()
    dim = len(sample[0].embedding) if sample else 0
    centroids = fit(np.array([r.embedding for r in sample], np.float32), lists) if sample else np.empty((0, 0), np.float32)
    kind = rows.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            best = (x @ centroids.T).argmax(axis=1).astype(np.int32)
            code = pa.array([c.tobytes() for c in codes(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(best), batch.column("key"), code, batch.column("embedding")], ["list", "key", "code", "embedding"])

    placed = rows.mapInArrow(place, f"list int, key {kind}, code binary, embedding array<float>")
    order = ["list", F.xxhash64("key"), "key"]
    placed.repartitionByRange(*order).sortWithinPartitions("list", "key").write.partitionBy("list").parquet(f"{path}/rows")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<float>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(kind, dim)], "kind string, dim int").write.parquet(f"{path}/about")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    centroids = [r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]  # as many as the index has folders
    rows = spark.read.schema(f"key {about.kind}, code binary, embedding array<float>, list int").parquet(f"{path}/rows")
    return Index(rows, np.array(centroids, np.float32).reshape(len(centroids), about.dim))


def probes(index: Index, queries: DataFrame, query_key: str, probe: int) -> DataFrame:
    """query_key, list, q: each query with its nearest lists."""
    centroids, kind = index.centroids, queries.schema[query_key].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = _matrix(batch.column("q")) @ centroids.T
            n = min(probe, score.shape[1])
            best = np.argpartition(-score, n - 1, axis=1)[:, :n].astype(np.int32)
            at = np.repeat(np.arange(batch.num_rows), n)
            yield pa.RecordBatch.from_arrays([batch.column(query_key).take(pa.array(at)), pa.array(best.ravel()), batch.column("q").take(pa.array(at))], [query_key, "list", "q"])

    return usable(queries.select(query_key, F.col("q").cast("array<float>").alias("q")), "q").mapInArrow(nearest, f"{query_key} {kind}, list int, q array<float>")


def candidates(index: Index, asked: DataFrame, query_key: str, most: int) -> DataFrame:
    """query_key, key, list, near: the best by bytes, over all lists that a query looks into."""
    kinds = {c: df.schema[c].dataType.simpleString() for c, df in ((query_key, asked), ("key", index.rows))}
    part = lambda c, size: F.pmod(F.xxhash64(c), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long"))
    sizes = lambda df: df.groupBy("list").agg(F.count("*").alias("n"))  # noqa: E731  a row for each list, map-side combined
    rows = index.rows.select("list", "key", "code")
    chunks = rows.join(F.broadcast(sizes(rows)), "list").groupBy("list", part("key", CHUNK).alias("c")).agg(F.collect_list("key").alias("keys"), F.collect_list("code").alias("codes"))
    blocks = asked.join(F.broadcast(sizes(asked)), "list").groupBy("list", part(query_key, QUERIES).alias("b")).agg(F.collect_list(query_key).alias("ids"), F.collect_list("q").alias("qs"))
    size = asked.count() * (4 * index.centroids.shape[1] + 16)
    blocks = F.broadcast(blocks) if size <= BROADCAST_BYTES else blocks

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids = batch.column("keys")[i].values, batch.column("ids")[i].values
                if not len(keys) or not len(ids):
                    continue
                x = np.frombuffer(b"".join(batch.column("codes")[i].as_py()), np.int8).reshape(len(keys), -1).astype(np.float32)
                q = np.array(batch.column("qs")[i].as_py(), np.float32)
                score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                n = min(most, len(keys))
                top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                near = np.take_along_axis(score, top, axis=1).ravel()
                lists = pa.array(np.full(len(near), batch.column("list")[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), n))), keys.take(pa.array(top.ravel())), lists, pa.array(near, pa.float32())], [query_key, "key", "list", "near"])

    found = chunks.join(blocks, "list").select("list", "keys", "codes", "ids", "qs").mapInArrow(best, f"{query_key} {kinds[query_key]}, key {kinds['key']}, list int, near float")
    return top_k(found.withColumnRenamed("near", "score"), most, query_key, "key").select(query_key, "key", "list")


def search(index: Index, queries: DataFrame, k: int, probe: int, query_key: str = "qid", key: str = "vec_id") -> DataFrame:
    """query_key, key, score (the exact cosine), rank of nearest vectors; queries: query_key, q."""
    asked = tier(probes(index, queries, query_key, probe), "ivf-probes")
    found = tier(candidates(index, asked, query_key, RESCORED * k), "ivf-candidates")
    own = asked.groupBy(query_key).agg(F.first("q").alias("q"))
    scored = index.rows.select("list", "key", "embedding").join(found.join(own, query_key), ["list", "key"])
    return top_k(scored.select(query_key, F.col("key").alias(key), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")), k, query_key, key)


def recall(found: DataFrame, truth: DataFrame, query_key: str = "qid", key: str = "vec_id") -> DataFrame:
    """One row: n (results of the truth) and recall (the share that was found)."""
    hits = truth.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return hits.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
