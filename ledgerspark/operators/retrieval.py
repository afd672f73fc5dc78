"""Retrieval: text of table chunks, sparse and dense search, fusion, lexical recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import label_tokens, term_id, tokens
from ..plans.storage import shuffled

RRF_K = 60
#: Rows of a query table that is broadcast at most; beyond it the join is a shuffle.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, else to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def chunk_text(parts: list[Column], most: int) -> Column:
    """Parts that are not blank, one a line, cut to a number of characters."""
    return F.substring(F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: F.trim(x) != ""), "\n"), 1, most)


def payload(catalog: DataFrame, header: int = 400, labels: int = 600) -> DataFrame:
    """Catalog rows for a search index, their texts truncated."""
    return catalog.withColumns({"header_text": F.substring("header_text", 1, header), "row_labels": F.substring("row_labels", 1, labels), "point_id": F.sha2(F.concat_ws("|", "report_id", F.col("table_no").cast("string")), 256)})


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, tf: hashed term frequencies; terms of one bucket add up."""
    return docs.select(key, F.explode(F.transform(tokens(text), lambda t: term_id(t))).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, key: str, total: int) -> DataFrame:
    """bucket, idf: ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = counts.groupBy("bucket").agg(F.count("*").alias("df"))
    return df.select("bucket", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_search(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "qid", text: str = "text") -> DataFrame:
    """query_key, doc_key, score, rank: the k documents with the largest sum of tf * query tf * idf.

    Terms of the queries alone are looked for, so what is shuffled follows the hits."""
    total = docs.count()
    wanted = term_counts(queries, query_key, text).select(query_key, "bucket", F.col("tf").alias("qtf"))
    counts = docs.select(doc_key, F.explode(F.transform(tokens(text), lambda t: term_id(t))).alias("bucket")).join(small(wanted.select("bucket").distinct()), "bucket", "left_semi").groupBy(doc_key, "bucket").agg(F.count("*").alias("tf"))
    weights = idf(counts, doc_key, total)
    hits = counts.join(small(wanted.join(weights, "bucket")), "bucket")
    scored = hits.groupBy(query_key, doc_key).agg(F.round(F.sum(F.col("tf") * F.col("qtf") * F.col("idf")), 6).alias("score"))
    return top_k(scored, k, query_key, doc_key)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "qid", condition: Column | None = None) -> DataFrame:
    """query_key, key, score, rank: the k vectors (key, embedding) nearest to each query (query_key, q) by cosine; the
    condition is applied before scoring. Every vector is scored where it lies, and the best k of each batch go on."""
    pool = vectors if condition is None else vectors.filter(condition)

    def best(s: np.ndarray) -> np.ndarray:
        held = np.where(np.isnan(s), -np.inf, s)
        # What rounding makes equal to the k-th stays: the key decides between equals.
        return held >= np.partition(held, -k, axis=0)[-k] - 2e-6 if len(s) > k else np.ones(s.shape, bool)

    return top_k(near(pool, queries, best, key, query_key), k, query_key, key)


#: Queries that a product of matrices takes at once.
_AT_ONCE = 256


def _cosines(vectors: pa.Array, queries: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The place of the first query, and the cosines of vectors (rows) with some queries: NaN where lengths differ, where an
    element or a vector is null, or one has no length."""

    def matrices(a: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, sizes = a.flatten(), np.diff(a.offsets.to_numpy()) if not a.null_count else None
        if sizes is not None and len(sizes) and (sizes == sizes[0]).all() and not flat.null_count:
            return [(np.arange(len(a)), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), sizes[0]))]
        rows = [(i, v) for i, v in enumerate(a.to_pylist()) if v is not None and None not in v]
        by = {n: [(i, v) for i, v in rows if len(v) == n] for n in {len(v) for _, v in rows}}
        return [(np.array([i for i, _ in x]), np.array([v for _, v in x], np.float64).reshape(len(x), n)) for n, x in by.items()]

    found = matrices(vectors)
    for at in range(0, len(queries), _AT_ONCE):
        part = queries.slice(at, _AT_ONCE)
        out = np.full((len(vectors), len(part)), np.nan)
        for i, v in found:
            for j, q in matrices(part):
                if v.shape[1] == q.shape[1]:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        out[np.ix_(i, j)] = (v @ q.T) / np.sqrt((v * v).sum(1)[:, None] * (q * q).sum(1))
        yield at, out


def near(vectors: DataFrame, queries: DataFrame, pick: Callable[[np.ndarray], np.ndarray], key: str = "vec_id", query_key: str = "qid", keep: tuple[str, ...] = ()) -> DataFrame:
    """query_key, key, columns to keep of the vectors and score (the cosine to 6 places) of the pairs that pick keeps of a
    batch's cosines: products of matrices, vectors where they lie by queries that come to them. As many queries as a
    broadcast may have are looked for at once, more in several passes."""
    spark, parts = queries.sparkSession, -(-queries.count() // BROADCAST_ROWS)
    schema = T.StructType([queries.schema[query_key], *(vectors.schema[c] for c in (key, *keep)), T.StructField("cos", T.DoubleType())])

    def passing(asked: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(asked.select(query_key, "q").toArrow())

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow, ids, wanted = to_arrow_schema(schema), held.value.column(0).combine_chunks(), held.value.column(1).combine_chunks()
            for batch in batches:
                for at, cosines in _cosines(batch.column("embedding"), wanted) if len(batch) and len(wanted) else ():
                    i, j = np.nonzero(pick(cosines))
                    values = cosines[i, j]
                    columns = [ids.take(pa.array(at + j)), *(batch.column(c).take(pa.array(i)) for c in (key, *keep)), pa.array(values, mask=np.isnan(values))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return vectors.select(key, *keep, "embedding").mapInArrow(score, schema)

    found = [passing(queries if parts <= 1 else queries.filter(F.pmod(F.xxhash64(query_key), F.lit(parts)) == n)) for n in range(max(parts, 1))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(query_key, key, *keep, F.round("cos", 6).alias("score"))


def top_k(scored: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """The k best of each query, ranked; ties by key."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def rrf(lists: list[DataFrame], query_key: str, key: str, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: score is the sum of 1 / (constant + rank)."""
    both = None
    for one in lists:
        one = one.select(query_key, key, "rank")
        both = one if both is None else both.unionByName(one)
    fused = both.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return top_k(fused, k, query_key, key)


def with_bonus(ranked: DataFrame, hit: Column, bonus: float, query_key: str, key: str) -> DataFrame:
    """Adds a bonus to hits and ranks anew; equal scores keep their order."""
    out = ranked.withColumn("score", F.round(F.col("score") + F.when(hit, bonus).otherwise(0.0), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.col("rank"), key)))


def relaxed(strict: DataFrame, loose: DataFrame, query_key: str) -> DataFrame:
    """The strict results, and for queries without any the loose ones."""
    return strict.unionByName(loose.join(strict.select(query_key).distinct(), query_key, "left_anti"))


def label_index(rows: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, keys) of labels without repeats, and each entry's shortest label (the first of equals)."""
    postings = rows.select(*keys, F.explode(label_tokens(label)).alias("token")).distinct()
    best = rows.groupBy(*keys).agg(F.min(F.struct(F.length(label).alias("n"), F.col(label).alias("l"))).alias("m")).select(*keys, F.col("m.l").alias("label"))
    return postings, best


def lexical_search(postings: DataFrame, query_tokens: DataFrame, keys: list[str], query_key: str = "qid", least: int = 2) -> DataFrame:
    """query_key, keys, hits, score (hits over the query's tokens, to 3 places) of entries with enough of its tokens."""
    wanted = query_tokens.select(query_key, "token").distinct()
    sizes = wanted.groupBy(query_key).agg(F.count("*").alias("n"))
    hits = postings.join(small(wanted), "token").groupBy(query_key, *keys).agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)
    return hits.join(small(sizes), query_key).select(query_key, *keys, "hits", F.round(F.col("hits") / F.col("n"), 3).alias("score"))


def add_recall(results: DataFrame, lexical: DataFrame, query_key: str, key: str, most: int = 4, weight: float = 0.5) -> DataFrame:
    """Appends the best lexical hits that the results lack, at a share of their score."""
    new = lexical.select(query_key, key, "score").join(results.select(query_key, key), [query_key, key], "left_anti")
    new = top_k(new, most, query_key, key).withColumn("score", F.round(F.col("score") * weight, 9))
    last = results.groupBy(query_key).agg(F.max("rank").alias("last"))
    new = new.join(last, query_key, "left").withColumn("rank", F.col("rank") + F.coalesce("last", F.lit(0)))
    return results.select(query_key, key, "score", "rank").unionByName(new.select(query_key, key, "score", "rank"))


def rerank(ranked: DataFrame, query: str, doc: str, query_key: str, key: str, scorer=None, k: int = 10) -> DataFrame:
    """Ranks anew by a scorer of pairs: (query column, document column) to a column; by default the share of the query's
    tokens that the document has. A model comes in as a pandas_udf."""
    share = lambda q, d: F.size(F.array_intersect(tokens(q), tokens(d))) / F.greatest(F.size(F.array_distinct(tokens(q))), F.lit(1))
    return top_k(ranked.drop("score", "rank").withColumn("score", F.round((scorer or share)(F.col(query), F.col(doc)), 6)), k, query_key, key)


def hashing_embedding(text: str, dim: int = 64) -> Column:
    """An offline encoder: signed term counts in `dim` buckets."""
    found = F.transform(tokens(text), lambda t: F.xxhash64(t))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.aggregate(F.filter(found, lambda h: F.pmod(h, F.lit(dim)) == b), F.lit(0.0), lambda s, h: s + F.when(h % 2 == 0, 1.0).otherwise(-1.0)).cast("float"))


def uncached(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts whose content hash is not in the cache (hash, ...) yet."""
    return texts.withColumn("hash", F.md5(text)).join(cache.select("hash"), "hash", "left_anti")
