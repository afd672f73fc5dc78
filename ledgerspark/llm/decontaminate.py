"""Benchmark decontamination: word windows of documents against the hash set of the benchmark's windows.

The items' distinct windows, with the items that have them, are one table with a row per window, keyed by a 64-bit
hash of the words. Up to MAX_WINDOWS rows of it are sent to all tasks (their size is checked); beyond that the same
join is a shuffle on the hash, whose keys on the documents' side are spread by words. A hit is verified on the words
themselves. Only DataFrame functions are used.

Defined results: null and empty texts have no words and are not contaminated. Repeated rows each get their result;
rows of one doc_id and different texts are told apart by the text's hash. Items without words match nothing; items of
equal text all count. Empty tables on either side leave all documents clean. Of the inputs only doc_id and text, and
item_id and text, are read; drop() and cut() keep the other columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, stored

WINDOW, MAX_WINDOWS = 10, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> F.Column:
    """The words of a text: A-Z lower-cased, cut at all other ASCII characters than letters and digits; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def windows_of(bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row per distinct window of the items: h, w_len, w_words and the items (sorted) that have it."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), words().alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(n))).withColumn("at", F.explode(F.expr("sequence(1, size(w) - k + 1)")))
    each = items.select("item", F.col("k").alias("w_len"), F.expr("slice(w, at, k)").alias("w_words"))
    return each.groupBy("w_len", "w_words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("w_words"))


def hits(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row per verified occurrence of a window: doc_id, text_hash, at (first word, from 1), w_len, items."""
    table = stored(windows_of(bench, n), "decon-windows")
    lengths = sorted(r[0] for r in table.select("w_len").distinct().collect())  # n at most
    if not lengths:
        lengths = [n]
    side = F.broadcast(table) if fits(table, MAX_WINDOWS) else table
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words().alias("w"))
    found = None
    for k in lengths:
        hashed = F.expr(f"if(size(w) >= {k}, transform(sequence(1, greatest(size(w) - {k} + 1, 1)), i -> named_struct('at', i, 'h', xxhash64(slice(w, i, {k})))), null)")
        part = each.select("doc_id", "text_hash", "w", F.explode(hashed).alias("x")).select("doc_id", "text_hash", F.col("x.at").alias("at"), F.col("x.h").alias("g"), F.expr(f"slice(w, x.at, {k})").alias("got"))
        # Equality of the words as two inequalities: a check of hash matches, not a part of the join's key.
        same = (F.col("got") <= F.col("w_words")) & (F.col("got") >= F.col("w_words"))
        part = part.join(side.filter(F.col("w_len") == k), (F.col("g") == F.col("h")) & same).select("doc_id", "text_hash", "at", "w_len", "items")
        found = part if found is None else found.unionByName(part)
    return found


def per_text(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_hit (words inside hits), items and spans (of word numbers, in order) of texts with hits."""
    found = hits(docs, bench, n).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", "w_len"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # In order of their starts: an occurrence either lengthens the last span or begins another.
    spans = F.expr("""aggregate(s, cast(array() as array<struct<a: int, b: int>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).b >= x.at - 1,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.at + x.w_len - 1)))),
           concat(acc, array(named_struct('a', x.at, 'b', x.at + x.w_len - 1)))))""")
    return found.select("doc_id", "text_hash", "items", spans.alias("spans")).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.b - x.a + 1)"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans and contaminated of every row."""
    found = per_text(docs, bench, n).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "items", "spans", "n_hit")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.size(words()).cast("long").alias("n_words"))
    joined = each.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    bad = F.col("n_hit").isNotNull()
    return joined.select("doc_id", "text_hash", "n_words", F.when(bad, F.col("n_hit")).otherwise(0).cast("long").alias("n_hit"), F.when(bad, F.size("items")).otherwise(0).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), "spans", bad.alias("contaminated"))


def _dirty(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    return per_text(docs, bench, n).select(F.col("doc_id").alias("__decon_doc"), F.col("text_hash").alias("__decon_text"), F.col("spans").alias("__decon_spans"))


def drop(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, whose text has no window of the benchmark."""
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__decon_doc")) & (F.xxhash64("text") == F.col("__decon_text"))
    return docs.join(_dirty(docs, bench, n), on, "left_anti")


def cut(docs: DataFrame, bench: DataFrame, n: int = WINDOW) -> DataFrame:
    """All rows of docs, the words of hits cut from the texts that have any (their other words are joined by spaces)."""
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__decon_doc")) & (F.xxhash64("text") == F.col("__decon_text"))
    rest = F.expr("array_join(filter(__decon_words, (x, i) -> not exists(__decon_spans, s -> i + 1 between s.a and s.b)), ' ')")
    joined = docs.join(_dirty(docs, bench, n), on, "left").withColumn("__decon_words", F.when(F.col("__decon_spans").isNotNull(), words()))
    return joined.withColumn("text", F.when(F.col("__decon_spans").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)
