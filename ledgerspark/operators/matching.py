"""Labels that fit what a question asks for, found by a prefix-filter join instead of scoring every label of a key.

A score from the threshold on needs a least number of the metric's tokens in the label (`least_hits`). Of a metric's m tokens,
any m - least + 1 therefore hold one that the label has: the rarest of its key's labels are taken, and only labels with
one of those are scored. Labels are distinct before that, each with its first row, as equal labels score the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shuffled
from .answer import THRESHOLD, label_score

BONUS, SLACK = 0.15, 1e-6


def least_hits(metric: Column, coded: Column, least: float = THRESHOLD) -> Column:
    """Tokens of a metric, repeats counted, that a label must have to score `least`: a label of one token is the shortest,
    so 0.8 h / m + 0.1 (1 - 1 / m) + bonus is the most that h hits can score."""
    m = F.size(metric).cast("double")
    most_beside = F.lit(0.1) * (1 - 1 / m) + F.when(coded, BONUS).otherwise(0.0)
    return F.greatest(F.lit(1), F.ceil(m * (least - most_beside) / 0.8 - SLACK)).cast("int")


def label_index(rows: DataFrame, keys: list[str], words: Column, coded: Column, order: list[str], keep: list[str]) -> DataFrame:
    """keys, coded, words and first (keep and order of the first row) of every distinct label; map-side combined."""
    labelled = rows.withColumns({"words": words, "coded": coded}).filter(F.size("words") > 0)
    first = F.min_by(F.struct(*dict.fromkeys([*keep, *order])), F.struct(*order))
    return labelled.groupBy(*keys, "coded", "words").agg(first.alias("first"))


def candidates(asks: DataFrame, index: DataFrame, keys: list[str], bonus: bool = True) -> DataFrame:
    """asks' columns, coded, words and first of every pair that is worth scoring, each once. asks: ask (its identity), keys,
    metric. Without bonus labels are indexed as not coded."""
    on = [*keys, "coded"]
    postings = index.select(*on, "words", "first", F.explode(F.array_distinct("words")).alias("token"))
    frequency = postings.groupBy(*on, "token").agg(F.count("*").alias("n"))
    both = asks.filter(F.size("metric") > 0).withColumn("coded", F.explode(F.array(F.lit(False), F.lit(True)) if bonus else F.array(F.lit(False))))
    tokens = both.select("ask", *on, "metric", F.explode(F.array_distinct("metric")).alias("token"))
    tokens = tokens.withColumn("times", F.size(F.expr("filter(metric, t -> t = token)")))
    ranked = tokens.join(shuffled(frequency), [*on, "token"], "left").groupBy("ask", *on, "metric").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "times"))).alias("ranked"))
    # Tokens from the rarest on, until they are more than all but least_hits; those of no label are of no use, but count.
    spare = F.size("metric") - least_hits(F.col("metric"), F.col("coded"))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("taken"))
    taken = F.aggregate("ranked", start, lambda acc, r: F.when(acc["sum"] <= F.col("spare"), F.struct((acc["sum"] + r["times"]).alias("sum"), F.when(r["n"] > 0, F.concat(acc["taken"], F.array(r["token"]))).otherwise(acc["taken"]).alias("taken"))).otherwise(acc))
    prefix = ranked.withColumn("spare", spare).withColumn("prefix", taken["taken"]).select("ask", *on, "metric", "prefix", F.explode("prefix").alias("token"))
    # A pair meets under each common token of the prefix; it counts under the first.
    pairs = prefix.join(shuffled(postings), [*on, "token"]).filter(F.get(F.expr("filter(prefix, t -> array_contains(words, t))"), F.lit(0)) == F.col("token"))
    return pairs.drop("prefix", "token")


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with their score, from the threshold on."""
    score = F.round(label_score(F.col("words"), F.col("metric"), F.col("coded")), 9)
    return pairs.withColumn("score", score).filter(F.col("score") >= THRESHOLD)
