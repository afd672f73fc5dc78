"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the mix, over its share of the corpus. A document's count is
drawn by inverting the Poisson distribution of that mean at a number in [0, 1) that is a hash of seed and doc_id: the
same on every run, whatever the partitions. Documents are exploded by their counts, and the copies shuffled by a hash.

The counts need a row per source only. While there are at most MAX_SOURCES of these, they are sent to all tasks and no
text moves before the final shuffle; beyond that the sources are joined, with documents salted, as one may be hot.

Defined results: a null source is a source of its own; a null text has size 0; a source without any text has rate 0.
Repeated rows draw the same count each. An empty table gives an empty table. All columns of the input stay, and `copy`
(1, 2, ...) and `mix_order` (long; the mix is in ascending order of it) are added, in place of any that have these names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, stored

MAX_SOURCES, SALTS, SEED, TEMPERATURE = 10_000, 64, 17, 0.5
def uniform(seed: int) -> F.Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: float) -> np.ndarray:
    """The distribution function's values at 0, 1, ...; beyond rate + 12 * sqrt(rate) + 12, where it is cut, lies less than
    1e-15. Terms are relative to that of the mode, by sums of logarithms, as exp(-rate) is 0 in doubles from a rate of 746."""
    mode, last = math.floor(rate), math.ceil(rate + 12 * math.sqrt(rate) + 12)
    with np.errstate(divide="ignore"):
        above = np.cumsum(np.log(rate / np.arange(mode + 1, last + 1)))
        below = np.cumsum(np.log(np.arange(mode, 0, -1) / rate)) if mode else np.zeros(0)
    out = np.cumsum(np.exp(np.concatenate([below[::-1], [0.0], above])))
    return out / out[-1]


def poisson_table(rate: str) -> F.Column:
    """poisson_cdf() of a column of rates, as arrays; in Python, where running sums take linear time."""
    table = F.pandas_udf(lambda rates: rates.map(lambda r: None if np.isnan(r) else poisson_cdf(r)), "array<double>")
    return table(F.col(rate))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, size (bytes of text), rate and cdf. Target shares are the weights, or the sizes to the power `temperature`."""
    size = docs.select("source", F.octet_length("text").alias("b")).groupBy("source").agg(F.coalesce(F.sum("b"), F.lit(0)).cast("double").alias("size"))
    size = stored(size, "mix-sizes")
    if weights is None:
        target = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    size = size.withColumn("target", target)
    total = size.agg(F.sum("size"), F.sum("target")).first()
    all_bytes, all_targets = total[0] or 1.0, total[1] or 1.0
    rate = F.when(F.col("size") > 0, F.col("target") / F.lit(all_targets) * F.lit(all_bytes) / F.col("size")).otherwise(0.0)
    return size.withColumn("rate", rate).withColumn("cdf", poisson_table("rate")).select("source", "size", "rate", "cdf")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mix: docs repeated by their counts, dealt out and sorted by mix_order."""
    columns = [c for c in docs.columns if c not in ("copy", "mix_order")]
    table = rates(docs, weights, temperature).select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf"))
    docs = docs.select(*columns)
    if fits(table, MAX_SOURCES):
        joined = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__mix_source")))
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        salted = table.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__mix_at", salt).join(salted, F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_at") == F.col("__mix_salt")))
    count = F.size(F.filter("__mix_cdf", lambda c: c <= F.col("__mix_u")))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = joined.withColumn("__mix_u", uniform(seed)).withColumn("__mix_n", count).filter("__mix_n > 0")
    copies = copies.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("copy")).withColumn("mix_order", order)
    return copies.repartitionByRange(F.col("mix_order"), F.col("doc_id")).sortWithinPartitions("mix_order", "doc_id")


