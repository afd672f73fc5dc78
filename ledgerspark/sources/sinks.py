"""Sinks: idempotent partitions, records, quarantine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import tier

#: Column names of evidence files.
EVIDENCE = {"item": "chi_tieu", "code": "Mãsố", "period": "ky", "value": "value"}


def write_partitions(df: DataFrame, path: str, by: str = "ticker") -> None:
    """Replaces the partitions that df has rows for; others stay. A run can be repeated. A large partition is written by
    several tasks."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_partitions(new: DataFrame, path: str, keys: list[str], by: str = "ticker") -> None:
    """new over the stored rows by keys (which with by identify a row); only partitions that new has rows for are read and
    written, the files of others stay as they are. What is written is staged first, so a run that is cut changes nothing."""
    spark = new.sparkSession
    new = tier(new, "merge-new")
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_partitions(new, path, by)
        return
    touched = old.join(F.broadcast(new.select(by).distinct()) if fits(new.select(by).distinct()) else new.select(by).distinct(), by, "left_semi")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [by, *keys]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    kept = touched.alias("o").join(new.select(by, *keys).alias("n"), condition, "left_anti")
    write_partitions(tier(kept.select(new.columns).unionByName(new), "merge-rows"), path, by)


def fits(df: DataFrame, rows: int = 10_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_evidence(tidy: DataFrame, path: str, by: list[str]) -> None:
    """Evidence as CSV under its public column names, values to six places, nulls as empty."""
    out = tidy.select(*by, *(F.col(k).alias(v) for k, v in EVIDENCE.items()))
    out.withColumn("value", F.format_string("%.6f", "value")).write.mode("overwrite").option("header", True).option("nullValue", "").partitionBy(*by).csv(path)


def write_topk(lines: DataFrame, path: str) -> None:
    """Retrieval lines (id, question, entity_json, topk) as CSV files with a header; quotes are doubled, so JSON and line
    breaks are read back as they were."""
    lines.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_topk(spark: SparkSession, path: str) -> DataFrame:
    """What write_topk() wrote, a row for each hit: id, rank (from 1), table_key, score. Questions without hits have none."""
    raw = spark.read.schema("id long, question string, entity_json string, topk string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    hits = raw.filter("topk <> ''").select("id", F.posexplode(F.split("topk", ";")).alias("at", "hit"))
    score = F.element_at(F.split("hit", r"\|"), -1)
    return hits.select("id", (F.col("at") + 1).alias("rank"), F.expr("substr(hit, 1, length(hit) - length(substring_index(hit, '|', -1)) - 1)").alias("table_key"), score.cast("double").alias("score"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row of figures as a JSON file."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def split_quarantine(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old by key; writing the same rows again changes nothing."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
