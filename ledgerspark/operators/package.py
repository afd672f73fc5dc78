"""Packaging of answers and the figures about them."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import tier


def last_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def fill_missing(keys: DataFrame, records: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A record for every key, missing ones and null fields by default."""
    out = keys.select(key).distinct().join(records, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def used_variables(program: str) -> Column:
    """Variables df1, df2, ... that a program names, in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(program), F.lit("")), F.lit(r"\b(df\d+)\b"), F.lit(1)))


def prune_inputs(evidence: Column, program: str) -> Column:
    """The entries of an evidence array (structs with variable) that the program uses."""
    used = used_variables(program)
    return F.filter(evidence, lambda e: F.array_contains(used, e["variable"]))


def renumber(program: str, kept: list[str]) -> str:
    """Renames the kept variables to df1, df2, ... at once."""
    names = {v: f"df{i + 1}" for i, v in enumerate(kept)}
    return re.sub(r"\bdf\d+\b", lambda m: names.get(m[0], m[0]), program)


def table_reference(report: str, table: str, line: str) -> Column:
    """report|line where the line is known, else report|table_N."""
    return F.concat_ws("|", F.col(report), F.coalesce(F.nullif(F.col(line), F.lit(0)).cast("string"), F.concat(F.lit("table_"), F.col(table).cast("string"))))


def validate(stored: DataFrame, executed: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """key, status of each stored answer: ok, mismatch, or crash (nothing executed)."""
    joined = stored.select(key, F.col("answer").alias("__a")).join(executed.select(key, F.col("answer").alias("__b")), key, "left")
    return joined.select(key, F.when(F.col("__b").isNull(), "crash").when(F.abs(F.col("__a") - F.col("__b")) <= tolerance, "ok").otherwise("mismatch").alias("status"))


def histogram(df: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """bucket and n, zero counts included."""
    every = df.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    return every.join(df.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latency(df: DataFrame, value: str) -> DataFrame:
    """Upper median and 95th percentile, as elements of the sorted values: floor(n / 2) and floor(0.95 n), from 0. Values are
    written in sorted files, one for each range; counts of the files say which row of which file has a rank, so no task or
    array holds all values."""
    ordered = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    rows = tier(ordered.repartitionByRange("v").sortWithinPartitions("v"), "latency").select("v", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("v").alias("least")).orderBy("least").collect()  # a row for each range
    n, before, wanted = sum(f.n for f in files), 0, {}
    for f in files:
        for name, k in (("median", n // 2), ("p95", min(95 * n // 100, n - 1))):
            if before <= k < before + f.n:
                wanted[name] = (F.col("file") == f.file) & (F.col("at") == k - before)
        before += f.n
    if not n:
        return df.sparkSession.createDataFrame([(None, None)], "median double, p95 double")
    return rows.agg(*(F.max(F.when(wanted[name], F.col("v"))).alias(name) for name in ("median", "p95")))


def run_metrics(questions: DataFrame) -> DataFrame:
    """One row: n, coverage, ticker_rate, year_rate, mean_facts of questions with n_results, n_tickers, n_years, n_facts."""
    share = lambda c: F.coalesce(F.round(F.avg((F.coalesce(F.col(c), F.lit(0)) > 0).cast("double")), 6), F.lit(0.0))
    return questions.agg(F.count("*").alias("n"), share("n_results").alias("coverage"), share("n_tickers").alias("ticker_rate"), share("n_years").alias("year_rate"), F.coalesce(F.round(F.avg("n_facts"), 6), F.lit(0.0)).alias("mean_facts"))


def topk_lines(questions: DataFrame, hits: DataFrame, entities: list[str], key: str = "id", text: str = "question", table: str = "table_key", score: str = "score", rank: str = "rank") -> DataFrame:
    """id, question, entity_json and topk of every question: its entity columns as JSON (empty where null), and its hits as
    table|score;table|score in the order of their ranks, scores to four places. A question without hits has an empty topk.
    hits hold at most k rows of a question, so its list is as long as k."""
    one = F.concat_ws("|", F.col(table).cast("string"), F.format_string("%.4f", F.col(score).cast("double")))
    lists = hits.groupBy(F.col(key).alias("__id")).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), one.alias("hit")))).alias("hits"))
    out = questions.join(lists, F.col(key) == F.col("__id"), "left")
    topk = F.coalesce(F.array_join(F.col("hits.hit"), ";"), F.lit(""))
    return out.select(F.col(key).alias("id"), F.col(text).alias("question"), F.to_json(F.struct(*entities)).alias("entity_json"), topk.alias("topk"))


def sample_records(records: DataFrame, n: int = 100, key: str = "id") -> DataFrame:
    """At most n records, those with another answer than 0 first, then by a hash of the key, so that a run can be repeated."""
    return records.orderBy(F.coalesce(F.col("answer") == 0, F.lit(True)), F.md5(F.col(key).cast("string")), key).limit(n)


def table_counts(reports: DataFrame, kind: str, text: str) -> DataFrame:
    """kind, n_reports and n_tables: how many tables the texts of each kind open."""
    tables = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?i)<table\\b"), F.lit(0)))
    return reports.select(F.col(kind), tables.alias("t")).groupBy(kind).agg(F.count("*").alias("n_reports"), F.sum("t").cast("long").alias("n_tables"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, in one pass."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, n)"))


def pack(folder: str | Path, out: str | Path) -> dict:
    """Zips a submission folder with one root JSON: entries sorted, hashes in the manifest that is returned."""
    folder = Path(folder)
    files = sorted(p for p in folder.rglob("*") if p.is_file())
    roots = [p for p in files if p.parent == folder and p.suffix == ".json"]
    if len(roots) != 1:
        raise ValueError(f"one JSON file is wanted in {folder}, not {len(roots)}")
    manifest = {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(folder)))
    return {"files": manifest, "sha256": hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()}
