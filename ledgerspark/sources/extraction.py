"""From reports to stored tables, run by run: what fails is set aside with its reason, what is done is not done again.

Under a folder lie `tables` (Parquet by ticker: the tables of reports that could be read whole) and `quarantine` (a row for
each failure: report_id, ticker, table_no, error). A report with a failing table is quarantined whole, the others are not
touched by it. `extract` takes reports that are in neither; `retry` takes the quarantined ones alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..plans.storage import tier
from .sinks import merge_partitions, split_quarantine

QUARANTINE = "report_id string, table_no int, error string, ticker string"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet folder, or None if there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def parsed_tables(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the reports (report_id, ticker, year, report_type, text) that parse whole, and the failures of the others."""
    keys = reports.select("report_id", "ticker", "year", "report_type")
    found = tier(grid.parsed(grid.tables(reports.select("report_id", "text"))), "parsed-tables")
    good, bad = split_quarantine(found)
    bad = bad.join(keys, "report_id").select("report_id", "table_no", "error", "ticker")
    good = good.drop("html").join(bad.select("report_id").distinct(), "report_id", "left_anti")
    return good.join(keys, "report_id"), bad


def extract(reports: DataFrame, folder: str) -> DataFrame:
    """Stores the tables of reports that are neither stored nor quarantined; returns this run's failures."""
    spark = reports.sparkSession
    todo = reports
    for name in ("tables", "quarantine"):
        have = stored(spark, f"{folder}/{name}")
        todo = todo if have is None else todo.join(have.select("report_id").distinct(), "report_id", "left_anti")
    return _run(tier(todo, "reports-to-do"), folder)


def retry(reports: DataFrame, folder: str) -> DataFrame:
    """Runs the quarantined reports alone again; those that parse now are stored and leave the quarantine."""
    spark = reports.sparkSession
    have = stored(spark, f"{folder}/quarantine", QUARANTINE)
    if have is None:
        return spark.createDataFrame([], QUARANTINE)
    return _run(tier(reports.join(have.select("report_id").distinct(), "report_id", "left_semi"), "reports-to-retry"), folder)


def _run(reports: DataFrame, folder: str) -> DataFrame:
    spark = reports.sparkSession
    good, bad = parsed_tables(reports)
    bad = tier(bad, "failures")
    merge_partitions(good, f"{folder}/tables", ["report_id", "table_no"])
    # Failures of other reports stay. The new list is staged, then takes the old one's place.
    have = stored(spark, f"{folder}/quarantine", QUARANTINE)
    rest = bad if have is None else have.join(reports.select("report_id"), "report_id", "left_anti").select(bad.columns).unionByName(bad)
    tier(rest, "quarantine").write.mode("overwrite").parquet(f"{folder}/quarantine")
    return bad


def answer_all(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, chunks: int = 16, seconds: float | None = None) -> dict:
    """Answers questions (id, ...) chunk by chunk and appends the records; ids that have one are left out, so a run that was
    cut goes on where it was. A chunk (a fixed part of the ids, by their hash) that takes longer than so many seconds is
    cancelled and gets fallback records: answer 0, error `time limit`.

    answer: questions to records (id, answer and more). Records are Parquet under path, each with error (null if none).
    Returns how many chunks were answered, cut, and had nothing to do."""
    import threading
    import uuid

    spark, counts = questions.sparkSession, {"answered": 0, "cut": 0, "done": 0}
    for k in range(chunks):
        todo = questions.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == k)
        have = stored(spark, path)
        todo = tier(todo if have is None else todo.join(have.select("id"), "id", "left_anti"), "questions-to-do")
        if todo.isEmpty():
            counts["done"] += 1
            continue
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, f"questions, part {k}", True)
        late = threading.Event()

        def cancel(group: str = group, late: threading.Event = late) -> None:
            late.set()
            spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(seconds, cancel) if seconds is not None else None
        try:
            if timer:
                timer.start()
            made = tier(answer(todo).withColumn("error", F.lit(None).cast("string")), "records")
        except Exception:
            if not late.is_set():
                raise
            made = None
        finally:
            if timer:
                timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        counts["cut" if made is None else "answered"] += 1
        if made is None:
            made = todo.select("id", F.lit(0.0).alias("answer"), F.lit("time limit").alias("error"))
        made.write.mode("append").parquet(path)
    return counts


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of `answer_all`; fallback records lack the columns that answers have."""
    return spark.read.option("mergeSchema", True).parquet(path)
