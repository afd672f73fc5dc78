"""Readers of the corpus and of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_year, report_type


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stocks(spark: SparkSession, path: str, key: str = "Mã CK", name: str = "Tên công ty") -> DataFrame:
    """ticker, company_name of a CSV file (a byte order mark before its header does not matter). Blank keys go; of equal
    keys the last row counts."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns)).withColumn("__n", F.monotonically_increasing_id())
    raw = raw.select(F.trim(F.col(key)).alias("ticker"), F.trim(F.col(name)).alias("company_name"), "__n").filter("ticker <> ''")
    return raw.groupBy("ticker").agg(F.max_by("company_name", "__n").alias("company_name"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question and ord (the file's order) of a JSON lines file; blank and broken lines go."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.select("ord", F.from_json("value", "id int, question string").alias("q"))
    return parsed.filter("q.id is not null").select("q.id", "q.question", "ord")


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """report_id, ticker, year, report_type and text of folder/ticker/year/report_id/*_extracted.txt. Folders whose year
    is no number are skipped, malformed UTF-8 is replaced."""
    files = spark.read.text(f"{folder}/*/*/*/*_extracted.txt", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    part = F.split("path", "/")
    found = files.select(F.element_at(part, -2).alias("report_id"), F.element_at(part, -4).alias("ticker"), F.element_at(part, -3).alias("y"), F.col("value").alias("text"))
    return found.filter(F.col("y").rlike("^[0-9]+$")).select("report_id", "ticker", F.col("y").cast("int").alias("year"), report_type("report_id").alias("report_type"), "text")


def done(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the records of a JSON lines file; broken lines do not count."""
    return spark.read.text(path).select(F.get_json_object("value", "$.id").try_cast("int").alias("id")).filter("id is not null").distinct()


def catalog(catalog: DataFrame, tickers: list[str] | None = None, statements_only: bool = False, min_rows: int = 0) -> DataFrame:
    """Rows of a catalog by conditions that reach the scan."""
    out = catalog.filter(F.col("n_rows") >= min_rows)
    if statements_only:
        out = out.filter("statement is not null")
    return out.filter(F.col("ticker").isin(list(tickers))) if tickers else out


def of_questions(stored: DataFrame, questions: DataFrame, rows: int = 10_000) -> DataFrame:
    """Stored rows, partitioned by ticker, of the companies that questions (tickers) name. Where those are few the scan
    opens their partitions alone, as the plan learns them at run time; where they are many it is a shuffle join."""
    named = questions.select(F.explode("tickers").alias("ticker")).filter("ticker is not null").distinct()
    return stored.join(F.broadcast(named) if named.limit(rows + 1).count() <= rows else named, "ticker", "left_semi")
