"""Incremental ingest of report texts: Structured Streaming over new files, one row per table, each table once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import report_type
from ..operators import grid


def report_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    """report_id, ticker, year, report_type, text and seen_at of new report files under folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_extracted.txt").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    part = F.split(F.col("_metadata.file_path"), "/")
    found = files.select(F.element_at(part, -2).alias("report_id"), F.element_at(part, -4).alias("ticker"), F.element_at(part, -3).alias("y"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))
    return found.filter(F.col("y").rlike("^[0-9]+$")).select("report_id", "ticker", F.col("y").cast("int").alias("year"), report_type("report_id").alias("report_type"), "text", "seen_at")


def ingest(stream: DataFrame, out: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Appends the tables of new reports to Parquet files under out, partitioned by ticker, and ends when all files that
    are there have been read. A report that comes again within the delay is dropped; a failed batch is repeated whole."""
    once = stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["report_id"])

    def write(batch: DataFrame, number: int) -> None:
        tables = grid.grids(grid.tables(batch.select("report_id", "text")))
        keys = batch.select("report_id", "ticker", "year", "report_type")
        tables.join(keys, "report_id").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "ticker").parquet(out)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
