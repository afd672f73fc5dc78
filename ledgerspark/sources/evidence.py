"""Evidence as one CSV file for each table, under fixed names in one folder: `{folder}/data/{report}__{item}.csv`.

Each file is written by the task that has its rows, under a name of its own, and then takes its place by a rename: a task
that is killed or run twice leaves no half file and no second one. Folders are anything that pyarrow's file systems open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import EVIDENCE


def _open(folder: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Writes rows (csv_path, item, code, period, value) and returns csv_path and n_rows of the files; one job, run once by
    the caller. A table's rows are one task's: they are as many as one table of a report has."""
    columns = [F.col("csv_path"), *(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("item", "code", "period")), F.when(F.col("value").isNotNull(), F.format_string("%.6f", F.col("value").cast("double"))).otherwise("").alias("value"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order))]
    ordered = [f"__o{i}" for i in range(len(order))]
    dealt = rows.select(*columns).repartition("csv_path").sortWithinPartitions("csv_path", *ordered)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        system, root = _open(folder)
        now, held, done = None, None, []

        def place() -> None:
            data = held.getvalue().encode("utf-8")
            final = f"{root}/{now}"
            mine = f"{final}.{uuid.uuid4().hex}.tmp"
            system.create_dir(final.rsplit("/", 1)[0], recursive=True)
            try:
                with system.open_output_stream(mine) as out:
                    out.write(data)
                system.move(mine, final)
            except BaseException:
                if system.get_file_info(mine).is_file:
                    system.delete_file(mine)
                raise

        n = 0
        for batch in batches:
            for path, *cells in zip(*(batch.column(c).to_pylist() for c in ("csv_path", *EVIDENCE)), strict=True):
                if path != now:
                    if now is not None:
                        place()
                        done.append((now, n))
                    now, held, n = path, io.StringIO(), 0
                    line = csv.writer(held, lineterminator="\n")
                    line.writerow(EVIDENCE.values())
                line.writerow(cells)
                n += 1
        if now is not None:
            place()
            done.append((now, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["csv_path", "n_rows"])

    return dealt.mapInArrow(save, "csv_path string, n_rows long")


def present(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """The paths (csv_path) whose files are there."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            names = batch.column("csv_path").to_pylist()
            found = system.get_file_info([f"{root}/{n}" for n in names]) if names else []
            yield pa.RecordBatch.from_arrays([pa.array([n for n, f in zip(names, found, strict=True) if f.is_file], pa.string())], ["csv_path"])

    return paths.select("csv_path").mapInArrow(look, T.StructType([T.StructField("csv_path", T.StringType())]))


def write_missing(rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Writes the files that are not there yet; those that are stay as they are."""
    have = present(rows.sparkSession, folder, rows.select("csv_path").distinct())
    return write(rows.join(have, "csv_path", "left_anti"), folder, order)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """csv_path, item, code, period, value of all files."""
    kinds = T.StructType([T.StructField(v, T.DoubleType() if k == "value" else T.StringType()) for k, v in EVIDENCE.items()])
    raw = spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(f"{folder}/data/*.csv")
    path = F.concat(F.lit("data/"), F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)))
    return raw.select(path.alias("csv_path"), *(F.coalesce(F.col(v), F.lit("")).alias(k) if k != "value" else F.col(v).alias(k) for k, v in EVIDENCE.items()))
