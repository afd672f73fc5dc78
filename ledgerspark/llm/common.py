"""What the operators share: intermediate tables in the cluster's shared folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a temporary folder made once."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and lost executors lose nothing."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote; only for tables that no later plan reads."""
    for df in tables:
        remove_path(df.sparkSession, df._llm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function from Arrow columns to columns (lists, numpy or Arrow arrays), batch by batch; it also
    gets, as "_at", the number of rows that the partition had before the batch."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        at = 0
        for batch in batches:
            out = function({n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"_at": at})
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([a if isinstance(a := out[n], pa.Array) else pa.array(a, arrow.field(n).type, from_pandas=False) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; it reads no further than that."""
    return df.limit(rows + 1).count() <= rows
