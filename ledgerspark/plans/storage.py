"""Tables between the tiers of a plan, written where the whole cluster reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without that setting, a temporary folder made once."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose join is to be a shuffle. Spark judges a table by the bytes of its files, and those of repetitive texts may be
    a hundredth of what the driver would have to hold to broadcast them."""
    return df.hint("shuffle_merge")


def tier(df: DataFrame, name: str) -> DataFrame:
    """Writes a tier and reads it back: what stands above plans over plain columns, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
