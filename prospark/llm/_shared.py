"""What the operators share: the folder all executors see, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below this application's one in spark.checkpoint.dir.

    Where that is unset, a local session (tests) takes a temporary folder; on a cluster it raises.
    """
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def clear_stored(spark: SparkSession) -> None:
    """Deletes all that this application stored, once its results are written elsewhere: later reads of them fail."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *partitioning: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: it is computed once, and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partitioning) if partitioning else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(modulus: int, remainder: int):
    """Column: crc32 of doc_id as text has this remainder (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder
