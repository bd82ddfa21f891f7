"""Session settings and the table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution; the cluster's own settings stay unless given here."""
    builder = SparkSession.builder.appName("prospark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A Parquet table with its local timestamps as UTC timestamps, which watermarks and windows need."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
