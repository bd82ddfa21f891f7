"""Event streams: buffered ingest, daily rollups and deduplication.  Watermarks are additions for unbounded input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream whose local timestamps are UTC timestamps, as watermarks need."""
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def daily_visits(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Views a day and visitor, one row of state each; a day is final when the watermark has passed it."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    return days.agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "user_id", "n")


def daily(visits: DataFrame) -> DataFrame:
    """Views and exact distinct visitors a day, from what daily_visits gave."""
    return visits.groupBy("day").agg(F.sum("n").alias("views"), F.count("user_id").alias("visitors"))


def once(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """At-least-once deliveries to one row a key, with state bounded by the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def flush_batches(stream: DataFrame, write, checkpoint: str, every: str = "10 seconds"):
    """Micro-batch sink: write(batch, id) is called for every trigger, again for the same id after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def work_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see.

    Where that is unset, a local session uses a temporary folder; on a cluster it raises, as executors don't share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, by one available-now run into Parquet in a work folder."""
    spark = stream.sparkSession
    path = work_folder(spark)
    written: dict[int, str] = {}

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{i}")
        written[i] = f"{path}/{i}"

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    # in complete mode each batch holds all rows
    return spark.read.schema(stream.schema).parquet(*([written[max(written)]] if mode == "complete" else written.values()))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return read_events(spark, f"{sf_dir}/events*.parquet", schema)


@query("""select strftime(ts, '%Y-%m-%d') as day, count(*) as views, count(distinct user_id) as visitors from events group by 1""")
def stream_daily(spark, d):
    return daily(drain(daily_visits(_stream(spark, d)), "complete"))


@query("""select event_type, count(distinct event_id) as n from events group by 1""")
def stream_dedup(spark, d):
    """Each event twice in the stream, once in the result."""
    twice = _stream(spark, d).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).select("event_id", "event_type", "ts")
    return drain(once(twice, ["event_id"], "60 days"), "append").groupBy("event_type").agg(F.count("*").alias("n"))
