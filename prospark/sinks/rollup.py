"""A rollup by day that is kept: days that are over come in once, detail goes when it is old."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..session import load
from ..streaming.audience import work_folder

KEEP_DAYS = 90


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The days of a table that is partitioned by day, from its folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n[4:] for n in names if n.startswith("day="))


def add_detail(rows: DataFrame, path: str) -> None:
    """rows (day as yyyy-MM-dd, visitor, ...) come in beside those that are there."""
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def roll_up(spark: SparkSession, detail: str, rollup: str, today: str, keep_days: int = KEEP_DAYS, catch_up: int = KEEP_DAYS) -> dict[str, int]:
    """Rolls up the days of `detail` after the last one in `rollup`, at most `catch_up`, today left out; old detail goes.

    Both tables are folders of Parquet by day.  The days to do come from folder names, and only their folders are read.  Days
    are overwritten one by one (dynamic overwrite), so a run that died, or ran twice, leaves what one run leaves.
    """
    there, done = _folders(spark, detail), _folders(spark, rollup)
    day = lambda d, n: (datetime.date.fromisoformat(d) + datetime.timedelta(n)).isoformat()
    first = day(done[-1], 1) if done else there[0] if there else today
    last = min(day(today, -1), day(first, catch_up - 1))
    due = [d for d in there if first <= d <= last]
    if due:
        rows = spark.read.parquet(detail).where(F.col("day").cast("string").isin(due))
        days = rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))
        days.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rollup)
    gone = [d for d in there if d < day(today, -keep_days)]
    purged = spark.read.parquet(detail).where(F.col("day").cast("string").isin(gone)).count() if gone else 0
    for d in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{detail}/day={d}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return {"days": len(due), "purged": purged}


@query("""
with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as views, count(distinct user_id) as visitors from events group by 1)
select 'rollup' as kept, day, views, visitors from d where day < '2024-01-28'
union all select 'detail', day, views, visitors from d where day >= '2024-01-08'""")
def kept_rollup(spark, d):
    """Three runs, one of them twice: what has come in until the 15th, the 20th and the 28th; detail is kept for 20 days."""
    base = work_folder(spark)
    detail, rollup = f"{base}/detail", f"{base}/rollup"
    e = load(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("visitor"))
    for first, today in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-01-20"), ("2024-01-20", "2024-01-28"), ("2024-02-01", "2024-01-28")):
        add_detail(e.where((F.col("day") >= first) & (F.col("day") < (today if today < "2024-01-28" else "2024-01-31"))), detail)
        roll_up(spark, detail, rollup, today, keep_days=20)
    left = spark.read.parquet(detail).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("views"), F.count_distinct("visitor").alias("visitors"))
    days = spark.read.parquet(rollup).select(F.col("day").cast("string").alias("day"), "views", "visitors")
    return days.withColumn("kept", F.lit("rollup")).unionByName(left.withColumn("kept", F.lit("detail")))
