"""Streams and groups that must not go whole through the driver, one group or one task."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from prospark import registry
from prospark.streaming import audience


def test_streams_are_not_kept_on_the_driver(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    out = audience.drain(audience._stream(spark, sf_dir).select("event_id", "user_id"), "append")
    assert out.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert all(f.endswith(".parquet") for f in out.inputFiles()) and out.inputFiles()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("name", ["flatten_reference", "stream_daily"])
def test_no_group_is_collected(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan
    assert "collect_" not in audience.daily_visits(audience._stream(spark, sf_dir))._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("drop", [None, 500, 501])
def test_increasing_across_ranges(spark, tmp_path, drop):
    """One type only, so that one task would sort it all; a single step down must be seen wherever a range ends."""
    value = F.when(F.col("id") == (-1 if drop is None else drop), -1.0).otherwise(F.col("id").cast("double"))
    e = spark.range(1000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.col("id").alias("user_id"), F.lit("x").alias("event_type"), value.alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["increasing_columns"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("x", drop is None, 1000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan


def test_rate_limit_to_the_microsecond(spark, tmp_path):
    """A window begins and ends within a second: neither what came earlier in its first one counts, nor what comes later in its last one."""
    at = [0.9, 0.95, 1.2, 2.0, 86399.92, 86399.95, 86399.97, 86400.1, 86400.3, 86401.0, 86401.5]
    e = spark.createDataFrame([(i, t, 1 + i % 2 * (t < 1)) for i, t in enumerate(at)], "event_id long, s double, user_id long")
    e.selectExpr("event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) as ts", "user_id", "'x' as event_type", "1.0 as value", "'{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"select user_id, most_in_24h, refused from ({registry.ORACLE_SQL['rate_limit_24h']})").fetchall()
    out = registry.QUERIES["rate_limit_24h"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.select("user_id", "most_in_24h", "refused").collect()) == sorted(want)
