"""Streams that stop and go on: pages fetched once, presence as of any moment."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from prospark import registry
from prospark.sources.paged_stream import PagedStream, PagedStreamReader
from prospark.streaming import presence


@pytest.fixture
def pages(spark, tmp_path):
    spark.dataSource.register(PagedStream)
    options = {"fetch": "tests.paged_fixture:fetch_logged", "columns": "id string, name string", "spool": f"file://{tmp_path}/spool", "cursor": f"{tmp_path}/log|"}

    def reader(**more):
        from pyspark.sql.types import StringType, StructField, StructType

        schema = StructType([StructField("id", StringType()), StructField("name", StringType())])
        return PagedStreamReader(schema, options | more)

    return reader, options, tmp_path


def test_pages_are_fetched_once(pages):
    reader, _, tmp = pages
    first = reader()
    start = first.initialOffset()
    one = first.latestOffset()
    assert (one["page"], one["cursor"].split("|")[1]) == (1, "p2")
    assert [tuple(r) for p in first.partitions(start, one) for r in first.read(p)] == [("1", "a"), ("2", "b")]
    again = reader()  # a restart before the batch was done
    assert [tuple(r) for p in again.partitions(start, one) for r in again.read(p)] == [("1", "a"), ("2", "b")]
    again.commit(one)
    two = again.latestOffset()
    assert (two["page"], two["cursor"].split("|")[1]) == (2, "p3")
    (tmp / "log.fail").write_text("p3")
    with pytest.raises(OSError):
        reader().latestOffset()
    (tmp / "log.fail").unlink()
    rest = reader(pages="9")
    end = rest.latestOffset()
    assert (end["page"], end["cursor"]) == (3, "") and rest.latestOffset() == end
    assert [tuple(r) for p in rest.partitions(one, end) for r in rest.read(p)] == [("3", None), ("4", "d, e")]
    assert (tmp / "log").read_text() == "|p2|p3|"


def test_a_new_edition_stops(pages):
    reader, _, _ = pages
    both = reader(fetch="tests.paged_fixture:fetch_changing", pages="2", cursor="")
    both.latestOffset()
    with pytest.raises(ValueError, match="'p3'"):
        both.latestOffset()


def test_a_stream_goes_on_at_its_cursor(spark, pages):
    _, options, tmp = pages
    got = []

    def run():
        stream = spark.readStream.format("paged_stream").options(**options).load()
        write = stream.writeStream.foreachBatch(lambda b, i: got.append([r.id for r in b.collect()])).option("checkpointLocation", str(tmp / "state"))
        write.trigger(availableNow=True).start().awaitTermination()

    for _ in range(4):
        run()
    assert [sorted(x) for x in got if x] == [["1", "2"], ["3"], ["4"]]
    assert (tmp / "log").read_text() == "|p2|p3|"


def test_snapshots():
    r = random.Random(8)
    visits = sorted((r.randrange(3_600_000), k, str(r.randrange(9)), r.choice("ab")) for k in range(400))
    for at in range(0, 3_900_000, 61_000):
        for most in (5, 100, 5000):
            n, minutes, covered, last, pages = presence.snapshot(visits, at, most)
            kept = [v for v in visits if v[0] < at][-most:]
            kept = [v for v in kept if v[0] >= at - 1_800_000]
            now = [v for v in kept if v[0] >= at - 300_000]
            assert n == len({v[2] for v in now}) and sum(minutes) == len(kept)
            assert minutes[-1] == sum(v[0] >= at - 60_000 for v in kept)
            assert [x[1] for x in last] == [v[1] for v in kept[::-1][:20]]
            assert dict(pages) == {p: len({v[2] for v in now if v[3] == p}) for p in {v[3] for v in now}}
            assert 0 <= covered <= 30 and (covered == 30 or len(kept) == most)


def test_presence_over_a_restart(spark, tmp_path):
    """Two runs over one checkpoint say what the visits say."""
    start = datetime.datetime(2024, 5, 1, 10)
    rows = [(start + datetime.timedelta(seconds=47 * k), k, f"v{k % 7}", f"/p{k % 3}") for k in range(150)]
    schema = "ts timestamp, id long, visitor string, path string"
    for name, part in (("a", rows[:80]), ("b", rows[80:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    done = []

    def run(pattern):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / pattern))
        found = presence.presence(stream, "10 minutes", "0 seconds", 3)
        write = found.writeStream.foreachBatch(lambda b, i: done.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state"))
        write.trigger(availableNow=True).start().awaitTermination()

    def both():
        run("a*.parquet")
        run("[ab]*.parquet")

    presence.with_rocksdb(spark, both)
    whole = presence.site(spark.createDataFrame(done, presence.SNAPSHOT)).orderBy("as_of").collect()
    visits = [(int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1000), k, v, p) for t, k, v, p in rows]
    assert len(whole) >= 11
    for r in whole:
        at = int((r.as_of - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
        n, minutes, covered, last, pages = presence.snapshot(visits, at, 5000)
        assert (r.visitors, list(r.per_minute), r.covered) == (n, minutes, covered)
        assert [x.id for x in r["last"]] == [x[1] for x in last]
        assert {p.path: p.visitors for p in r.pages or []} == dict(pages)


def test_shards_follow_the_visits(spark, tmp_path, monkeypatch):
    """More visits are more shards, not larger tasks, and one visitor with 6000 views in half an hour has them all counted, in order within a millisecond."""
    e = spark.range(6400).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 10:40:00' + make_dt_interval(0, 0, 0, if(id < 6000, (id div 4) * 0.6 - (id % 4) * 0.0002, (id - 6000) * 30.0))").alias("ts"), F.when(F.col("id") < 6000, 7).otherwise(F.col("id") % 50).alias("user_id"), F.lit("x").alias("event_type"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(presence, "EACH", 500)
    made, asked = presence.presence, []
    monkeypatch.setattr(presence, "presence", lambda visits, every, late, shards, *more: asked.append(shards) or made(visits, every, late, shards, *more))
    out = registry.QUERIES["live_presence_stream"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"select hour, visitors, last_minute, views, last_ids from ({registry.ORACLE_SQL['live_presence_stream']})").fetchall()
    assert sorted(tuple(r) for r in out.select("hour", "visitors", "last_minute", "views", "last_ids").collect()) == sorted(want)
    assert asked == [13] and max(r[3] for r in want) > 6000
