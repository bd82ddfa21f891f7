"""Who is on the site: a window of visits kept as state, of which a snapshot leaves at every boundary of time.

Visits are dealt over shards by visitor, so a busy site is no single key, and a visitor counts in one shard only.  Each shard
keeps its visits in order; a timer at each boundary emits what they say as of then and drops what has aged.  As of T
they are the newest `most` visits before T and within 30 minutes of it; if there were more, `covered` tells for how many
minutes it still answers.  Snapshots of the shards are added up, their last visits merged.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query
from .audience import drain, read_events

WINDOW, PRESENT, MINUTES, LAST = 30 * 60_000, 5 * 60_000, 30, 20
SNAPSHOT = "shard int, as_of timestamp, visitors long, per_minute array<long>, covered int, last array<struct<at: timestamp, id: long, path: string>>, pages array<struct<path: string, visitors: long>>"
EACH = 250_000  # visits of a shard in one batch
_STATES = "spark.sql.streaming.stateStore.providerClass"


def snapshot(visits: list[tuple], at: int, most: int) -> tuple:
    """What (ms, id, visitor, path) visits in order say as of `at` ms, this moment left out; microseconds beyond the ms may follow."""
    kept = [v for v in visits if at - WINDOW <= v[0] < at]
    known = kept[-most - 1][0] if len(kept) > most else at - WINDOW
    kept = kept[-most:]
    minutes = [0] * MINUTES
    for ms, *_ in kept:
        minutes[MINUTES - 1 - (at - 1 - ms) // 60_000] += 1
    now = [v for v in kept if v[0] >= at - PRESENT]
    pages: dict[str, set] = {}
    for _, _, visitor, path, *_ in now:
        pages.setdefault(path, set()).add(visitor)
    last = [(pd.Timestamp(ms * 1000 + sum(us), unit="us"), i, path) for ms, i, _, path, *us in kept[: -LAST - 1 : -1]]
    return len({v[2] for v in now}), minutes, min(MINUTES, -(-(at - known) // 60_000)), last, sorted((p, len(v)) for p, v in pages.items())


class Presence(StatefulProcessor):
    """Visits of five minutes are one entry of the state: a timer reads those of its window only."""

    def __init__(self, every_ms: int, most: int):
        self.every, self.most = every_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "visits string")

    def _slot(self, slot: int) -> list[tuple]:
        found = self.slots.getValue((slot,))
        return list(map(tuple, json.loads(found[0]))) if found else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for pdf in rows:
            for v in zip(pdf.ms.tolist(), pdf.id.tolist(), pdf.visitor.tolist(), pdf.path.tolist(), pdf.us.tolist()):
                new.setdefault(v[0] // PRESENT, []).append(v)
        for slot, visits in new.items():
            self.slots.updateValue((slot,), (json.dumps(self._slot(slot) + visits),))
        for at in {(v[0] // self.every + 1) * self.every for visits in new.values() for v in visits}:
            self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        ends = at + self.every - WINDOW  # what the next boundary doesn't see
        visits, stays = [], False
        for slot in range((at - max(self.every, WINDOW)) // PRESENT, -(-at // PRESENT)):
            own = self._slot(slot)
            visits += own
            if own and (slot + 1) * PRESENT <= ends:
                self.slots.removeKey((slot,))
            stays = stays or any(ends <= v[0] < at for v in own)
        if stays:
            self.handle.registerTimer(at + self.every)
        visitors, minutes, covered, last, pages = snapshot(sorted(visits, key=lambda v: (v[0], v[4], v[1])), at, self.most)
        yield pd.DataFrame({"shard": [key[0]], "as_of": [pd.Timestamp(at, unit="ms")], "visitors": [visitors], "per_minute": [minutes], "covered": [covered], "last": [last], "pages": [pages]})

    def close(self) -> None:
        pass


def presence(visits: DataFrame, every: str = "1 minute", late: str = "10 minutes", shards: int = 8, most: int = 5000) -> DataFrame:
    """Snapshots by shard of a stream visits(ts, id, visitor, path): `most` visits are kept in a shard, later ones than `late` go."""
    ms = int(pd.Timedelta(every).total_seconds() * 1000)
    own = visits.withWatermark("ts", late).select(F.pmod(F.hash("visitor"), F.lit(shards)).alias("shard"), "ts", F.unix_millis("ts").alias("ms"), "id", F.col("visitor").cast("string").alias("visitor"), "path", F.pmod(F.unix_micros("ts"), F.lit(1000)).alias("us"))
    return own.groupBy("shard").transformWithStateInPandas(statefulProcessor=Presence(ms, most), outputStructType=SNAPSHOT, outputMode="append", timeMode="eventTime")


def shards_of(visits: int, least: int = 4) -> int:
    """As many shards as leave each about EACH visits of a batch: what a task sorts and keeps doesn't grow with the batch."""
    return max(least, -(-visits // EACH))


def site(snapshots: DataFrame, pages: int = 10) -> DataFrame:
    """as_of, visitors, per_minute, covered, last and pages of the whole site, from the snapshots of all shards."""
    add = F.array(*(F.sum(F.col("per_minute")[i]).alias(f"m{i}") for i in range(MINUTES)))
    parts = snapshots.groupBy("as_of").agg(F.sum("visitors").alias("visitors"), add.alias("per_minute"), F.min("covered").alias("covered"), F.flatten(F.collect_list("last")).alias("_last"), F.flatten(F.collect_list("pages")).alias("_pages"))
    newest = F.slice(F.sort_array("_last", asc=False), 1, LAST)
    by_page = snapshots.select("as_of", F.explode("pages").alias("p")).groupBy("as_of", F.col("p.path").alias("path")).agg(F.sum("p.visitors").alias("n"))
    top = by_page.groupBy("as_of").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), 1, pages).alias("top"))
    top = top.select("as_of", F.transform("top", lambda p: F.struct(p.path.alias("path"), (-p.n).alias("visitors"))).alias("pages"))
    return parts.select("as_of", "visitors", "per_minute", "covered", newest.alias("last")).join(top, "as_of", "left")


def with_rocksdb(spark, run, partitions: int | None = None):
    """run() with the state store that processors with timers need, and as many partitions of state as there are shards, if given.

    The session's own settings come back.
    """
    wanted = {_STATES: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    wanted |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


@query("""
with t as (select distinct date_trunc('hour', ts) + interval 1 hour as as_of from events where ts < (select date_trunc('hour', max(ts)) from events)),
w as (select as_of, ts, event_id, user_id, event_type from t join events on ts < as_of and ts >= as_of - interval 30 minute),
h as (select as_of, count(distinct user_id) filter (ts >= as_of - interval 5 minute) as visitors, count(*) filter (ts >= as_of - interval 1 minute) as last_minute, count(*) as views, list(event_id order by ts desc, event_id desc)[:20] as last_ids from w group by 1)
select strftime(as_of, '%Y-%m-%d %H') as hour, coalesce(visitors, 0) as visitors, coalesce(last_minute, 0) as last_minute, coalesce(views, 0)::bigint as views, array_to_string(last_ids, ',') as last_ids from t left join h using (as_of)""")
def live_presence_stream(spark, d):
    """The events as a stream: at each full hour with events, who is there, the views of 30 minutes, the last 20 views.

    The whole table is one batch, so its rows tell the number of shards.  No view is left out, however busy a shard is.
    """
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = read_events(spark, f"{d}/events*.parquet", schema).select("ts", F.col("event_id").alias("id"), F.col("user_id").alias("visitor"), F.col("event_type").alias("path"))
    shards = shards_of(spark.read.parquet(f"{d}/events.parquet").count())
    end = spark.read.parquet(f"{d}/events.parquet").agg(F.date_trunc("hour", F.max("ts").cast("timestamp")).alias("end"))
    found = with_rocksdb(spark, lambda: drain(presence(stream, "1 hour", "0 seconds", shards, sys.maxsize), "append"), shards)
    ids = F.array_join(F.transform("last", lambda x: x.id.cast("string")), ",")
    views = F.aggregate("per_minute", F.lit(0).cast("long"), lambda a, x: a + x)
    out = site(found).join(F.broadcast(end), F.col("as_of") <= F.col("end"))
    return out.select(F.date_format("as_of", "yyyy-MM-dd HH").alias("hour"), "visitors", F.col("per_minute")[MINUTES - 1].alias("last_minute"), views.alias("views"), F.when(F.size("last") > 0, ids).alias("last_ids"))
