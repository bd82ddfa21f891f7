"""Tables that change by whole actions: merges, rejected rows, failing tasks and writers, rivals, clearing up."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospark.sinks.staged import StagedWriter
from prospark.sinks.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def people(spark, *values):
    return spark.createDataFrame(values, "id string, mail string, seen int")


def test_upsert_keeps_fills_and_rejects(spark, store):
    with store.action() as a:
        a.upsert("people", people(spark, ("a", "", 1), ("b", "b@x.fr", 1)), ["id"])
    assert a.counts["people"] == {"rows": 2, "created": 2, "updated": 0, "rejected": 0}
    with store.action() as a:
        new = people(spark, ("a", "a@x.fr", 2), ("b", "new@x.fr", 2), (None, "c@x.fr", 2), ("d", "wrong", 2), ("e", "e@x.fr", 9), ("e", "e@x.fr", 3))
        a.upsert("people", new, ["id"], fill=["mail"], order=[F.col("seen")], valid={"no mail": F.col("mail").contains("@")})
    assert rows(store.read("people")) == [("a", "a@x.fr", 2), ("b", "b@x.fr", 2), ("e", "e@x.fr", 3)]
    assert {k: a.counts["people"][k] for k in ("created", "updated", "rejected")} == {"created": 1, "updated": 2, "rejected": 2}
    assert [r[:4] for r in rows(store.read("people_rejected"))] == [("d", "wrong", 2, "no mail"), (None, "c@x.fr", 2, "no key")]
    with store.action() as a:
        a.upsert("people", people(spark, ("a", "z@x.fr", 7)), ["id"], keep=["seen"])
        a.delete("people_rejected", F.col("mail") == "wrong")
    assert rows(store.read("people"))[0] == ("a", "z@x.fr", 2) and store.read("people_rejected").count() == 1
    assert store.read("people", version=1).count() == 2  # older states stay readable


def test_only_touched_buckets_are_written(spark, store):
    many = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("").alias("mail"), F.lit(1).alias("seen"))
    with store.action() as a:
        a.upsert("people", many, ["id"])
    before = store.state()["people"]["files"]
    with store.action() as a:
        a.upsert("people", people(spark, ("7", "x", 2)), ["id"])
    after = store.state()["people"]["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read("people").count() == 100


def test_all_tables_of_an_action_or_none(spark, store):
    with store.action() as a:
        a.replace("one", people(spark, ("a", "", 1)), ["id"])
        a.replace("two", people(spark, ("a", "", 1)), ["id"])

    fails = F.udf(lambda s: 1 // (s - 5), "int")
    with pytest.raises(Exception, match="division"), store.action() as a:
        a.upsert("one", people(spark, ("b", "", 2)), ["id"])
        a.upsert("two", people(spark, *((str(k), "", k) for k in range(9))).repartition(3).withColumn("seen", fails("seen")), ["id"])
    assert store.version() == 1 and store.read("one").count() == store.read("two").count() == 1
    with pytest.raises(KeyError), store.action() as a:
        a.upsert("one", people(spark, ("b", "", 2)), ["id"])
        raise KeyError("the driver stops")
    assert rows(store.read("one")) == [("a", "", 1)]


def test_a_task_that_dies_once(spark, tmp_path):
    """The first try of a task dies after its file was begun: the second one counts, the first one's rows don't."""
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    options = {"path": f"file://{tmp_path}/store", "table": "t", "action": "x"}

    def batches(die):
        yield pa.RecordBatch.from_pydict({"id": [1, 2], "_bucket": [0, 1]})
        if die:
            raise OSError("lost")
        yield pa.RecordBatch.from_pydict({"id": [3], "_bucket": [0]})

    writer = StagedWriter(options)
    with pytest.raises(OSError):
        writer.write(batches(True))
    again = writer.write(batches(False))
    writer.commit([again])
    assert sorted(b for b, _, _ in again.files) == [0, 1] and sum(n for *_, n in again.files) == 3
    assert len(list((tmp_path / "store/data/t/x").iterdir())) == 4  # two of them belong to no one
    writer.abort([again])
    assert len(list((tmp_path / "store/data/t/x").iterdir())) == 2
    assert store.version() == 0 and store.vacuum() == 3


def test_rivals(spark, store):
    with store.action() as a:
        a.replace("jobs", people(spark, ("a", "", 0)), ["id"])
    first, second = store.action(), store.action()
    first.upsert("jobs", people(spark, ("a", "first", 1)), ["id"])
    second.upsert("jobs", people(spark, ("a", "second", 2)), ["id"])
    second.__exit__(None, None, None)
    with pytest.raises(Conflict):
        first.__exit__(None, None, None)
    assert rows(store.read("jobs")) == [("a", "second", 2)]

    taken = []

    def claim(action):
        """Takes the job only if nobody has it: on the second try it sees the rival's claim."""
        if not taken:
            taken.append(1)
            with store.action() as rival:
                rival.upsert("jobs", people(spark, ("b", "rival", 1)), ["id"])
        free = action.read("jobs").where("id = 'b'").isEmpty()
        action.upsert("jobs", people(spark, *([("b", "me", 1)] if free else [])), ["id"])

    store.retry(claim)
    assert rows(store.read("jobs")) == [("a", "second", 2), ("b", "rival", 1)]


def test_the_entry_itself_decides(spark, store):
    """A rival's entry between the look and the rename: the rename fails and the draft goes."""
    with store.action() as a:
        a.replace("t", people(spark, ("a", "", 0)), ["id"])
    late = store.action()
    late.replace("t", people(spark, ("late", "", 0)), ["id"])
    with store.action() as a:
        a.replace("t", people(spark, ("b", "", 0)), ["id"])
    store.version, seen = (lambda: late.base), store.version
    try:
        with pytest.raises(Conflict):
            late.__exit__(None, None, None)
    finally:
        store.version = seen
    assert rows(store.read("t")) == [("b", "", 0)] and store.version() == 2


def test_vacuum(spark, store):
    for k in range(3):
        with store.action() as a:
            a.replace("t", people(spark, (str(k), "", k)), ["id"])
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert rows(store.read("t")) == [("2", "", 2)] and store.version() == 3


def test_empty_tables(spark, store):
    with store.action() as a:
        a.upsert("t", spark.createDataFrame([], "id string, n int"), ["id"])
    assert store.read("t").count() == 0 and store.read("t").columns == ["id", "n"]
