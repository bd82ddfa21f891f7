"""Keyed tables in a shared folder that change by whole actions: all tables of an action, or none.

A table is dealt over buckets by its key.  An action writes the buckets that it changes anew, as staged files, and counts
when its entry `actions/<number>.json` is there, made by one rename that fails if another action took the number: then
nothing has changed, and `retry` runs the work again on the new state.  Readers take the files that the newest entry names,
so they see no half of an action, whenever a task, a writer or the driver dies.  `vacuum` deletes files that no entry names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import blank
from .staged import BUCKET, StagedSource


class Conflict(Exception):
    """Another action came first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: jvm.Path(f"{self.path}/{name}")
        self._fs = self._path("actions").getFileSystem(spark._jsc.hadoopConfiguration())
        spark.dataSource.register(StagedSource)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        at = self._path("actions")
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(at) if s.getPath().getName()[0].isdigit()) if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the newest action; 0 before the first."""
        return (self._numbers() or [0])[-1]

    def state(self, version: int | None = None) -> dict:
        """table -> {"schema": DDL, "key": columns, "files": {bucket: names}} as of an action."""
        version = self.version() if version is None else version
        return json.loads(self._text(f"actions/{version:012}.json"))["tables"] if version else {}

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a table; of some buckets, if given."""
        entry = self.state(version)[table]
        names = [f"{self.path}/{n}" for b, own in entry["files"].items() if only is None or int(b) in only for n in own]
        return self.spark.read.schema(entry["schema"]).parquet(*names) if names else self.spark.createDataFrame([], entry["schema"])

    def action(self) -> Action:
        return Action(self)

    def retry(self, work: Callable[[Action], None], times: int = 5) -> Action:
        """Runs work(action) and publishes it, again from the new state if another action came first."""
        for left in range(times, 0, -1):
            try:
                with self.action() as action:
                    work(action)
                return action
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 1) -> int:
        """Deletes entries but the newest `keep`, and all data and receipts that they don't name; while no action runs."""
        numbers = self._numbers()
        named = {n for v in numbers[-keep:] for t in self.state(v).values() for own in t["files"].values() for n in own}
        gone = [f"actions/{v:012}.json" for v in numbers[:-keep]]
        root = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        for folder in ("data", "receipts"):
            if self._fs.exists(self._path(folder)):
                found = self._fs.listFiles(self._path(folder), True)
                while found.hasNext():
                    name = found.next().getPath().toUri().getPath().removeprefix(root)
                    if name not in named:
                        gone.append(name)
        for name in gone:
            self._fs.delete(self._path(name), False)
        return len(gone)


class Action:
    """Changes of several tables, published together at the end of the with block; an exception leaves all as it was."""

    def __init__(self, store: Store):
        self.store, self.id = store, uuid.uuid4().hex
        self.base = store.version()
        self.tables = store.state(self.base)
        self.counts: dict[str, dict[str, int]] = {}

    def __enter__(self) -> Action:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self._publish()

    def read(self, table: str) -> DataFrame:
        """The table as of the action's start."""
        return self.store.read(table, self.base)

    def has(self, table: str) -> bool:
        return table in self.tables

    def _bucketed(self, df: DataFrame, key: list[str]) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(self.store.buckets)).cast("int"))

    def _stage(self, table: str, df: DataFrame, key: list[str], columns: list[str]) -> dict[int, list]:
        rows = self._bucketed(df.select(*columns), key).repartition(self.store.buckets, BUCKET)
        name = f"{self.id}{len(self.counts)}"
        rows.write.format("staged").mode("append").options(path=self.store.path, table=table, action=name).save()
        files: dict[int, list] = {}
        for b, n, rows_in in json.loads(self.store._text(f"receipts/{name}-{table}.json")):
            files.setdefault(b, []).append((n, rows_in))
        return files

    def replace(self, table: str, df: DataFrame, key: list[str]) -> None:
        """All rows of the table are those of df."""
        self._set(table, df, key, None)

    def _set(self, table: str, df: DataFrame, key: list[str], touched: list[int] | None) -> None:
        files = self._stage(table, df, key, df.columns)
        old = self.tables.get(table, {"files": {}})["files"] if touched is not None else {}
        kept = {b: own for b, own in old.items() if int(b) not in (touched or [])}
        new = {str(b): [n for n, _ in own] for b, own in files.items()}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.tables = {**self.tables, table: {"schema": schema, "key": key, "files": kept | new}}
        self.counts.setdefault(table, {})["rows"] = sum(n for own in files.values() for _, n in own)

    def upsert(self, table: str, df: DataFrame, key: list[str], keep: list[str] = [], fill: list[str] = [], order: list[Column] | None = None, valid: dict[str, Column] | None = None) -> None:  # noqa: B006
        """Rows of df replace those of equal key, others come in; only the buckets they fall in are written.

        `keep` columns stay as first written, `fill` columns keep a value that isn't blank.  Of several rows of a key the first
        by `order` counts.  Rows that fail a condition of `valid` (name -> column), or lack a key, go to the table
        `<table>_rejected` with the reason, and the others come in all the same.  counts[table] tells created, updated, rejected.
        """
        reasons = {"no key": reduce(lambda a, b: a & b, [~blank(F.col(k).cast("string")) for k in key]), **(valid or {})}
        reason = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()))
        told = df.withColumn("_reason", reason).persist()
        try:
            good, bad = told.where("_reason is null").drop("_reason"), told.where("_reason is not null")
            first = Window.partitionBy(*key).orderBy(*(order or [F.xxhash64(*df.columns)]))
            good = good.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            touched = [r[0] for r in self._bucketed(good, key).select(BUCKET).distinct().collect()]
            created = F.lit(True)
            if table in self.tables:
                old = self.store.spark.read.schema(self.tables[table]["schema"]).parquet(*names) if (names := self._names(table, touched)) else self.store.spark.createDataFrame([], self.tables[table]["schema"])
                o, n = old.alias("o"), good.alias("n")
                joined = o.join(n, reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]), "full")
                there, comes = F.col(f"o.{key[0]}").isNotNull(), F.col(f"n.{key[0]}").isNotNull()

                def column(c: str) -> Column:
                    was, now = F.col(f"o.{c}"), F.col(f"n.{c}")
                    if c in keep:
                        return F.when(was.isNull(), now).otherwise(was)
                    if c in fill:
                        return F.when(blank(was.cast("string")), now).otherwise(was)
                    return F.when(comes, now).otherwise(was)

                names_of = [c for c in old.columns if c in good.columns]
                merged = joined.select(*(column(c).alias(c) if c in names_of else F.col(f"o.{c}").alias(c) for c in old.columns), *(F.col(f"n.{c}").alias(c) for c in good.columns if c not in old.columns), (~there).alias("_created"), (there & comes).alias("_updated")).persist()
            else:
                merged = good.withColumns({"_created": created, "_updated": F.lit(False)}).persist()
            try:
                tally = merged.agg(F.count_if("_created"), F.count_if("_updated")).first()
                self._set(table, merged.drop("_created", "_updated"), key, touched)
            finally:
                merged.unpersist()
            rejected = bad.count()
            if rejected:
                kept = bad.withColumn("_action", F.lit(self.id))
                self.append(f"{table}_rejected", kept, [*kept.columns])
            self.counts[table] |= {"created": tally[0], "updated": tally[1], "rejected": rejected}
        finally:
            told.unpersist()

    def _names(self, table: str, touched: list[int]) -> list[str]:
        return [f"{self.store.path}/{n}" for b, own in self.tables[table]["files"].items() if int(b) in touched for n in own]

    def append(self, table: str, df: DataFrame, key: list[str]) -> None:
        """Rows come in beside all that are there."""
        files = self._stage(table, df, key, df.columns)
        old = self.tables.get(table, {"files": {}})["files"]
        new = {b: [*old.get(b, []), *(n for n, _ in files.get(int(b), []))] for b in {*old, *map(str, files)}}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        self.tables = {**self.tables, table: {"schema": schema, "key": key, "files": new}}
        self.counts.setdefault(table, {})["rows"] = sum(n for own in files.values() for _, n in own)

    def delete(self, table: str, gone: Column) -> None:
        """Rows of which the condition holds go."""
        rows = self.read(table)
        kept = rows.where(~F.coalesce(gone, F.lit(False)))
        before = rows.count()
        self._set(table, kept, self.tables[table]["key"], list(range(self.store.buckets)))
        self.counts[table]["deleted"] = before - self.counts[table]["rows"]

    def _publish(self) -> None:
        s, number = self.store, self.base + 1
        if s.version() != self.base:
            raise Conflict(f"action {number} is taken")
        draft = s._path(f"actions/_{self.id}")
        out = s._fs.create(draft, False)
        out.write(json.dumps({"id": self.id, "tables": self.tables}).encode())
        out.close()
        entry = s._path(f"actions/{number:012}.json")
        try:  # fails if the entry is there, also where it came to be after the look above
            context = s.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(s._fs.getUri(), s.spark._jsc.hadoopConfiguration())
            context.rename(s._fs.makeQualified(draft), s._fs.makeQualified(entry), s.spark.sparkContext._gateway.new_array(s.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            s._fs.delete(draft, False)
            raise Conflict(f"action {number} is taken") from e
