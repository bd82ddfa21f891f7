"""Delimited text whose cells may hold line breaks, read in as many tasks as the files have splits.

Spark deals a file out by lines, and whether a line starts within quotes depends on all before it.  For each split one task
says what state it ends in from either state at its start: it keeps, changes or fixes the state.  These answers, a row a
split, are scanned along each file: the last fixed state before a split and the count of changes since give the state it
starts in.  With that, each split cuts its own records; the pieces of a record that crosses splits meet by the split in
which it began.

Quotes open at the first character of a field only, `""` within is a quote, what follows the closing quote belongs to the
field, a carriage return outside quotes is dropped, and a quotation left open ends with the file, or with its line where
cells hold no line breaks (`multiline` false).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits of which the states are broadcast (a row of about 200 bytes each); beyond, lines are sorted to theirs.
BROADCAST_SPLITS = 50_000


def _closing(text: str, at: int) -> int:
    """The place after the quote that ends a quotation, or -1."""
    while (at := text.find('"', at)) >= 0:
        if not text.startswith('"', at + 1):
            return at + 1
        at += 2
    return -1


def _opening(text: str, sep: str, at: int) -> int:
    """The place after the next quote that begins a field, or -1."""
    at = text.find(sep + '"', at)
    return at + len(sep) + 1 if at >= 0 else -1


def state_after(line: str, sep: str, inside: bool) -> bool:
    """Whether the line's end is within quotes, if its start is (inside)."""
    if '"' not in line:
        return inside
    at = 0 if inside else 1 if line.startswith('"') else _opening(line, sep, 0)
    while at >= 0:
        at = _closing(line, at)
        if at < 0:
            return True
        at = _opening(line, sep, at)
    return False


def cells(record: str, sep: str) -> list[str]:
    """The fields of one record."""
    if '"' not in record:
        return record.replace("\r", "").split(sep)
    out, at = [], 0
    while True:
        said = ""
        if record.startswith('"', at):
            close = _closing(record, at + 1)
            said = record[at + 1 : close - 1 if close >= 0 else None].replace('""', '"')
            at = close if close >= 0 else len(record)
        end = record.find(sep, at)
        out.append(said + record[at : end if end >= 0 else None].replace("\r", ""))
        if end < 0:
            return out
        at = end + len(sep)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str], Iterator]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, own


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_states(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """path, block, inside (the state a split starts in), owner (the split of the record that is open there)."""

    def run(batches):
        for (path, block), lines in _splits(batches):
            outer, inner, closes = False, True, False
            for *_, line in lines:
                outer, inner = state_after(line, sep, outer), state_after(line, sep, inner)
                closes = closes or not inner
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "outer": outer, "inner": inner, "closes": closes}])

    found = _lines(spark, path).mapInArrow(run, "path string, block long, outer boolean, inner boolean, closes boolean")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, changes = F.col("outer") == F.col("inner"), (F.col("outer") & ~F.col("inner")).cast("int")
    found = found.withColumn("_sum", F.sum(changes).over(Window.partitionBy("path").orderBy("block")))
    last = F.last(F.when(fixed, F.struct("outer", F.col("_sum").alias("sum"))), ignorenulls=True).over(before)
    odd = (F.coalesce(F.last("_sum").over(before), F.lit(0)) - F.coalesce(F.col("_last.sum"), F.lit(0))) % 2 == 1
    found = found.withColumn("_last", last).withColumn("_odd", odd)
    found = found.withColumn("inside", F.coalesce(F.col("_last.outer"), F.lit(False)) != F.col("_odd"))
    opened = F.when(F.col("inside"), F.col("inner") & F.col("closes")).otherwise(F.col("outer"))
    return found.select("path", "block", "inside", F.last(F.when(opened, F.col("block")), ignorenulls=True).over(before).alias("owner"))


def read_records(spark: SparkSession, path: str, sep: str = ",", multiline: bool = True, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """path, block, n, cells: a row a record; (block, n), the split it begins in and its line there, is its place in its file."""
    lines = _lines(spark, path)
    if not multiline:
        numbered = lines.withColumn("n", F.monotonically_increasing_id())

        def each(batches):
            for batch in batches:
                found = [cells(x, sep) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.string()))], names=["path", "block", "n", "cells"])

        return numbered.mapInArrow(each, "path string, block long, n long, cells array<string>")
    states = split_states(spark, path, sep).persist()
    if states.count() <= broadcast_splits:
        lines = lines.join(F.broadcast(states), ["path", "block"])
    else:
        numbered = lines.withColumn("n", F.monotonically_increasing_id())
        lines = numbered.join(states, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "n")
    lines = lines.select("path", "block", "value", "inside", "owner")

    def cut(batches):
        for (path, block), rows in _splits(batches):
            out, open_lines, started, inside = [], [], None, None
            for n, (_, _, line, starts_inside, owner) in enumerate(rows):
                if inside is None:
                    inside, started = starts_inside, (owner, None) if starts_inside else None
                if started is None:
                    started = (block, n)
                inside = state_after(line, sep, inside)
                open_lines.append(line)
                if not inside:
                    text = "\n".join(open_lines)
                    whole = started[1] is not None
                    out.append({"path": path, "owner": started[0], "block": block, "n": started[1], "cells": cells(text, sep) if whole else None, "piece": None if whole else text})
                    open_lines, started = [], None
                if len(out) == 2000:
                    yield pa.RecordBatch.from_pylist(out, _PIECES)
                    out = []
            if open_lines:
                out.append({"path": path, "owner": started[0], "block": block, "n": started[1], "cells": None, "piece": "\n".join(open_lines)})
            yield pa.RecordBatch.from_pylist(out, _PIECES)

    found = lines.mapInArrow(cut, "path string, owner long, block long, n long, cells array<string>, piece string")
    crossing = found.where("cells is null").groupBy("path", "owner").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    crossing = crossing.select("path", F.col("owner").alias("block"), "n", F.array_join("pieces.piece", "\n").alias("record"))

    def joined(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([cells(x, sep) for x in batch.column(3).to_pylist()], pa.list_(pa.string()))], names=["path", "block", "n", "cells"])

    return found.where("cells is not null").select("path", "block", "n", "cells").unionByName(crossing.mapInArrow(joined, "path string, block long, n long, cells array<string>"))


_PIECES = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.string())), ("piece", pa.string())])


def header(spark: SparkSession, path: str, sep: str, multiline: bool = True) -> list[str]:
    """The cells of a file's first record."""
    text = None
    for row in spark.read.option("lineSep", "\n").text(path).limit(50).collect():
        text = row.value if text is None else text + "\n" + row.value
        if not multiline or not state_after(text, sep, False):
            break
    return cells((text or "").removeprefix("\ufeff"), sep)


def with_header(records: DataFrame, names: list[str]) -> DataFrame:
    """Records of files that all begin with a header, as the columns `names`; what a short record lacks is null."""
    heads = records.groupBy("path").agg(F.min(F.struct("block", "n")).alias("_head"))
    rows = records.join(heads, "path").where(F.struct("block", "n") != F.col("_head"))
    return rows.select(*(F.try_element_at("cells", F.lit(k + 1)).alias(c) for k, c in enumerate(names)))
