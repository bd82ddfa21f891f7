"""Accounts that go: what depends on them is deleted, made anonymous or kept, by a graph of tables, one pass a table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows of `table` whose `column` names a deleted row of `parent` are deleted, or lose the name (anonymise), or stay (keep).

    `unless`: an SQL condition on the row; where it holds, the row stays although its parent goes.
    """

    table: str
    column: str
    parent: str
    action: str = "delete"
    unless: str | None = None


def purge(tables: dict[str, DataFrame], rules: Iterable[Rule], root: str, gone: DataFrame, ids: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables as they are after the rows of `root` with an id in gone(id) have gone, and (table, action, rows) counts.

    Parents are worked before what hangs on them: only what is really deleted pulls further rows along, so a row that stays
    keeps its own.  ids names the id column of each table that others refer to.  Rows that several rules hit are deleted
    if one of them says so.
    """
    rules = list(rules)
    if wrong := [r for r in rules if r.action not in ("delete", "anonymise", "keep")]:
        raise ValueError(f"unknown action: {wrong[0].action}")
    order = TopologicalSorter({t: {r.parent for r in rules if r.table == t} for t in tables})
    deleted: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    counts: list[DataFrame] = []
    for name in order.static_order():
        df, own = tables[name], [r for r in rules if r.table == name]
        marked = df
        hits: dict[Rule, Column] = {}
        for i, r in enumerate(own):
            keys = deleted[r.parent].select(F.col("id").alias(f"_gone{i}")).distinct()
            marked = marked.join(keys, F.col(r.column) == F.col(f"_gone{i}"), "left")
            there = F.col(f"_gone{i}").isNotNull()
            hits[r] = there & ~F.coalesce(F.expr(r.unless), F.lit(False)) if r.unless else there
        if name == root:
            marked = marked.join(gone.select(F.col("id").alias("_root")).distinct(), F.col(ids[root]) == F.col("_root"), "left")
        dies = reduce(lambda a, b: a | b, [h for r, h in hits.items() if r.action == "delete"], F.col("_root").isNotNull() if name == root else F.lit(False))
        spared = reduce(lambda a, b: a | b, [F.col(f"_gone{i}").isNotNull() for i, r in enumerate(own) if r.action == "keep" or r.unless], F.lit(False))
        nameless = [(r, h) for r, h in hits.items() if r.action == "anonymise"]
        fate = F.when(dies, "delete")
        if nameless:
            fate = fate.when(reduce(lambda a, b: a | b, [h for _, h in nameless]), "anonymise")
        fate = fate.when(spared, "keep")
        marked = marked.withColumn("_fate", fate)
        counts.append(marked.where("_fate is not null").groupBy(F.lit(name).alias("table_name"), F.col("_fate").alias("action")).agg(F.count("*").alias("n")))
        if name in ids:
            deleted[name] = marked.where("_fate = 'delete'").select(F.col(ids[name]).alias("id"))
        changed = {r.column: F.when(h, F.lit(None)).otherwise(F.col(r.column)) for r, h in nameless}
        out[name] = marked.where("_fate is null or _fate != 'delete'").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in df.columns))
    return out, reduce(DataFrame.unionByName, counts)
