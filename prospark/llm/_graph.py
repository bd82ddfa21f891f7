"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

PART = 200_000  # edges that one task shrinks in memory


def _local(batches):
    """Union-find over the edges of one partition: the same connections as stars, at most one edge a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    star = [(x, root(x)) for x in list(parent)]
    star = np.asarray([e for e in star if e[0] != e[1]], np.int64).reshape(-1, 2)
    for k in range(0, len(star), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(star[k : k + 100_000, 0]), pa.array(star[k : k + 100_000, 1])], ["u", "v"])


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u, v), v < u: neighbours are hung on the smallest one known."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), a != b; component is the smallest node it is connected with.

    Parts of at most about PART edges first shrink their own edges to stars; with more than one part, star steps then run
    until nothing changes, each written to the shared folder.  No step needs all edges of a node or a component in one place.
    """

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    parts = max(1, -(-edges.count() // PART))
    e = (edges.select("a", "b").coalesce(1) if parts == 1 else edges.select("a", "b").repartition(parts)).mapInArrow(_local, "u long, v long")
    e = stored(e if parts == 1 else e.distinct())
    seen = mark(e) if parts > 1 else (0, None)  # the edges of a single part are stars already
    while seen[0]:
        e = stored(_stars(e))
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
