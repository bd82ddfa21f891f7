"""A Merkle manifest of a dataset: one tree a language, and one over the languages, with a proof for every row.

A leaf is H (lowercase hex SHA-256) of a row's columns, each `-` if null, else its bytes of UTF-8, `:`, its value.  Leaves
of a language ascend by doc_id (null first; equal ones by digest, so repeated rows keep no order among themselves and need
none).  Level by level, every two consecutive nodes become the H of their joined digests, the last run as it is, until one
node is left: the subroot.  Subroots in the order of their languages (null first, by bytes) are the leaves of the last tree.

Rows are sorted by range, so no language lies in one task, and numbered by the counts of the ranges.  Buckets of 2 ** DEPTH
consecutive leaves are aligned with the tree: each is a subtree of its own, which DuckDB builds within an executor
(`string_agg` in order and `sha256`, a query a level).  The roots of buckets are the leaves of the next round.  Proofs of the
outer rounds, a row for each bucket, are joined to the leaves.

Defined results: an empty table gives no rows; a null doc_id is a row like others and never tampered; a null in any column
is `-`; columns other than the five are ignored; a lone leaf is its language's subroot and has no siblings there.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DEPTH = 12  # levels of a bucket: at most 2 ** 12 leaves
_LEVEL = "insert into nodes select $level + 1, p // 2, sha256(string_agg(h, '' order by p)) from nodes where level = $level group by p // 2"
_PATHS = """
select l.pos, list(case when s.h is null then '' when s.p < (l.p >> d.level) then '<' || s.h else '>' || s.h end order by d.level) as path
from leaves l cross join (select unnest(range($levels)) as level) d left join nodes s on s.level = d.level and s.p = xor(l.p >> d.level, 1)
group by l.pos"""


def digest(columns: list[Column]) -> Column:
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)).cast("binary"), 256)


def _buckets(depth: int) -> Callable[[pa.Table], pa.Table]:
    def bucket(table: pa.Table) -> pa.Table:
        return _bucket(table, depth)

    return bucket


def _bucket(table: pa.Table, depth: int) -> pa.Table:
    """One aligned bucket: the path of each node up to the bucket's root, as siblings with their sides, and that root."""
    import duckdb

    levels = min(depth, (table.column("n")[0].as_py() - 1).bit_length())
    with duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""}) as db:
        db.register("rows", table.select(["pos", "h"]))
        db.execute(f"create table leaves as select pos, pos % {1 << depth} as p, h from rows")
        db.execute("create table nodes as select 0 as level, p, h from leaves")
        for level in range(levels):
            db.execute(_LEVEL, {"level": level})
        root = db.execute("select h from nodes where level = $1", [levels]).fetchone()[0]
        paths = dict(db.execute(_PATHS, {"levels": levels}).fetchall())
    path = pa.array([paths.get(p, []) for p in table.column("pos").to_pylist()], pa.list_(pa.string()))
    return pa.table([table.column("tree"), table.column("bucket"), table.column("item"), path, pa.array([root] * len(path))], ["tree", "bucket", "item", "path", "root"])


def _numbered(df: DataFrame) -> DataFrame:
    """df(tree, key, h, item) with pos, the row's place within its tree by key and h, and n, the tree's rows."""
    placed = stored(df.repartitionByRange("tree", "key", "h").sortWithinPartitions("tree", "key", "h").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("tree", part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part")  # a row a range and tree, so few
    counts = counts.select("tree", "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    return placed.withColumn("_part", part).join(counts, ["tree", "_part"]).select("tree", (F.col("_at") + F.col("_shift")).alias("pos"), "n", "h", "item")


def proofs(df: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """df(tree string, key, h, item): the trees of its rows by (key, h), built in buckets of 2 ** depth leaves.

    Gives (tree, bucket, item, path), for each row the path up to its bucket's root; (tree, bucket, above), the path from
    there; and (tree, h), the roots.
    """
    nodes, rounds = _numbered(df), []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        item = nodes.schema["item"].dataType.simpleString()
        grouped = nodes.withColumn("bucket", F.shiftright("pos", depth)).groupBy("tree", "bucket")
        rounds.append(stored(grouped.applyInArrow(_buckets(depth), f"tree string, bucket long, item {item}, path array<string>, root string")))
        roots = rounds[-1].groupBy("tree", "bucket").agg(F.first("root").alias("h"))
        if most <= 1 << depth:
            break
        most = -(-most >> depth)
        size = roots.groupBy("tree").agg(F.count("*").alias("n"))
        nodes = roots.join(size, "tree").select("tree", F.col("bucket").alias("pos"), "n", "h", F.col("bucket").alias("item"))
    above = roots.select("tree", "bucket", F.array().cast("array<string>").alias("above"))
    for found in reversed(rounds[1:]):
        above = found.join(above, ["tree", "bucket"]).select("tree", F.col("item").alias("bucket"), F.concat("path", "above").alias("above"))
    return rounds[0].select("tree", "bucket", "item", "path"), above, roots.select("tree", "h")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    up = lambda node, s: F.sha2(F.when(F.startswith(s, F.lit("<")), F.concat(F.substring(s, 2, 64), node)).otherwise(F.concat(node, F.substring(s, 2, 64))).cast("binary"), 256)
    return F.aggregate(path, leaf, up)


def _tampered() -> Column:
    """Of every seventh row by crc32 of its doc_id, the count of characters plus one."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, more).otherwise(F.col("n_chars").cast("string"))


def manifest(docs: DataFrame, changed: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs(doc_id, source, lang, n_chars, text).

    `changed`: the n_chars that a row is checked with against its proof; by default those of every seventh row are one too
    many, to show that the proofs find it.
    """
    own = [F.col(c) for c in COLUMNS]
    other = [(_tampered() if changed is None else changed) if c == "n_chars" else F.col(c) for c in COLUMNS]
    leaf = docs.select(F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"), F.col("doc_id").alias("key"), digest(own).alias("h"), digest(other).alias("_h"))
    leaves, above, subroots = proofs(leaf.select("tree", "key", "h", F.struct("key", "h", F.when(F.col("_h") != F.col("h"), F.col("_h")).alias("changed")).alias("item")), depth)
    outer, further, root = proofs(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "h", F.struct("tree", "h").alias("item")), depth)
    outer = outer.join(further, ["tree", "bucket"]).join(root, "tree").select("item.tree", F.col("item.h").alias("subroot"), F.concat("path", "above").alias("_outer"), F.col("h").alias("root"))
    above = above.join(outer, "tree").select("tree", "bucket", F.concat("above", "_outer").alias("above"), "subroot", "root")
    found = leaves.join(above, ["tree", "bucket"]).select(F.col("item.key").alias("doc_id"), F.col("item.h").alias("leaf"), F.col("item.changed").alias("_changed"), "subroot", "root", F.concat("path", "above").alias("_path"))
    found = found.withColumn("folded_root", folded(F.col("_path"), F.coalesce("_changed", "leaf")))
    proof = F.sha2(F.concat_ws("", F.transform("_path", lambda s: F.substring(s, 2, 64))).cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = """xor(4294967295, list_reduce(
      list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)::ubigint[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
ORACLE_SQL = f"""
with recursive texts as (
  select doc_id, case when lang is null then '0' else '1' || lang end as tree,
    concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) as head,
    n_chars, n_chars + ({_CRC} % 7 = 0)::int as wrong, coalesce(strlen(text) || ':' || text, '-') as tail
  from documents
), leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || coalesce(strlen(wrong::varchar) || ':' || wrong, '-') || tail) as changed
  from texts
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves
), nodes as (
  select tree, 0 as level, pos as p, leaf as h, n from placed
  union all
  select tree, level + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2 from nodes where n > 1 group by tree, level, p // 2
), subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1
), top as (
  select 0 as level, pos as p, subroot as h, n from subroots
  union all
  select level + 1, p // 2, sha256(string_agg(h, '' order by p)), (any_value(n) + 1) // 2 from top where n > 1 group by level, p // 2
), outer_paths as (
  select s.tree, any_value(s.subroot) as subroot, list(case when t.h is null then '' when t.p < s.pos >> l.level then '<' || t.h else '>' || t.h end order by l.level) as path
  from subroots s join (select distinct level from top where n > 1 or level = 0) l on true left join top t on t.level = l.level and t.p = xor(s.pos >> l.level, 1)
  group by s.tree
), inner_paths as (
  select a.tree, a.pos, list(case when b.h is null then '' when b.p < a.pos >> l.level then '<' || b.h else '>' || b.h end order by l.level) as path
  from placed a join (select distinct tree, level from nodes where n > 1 or level = 0) l using (tree)
  left join nodes b on b.tree = a.tree and b.level = l.level and b.p = xor(a.pos >> l.level, 1)
  group by a.tree, a.pos
), whole as (
  select p.*, o.subroot, (select h from top where n = 1) as root,
    list_concat(case when p.n > 1 then i.path else [] end, case when (select count(*) from subroots) > 1 then o.path else [] end) as path
  from placed p join inner_paths i using (tree, pos) join outer_paths o using (tree)
), folded as (
  select *, list_reduce(list_concat([changed], path), lambda node, s: sha256(case when s[1] = '<' then s[2:] || node else node || s[2:] end)) as folded_root from whole
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded
"""
