"""The Merkle manifest against the tree as its definition says it, in small buckets too, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from prospark.llm import merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars) -> str:
    values = [row.doc_id, row.source, row.lang, n_chars, row.text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf its (left, right) siblings by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            first = p // 2 * 2
            paths[k].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + 2])))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def brute(rows) -> list[tuple]:
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r.lang == x), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars))) for x in langs]
    inner = [tree([leaf(r, r.n_chars) for r in g]) for g in groups]
    root, outer = tree([x[0] for x in inner])
    out = []
    for g, (subroot, paths), above in zip(groups, inner, outer):
        for r, path in zip(g, paths):
            n = r.n_chars
            if r.doc_id is not None and n is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0:
                n += 1
            node = leaf(r, n)
            for left, right in path + above:
                node = h(left, node, right)
            out.append((r.doc_id, leaf(r, r.n_chars), subroot, root, h(*(a + b for a, b in path + above)), node, node == root))
    return sorted(out, key=repr)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("depth", [2, 12])
def test_any_depth_of_buckets(spark, documents, depth):
    docs = documents.where("doc_id < 45").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(900 + i, None, f"x{i % 5}" if i % 3 else None, None, i or None) for i in range(9)], docs.schema)
    docs = docs.union(more)
    got = plain(merkle.manifest(docs, depth=depth))
    assert got == brute(docs.collect())
    assert {x[-1] for x in got} == {True, False}


def test_odd_rows(odd, none):
    assert plain(merkle.manifest(odd, depth=2)) == brute(odd.collect())
    assert merkle.manifest(none).collect() == []


def test_a_lone_row(spark, documents):
    one = documents.where("doc_id = 3")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")


def test_any_change_is_found(documents):
    docs = documents.where("doc_id < 60")
    assert {r.verified for r in merkle.manifest(docs, F.col("n_chars")).collect()} == {True}
    assert {r.verified for r in merkle.manifest(docs, F.lit(-1)).collect()} == {False}


def test_sql(spark, sf_dir, documents):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert plain(merkle.manifest(documents)) == sorted(db.execute(merkle.ORACLE_SQL).fetchall(), key=repr)
