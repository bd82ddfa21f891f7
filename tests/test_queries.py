"""Every query that has SQL against that SQL in DuckDB, over whole tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from prospark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert len(rows) == len(expected)
    assert rows == expected
