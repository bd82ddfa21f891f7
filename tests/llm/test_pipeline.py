"""The corpus pipeline's stages and the entry module."""

from __future__ import annotations

import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prospark.llm import decontamination, jaccard_join, line_dedup, quality
from prospark.llm._shared import held_out
from prospark.llm.queries import QUERIES


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_entry():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def clashing(documents):
    """Whole documents with columns named as operators name theirs, a repeated row, a null id and a null text."""
    named = {c: F.lit(f"own {c}") for c in ("score", "predicted", "n_lines", "dropped", "digest", "component_id", "_id", "_hit", "_copy", "hash")}
    rows = documents.withColumns(named)
    more = rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")), rows.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**12))
    return rows.unionByName(rows.limit(2)).unionByName(more[0]).unionByName(more[1])


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_stages_keep_what_they_should(spark, sf_dir, clashing):
    """Each stage against the operator on the plain columns; other columns come out as they went in."""
    plain = clashing.select("doc_id", "text")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    model = quality.fit(plain, labels, ~held_out(5, 0))
    components = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(plain).collect()}
    hit = {r.doc_id for r in decontamination.matches(plain, benchmark).collect()}
    lines = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(plain).collect()}
    want = {
        "quality classifier": ids(quality.score(plain, model).where("predicted = 1")),
        "line dedup": None,
        "n-gram Jaccard join": sorted((d is None, d or 0) for d, _ in plain.collect() if d is None or components[d] == d),
        "benchmark decontamination": sorted((d is None, d or 0) for d, _ in plain.collect() if d not in hit),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf_dir)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in ("score", "dropped", "digest", "_copy")), name
        if want[name] is not None:
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == want[name], name
        else:
            assert {(r.doc_id, r.text) for r in rows} <= lines and None in {r.text for r in rows}


def test_pipeline_runs(spark, sf_dir, none):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_stored_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from prospark.llm import _shared

    monkeypatch.setattr(_shared, "_base", lambda _: f"file://{tmp_path}/own")
    assert _shared.stored(spark.range(3)).count() == 3
    assert (tmp_path / "own").exists()
    _shared.clear_stored(spark)
    assert not (tmp_path / "own").exists()


def test_own_folder_is_kept_for_an_application():
    from prospark.llm import _shared

    assert _shared._own("a") == _shared._own("a") != _shared._own("b")
