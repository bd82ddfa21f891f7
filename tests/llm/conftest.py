from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long word and text, repeated rows, equal texts, and extra clashing columns."""
    long_text = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog\nthe cat sat on the mat and looked at the dog", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "b", 4),
        (5, "x" * 70_000, "en", "b", None),
        (6, long_text, "fr", "a", len(long_text)),
        (7, "the cat sat on the mat and looked at the dog\nthe cat sat on the mat and looked at the dog", "en", "a", 1),
        (8, "Équipe œuvre 日本語 ß ² <|endoftext|> it's ok line", "de", "c", 9),
        (8, "Équipe œuvre 日本語 ß ² <|endoftext|> it's ok line", "de", "c", 9),
        (9, "idiot", "en", "c", 5),
        (10, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 " * 400, "en", "c", 5),
        (None, "the cat sat on the mat and looked at the dog", "en", "d", 2),
    ]
    extra = ", score double, n long, key string, hash long, label int, start string, pos int, line string, rep long, bit int"
    return spark.createDataFrame([(*r, 0.5, 7, "k", 1, 1, "s", 3, "l", 4, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 0), (6, 1, 0), (7, 1, 0), (8, 0, 1), (8, 1, 1), (9, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
