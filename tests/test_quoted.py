"""Delimited text in splits of a few bytes against the csv module and against the rules read sign by sign."""

from __future__ import annotations

import csv
import io
import random

import pytest

from prospark.sources import files, quoted


def by_sign(text: str, sep: str, multiline: bool = True) -> list[list[str]]:
    """The rules, a sign at a time."""
    rows, row, field, inside, first = [], [], "", False, True
    k = 0
    while k < len(text):
        c = text[k]
        if inside and (multiline or c != "\n"):
            if c == '"' and text[k + 1 : k + 2] == '"':
                field, k = field + '"', k + 1
            elif c == '"':
                inside = False
            else:
                field += c
        elif first and c == '"':
            inside, first = True, False
        elif c == sep or c == "\n":
            row.append(field)
            field, first, inside = "", True, False
            if c == "\n":
                rows.append(row)
                row = []
        else:
            first = False
            field += "" if c == "\r" else c
        k += 1
    if text and not text.endswith("\n") or inside or row:
        rows.append([*row, field])
    return rows


def placed(df) -> list[list[str]]:
    return [r.cells for r in sorted(df.collect(), key=lambda r: (r.path, r.block, r.n))]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k in keys:
        spark.conf.set(k, "90b")
    yield
    for k in keys:
        spark.conf.unset(k)


def test_equal_to_the_csv_module(spark, tmp_path, small_splits):
    r = random.Random(5)
    rows = [["".join(r.choice('ab "",\n;é') for _ in range(r.randrange(9))) for _ in range(3)] for _ in range(400)]
    rows[7][1], rows[90][2] = "long\n" * 60, '"' * 99  # records over many splits
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "a.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    df = quoted.read_records(spark, str(tmp_path / "a.csv"))
    assert placed(df) == rows == list(csv.reader(io.StringIO(out.getvalue())))
    assert df.select("block").distinct().count() > 20
    assert placed(quoted.read_records(spark, str(tmp_path / "a.csv"), broadcast_splits=0)) == rows


def test_any_text(spark, tmp_path, small_splits):
    """Quotes anywhere, carriage returns, quotations left open: several files together."""
    r = random.Random(6)
    want = []
    for k in range(12):
        text = "".join(r.choice(['"', '"', ",", "\n", "\r\n", "a", "bc", '""', "é", " "]) for _ in range(300))
        text = text.removeprefix('"') if k % 2 else text
        (tmp_path / f"{k:02}.csv").write_text(text, encoding="utf-8", newline="")
        want += by_sign(text, ",")
    assert placed(quoted.read_records(spark, str(tmp_path))) == want


def test_quotations_that_end_with_their_line(spark, tmp_path):
    text = 'a;"b\nc";d"e\n"x ""y"" z"w";"q\r\n'
    (tmp_path / "a.csv").write_text(text, newline="")
    assert placed(quoted.read_records(spark, str(tmp_path), ";", multiline=False)) == [["a", "b"], ['c"', 'd"e'], ['x "y" zw"', "q\r"]]


def test_cells_of_any_record():
    r = random.Random(7)
    for _ in range(4000):
        line = "".join(r.choice('",a') for _ in range(r.randrange(9)))
        assert quoted.cells(line, ",") == (by_sign(line, ",") or [[""]])[0]


def test_csv_of_a_register(spark, tmp_path, small_splits):
    rows = "".join(f'{i};"Maison ""{i}""\nrue";-\n\n' for i in range(200))
    (tmp_path / "r.csv").write_text("﻿Numéro;Raison\xa0Sociale;Été\n" + rows, encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "r.csv"), required=["numero"])
    assert df.columns == ["numero", "raison_sociale", "ete"]
    assert sorted((int(r.numero), r.raison_sociale, r.ete) for r in df.collect()) == [(i, f'Maison "{i}"\nrue', None) for i in range(200)]
    assert {r.ete for r in files.read_csv(spark, str(tmp_path / "r.csv"), dash=False).collect()} == {"-"}
