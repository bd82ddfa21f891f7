"""Contacts, probes and prospects on odd rows: nulls, blanks, ties, repeated rows and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospark.operators import contacts
from prospark.operators.rows import sessions

SIDE = "name string, city string, postcode string, street string, number string, answer string"


def test_people_of_odd_cells(spark):
    rows = [(None,), ("",), (" / & ",), ("Mme.",), ("Mme Ada",), ("A B et C D + E",), ("A B (Nord) C D",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(F.transform(contacts.people(F.col("c"), F.lit(None).cast("string")), lambda p: F.concat_ws("|", p.civility, p.given, p.family, p.note))).collect()]
    assert got == [[], [], [], ["||Mme.|"], ["Mme||Ada|"], ["|A|B|", "|C|D|", "||E|"], ["|A|B|Nord", "|C|D|"]]


def test_title_rows():
    body = [["a", "b", "c"], ["1", "2", "3"]]
    assert contacts.without_title([["My list", "", ""], *body]) == body
    assert contacts.without_title([["x", "y", "z"], *body]) == [["x", "y", "z"], *body]
    assert contacts.without_title(body) == body
    assert contacts.without_title([["Title", "", ""], ["1", "2", "3"], ["4", "5", "6"]])[0] == ["Title", "", ""]


def test_address_probe(spark):
    place = ("Firm", "Nice", "06000")
    points = [(1, *place, "rue Foch", "3", "x"), (2, *place, "r Foch", "3 bis", "x"), (3, *place, "rue Pasteur", "1", "y"), (4, *place, "rue Pasteur", "1", "z"), (5, None, None, None, None, None, None)]
    companies = [(10, *place, "R. Foch", "3", None), (11, *place, "rue Pasteur", "1", None), (12, *place, "rue Foch", None, None), (13, None, "Nice", "06000", "", "", None), (14, "Firm", "Lyon", "06000", "", "", None)]
    c, p = spark.createDataFrame(companies, f"soc long, {SIDE}"), spark.createDataFrame(points, f"poi long, {SIDE}")
    got = {(r.soc, r.level, r.poi) for r in contacts.address_probe(c, p, "soc", "poi", "answer").collect()}
    assert got == {(10, "L3", 1), (12, "L2", 1)}, "11 is ambiguous, 13 and 14 have no place in common"
    assert contacts.address_probe(c, p.limit(0), "soc", "poi", "answer").count() == 0


def test_prospects(spark):
    schema = "request_id long, user_id long, siren string, siret string, state string, people array<string>"
    asked = [(1, 1, "s1", "e1", "C", ["a"]), (2, 1, "s 1", "e1", "A", ["a", "b"]), (3, 1, "s1", "e1", None, None), (4, 2, None, "e1", None, None), (5, 2, "s2", "e9", None, None), (6, 2, "s3", None, None, None)]
    held = spark.createDataFrame([(2, "s3"), (2, "s3"), (None, None)], "user_id long, siren string")
    blocked = spark.createDataFrame([("e9",), ("e9",), (None,), ("",)], "s string").select(F.sha2("s", 256).alias("siret_hash"))
    got = contacts.prospects(spark.createDataFrame(asked, schema), held, held.limit(0), blocked).collect()
    assert {(r.request_id, r.refusal, r.new_company, r.n_contacts, r.new_card) for r in got} == {
        (1, "closed", False, 0, False), (2, None, True, 2, True), (3, None, False, 0, False), (4, "no siren", False, 0, False), (5, "opted out", False, 0, False), (6, None, False, 0, True),
    }


def test_untimed_rows_keep_their_group(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2)], "k string, ts timestamp, id long")
    assert sorted(r.session for r in sessions(df, ["k"], "ts", 5, tie="id").collect()) == ["untimed-1", "untimed-2"]
    assert len({r.session for r in sessions(df, ["k"], "ts", 5).collect()}) == 2
