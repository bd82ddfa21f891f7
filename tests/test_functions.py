"""Column functions and operators on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from prospark.functions import names, values
from prospark.operators import matching, rows


def one(spark, column, *args):
    df = spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(column(*(F.col(f"c{i}") for i in range(len(args))))).first()[0]


@pytest.mark.parametrize(("name", "key"), [("École Dupont SARL", "ecole dupont"), ("SAS", ""), ("Visa", "visa"), (None, ""), ("A.B. Paris sas", "a b")])
def test_company_key(spark, name, key):
    assert one(spark, names.company_key, name) == key


def test_streets(spark):
    assert one(spark, names.street_key, "av", "de la République") == "avenue republique"
    assert tuple(one(spark, names.parse_address, "12 BIS RUE DES LILAS 75001 PARIS")) == ("12", "rue lilas")
    assert one(spark, names.streets_agree, "cours docteur jacques noel", "cr doct jacques noel")
    assert not one(spark, names.streets_agree, "rue roosevelt", "rue r")
    assert not one(spark, names.streets_agree, "rue", "rue")
    assert one(spark, names.same_number, "12 bis", "12") and not one(spark, names.same_number, "", "")


def test_contacts(spark):
    assert one(spark, names.phone, "+33 6 12 34 56 78") == "0612345678"
    assert one(spark, names.phone_class, "+33 6 12 34 56 78") == "mobile"
    assert one(spark, names.phone_class, "0800 000 000") == "douteux"
    assert one(spark, names.mail_class, "contact.x@a.fr") == "societe" and one(spark, names.mail_class, "jane@a.fr") == "personne"
    assert not one(spark, names.professional_mail, "a@gmail.com") and one(spark, names.professional_mail, "a@corp.fr")
    assert one(spark, names.mails_in, "A@b.fr noreply@b.fr x@example.com y@z.ovh.net a@b.fr") == ["a@b.fr"]
    assert one(spark, names.phones_in, "tel 01 02 03 04 05 et +33 8 00 00 00 00 ou 0102030405") == ["0102030405"]
    assert tuple(one(spark, names.split_phones, "06 11 22 33 44 / 01 11 22 33 44")) == (["01 11 22 33 44"], ["06 11 22 33 44"])
    assert one(spark, names.domain, "HTTPS://www.Site.fr:80/a") == "site.fr" and one(spark, names.domain, None) == ""


def test_values(spark):
    assert one(spark, values.department, "20100") == "2A" and one(spark, values.department, "20200") == "2B" and one(spark, values.department, "97110") == "971"
    assert one(spark, values.siret, "123 456 789 01234") == "12345678901234" and one(spark, values.siret, "1") == ""
    assert one(spark, values.naf_dotted, "6201z") == "62.01Z"
    assert one(spark, values.bare_id, "pipeline:⟨abc⟩") == "abc"
    assert [one(spark, lambda c: values.cents(c.cast("double")), x) for x in ("1.005", "1.255", "0.335")] == [101, 126, 34]
    assert one(spark, lambda c: values.served(c, F.array(F.lit("2A"))), "20200")
    assert one(spark, values.whole_number, "12x") is None


def test_render(spark):
    values_ = F.create_map(F.lit("a"), F.lit("1"))
    assert spark.range(1).select(names.render(F.lit("{{ a }}-{{b}}-{{a}}-x}}"), values_)).first()[0] == "1--1-x}}"


def test_sessions(spark):
    df = spark.sql("select k, timestamp_millis(t) as ts, g from values ('a', 0, ''), ('a', 300000, null), ('a', 600001, ''), ('a', 9000000, 'x'), ('a', 20000000, 'x'), ('a', null, '') v(k, t, g)")
    got = sorted(r.n for r in rows.sessions(df, ["k"], "ts", 300, "g").groupBy("session").agg(F.count("*").alias("n")).collect())
    assert got == [1, 1, 2, 2]


def test_matching(spark):
    a = spark.createDataFrame([(1, None, "d", "t"), (2, None, "d", ""), (3, "s", "", "")], "soc int, siret string, domain string, tel string")
    b = spark.createDataFrame([(10, "s", "x", None), (11, None, "d", "t"), (12, None, "d", "u")], "poi int, siret string, domain string, tel string")
    got = {r.soc: (r.poi, r.level) for r in matching.signal_votes(a, b, "soc", "poi", ["siret"], ["domain", "tel"]).collect()}
    assert got == {1: (11, "presumed"), 3: (10, "certain")}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_votes_are_those_of_all_pairs(spark, least):
    """Keys that many rows share, blanks on either side, an id of several rows, and two certain keys of which the first decides."""
    r = random.Random(least)
    value = lambda n, p: r.choice([None, "", " "]) if r.random() < p else f"v{r.randrange(n)}"
    row = lambda i: (i, value(30, 0.8), value(30, 0.8), value(3, 0.3), value(4, 0.3), value(5, 0.3))
    left, right = [row(k % 140) for k in range(150)], [row(k) for k in range(60)]
    ddl = "id int, a string, b string, x string, y string, z string"
    b = spark.createDataFrame(right, ddl).withColumnRenamed("id", "poi")
    got = [tuple(x) for x in matching.signal_votes(spark.createDataFrame(left, ddl), b, "id", "poi", ["a", "b"], ["x", "y", "z"], least).collect()]
    same = lambda u, v: bool(u and u.strip() and u == v)
    want = {}
    for u in left:
        for v in right:
            agree = [same(p, q) for p, q in zip(u[1:], v[1:])]
            n = sum(agree[2:])
            if any(agree[:2]) or n >= least:
                order = 0 if agree[0] else 1 if agree[1] else 2
                want[u[0]] = min(want.get(u[0], (9,)), (order, -n, v[0]))
    assert sorted(got) == sorted((i, p, "presumed" if o == 2 else "certain", -n) for i, (o, n, p) in want.items()) and {x[2] for x in got} == {"certain", "presumed"}


def test_votes_make_no_pairs(spark):
    """300 companies and 300 points with the same two signals: a join makes a row each, not 90,000."""
    a = spark.range(300).select(F.col("id").alias("soc"), F.lit("d").alias("domain"), F.lit("t").alias("tel"))
    out = matching.signal_votes(a, a.withColumnRenamed("soc", "poi"), "soc", "poi", [], ["domain", "tel"])
    assert {tuple(r) for r in out.collect()} == {(k, 0, "presumed", 2) for k in range(300)}
    plan, most = out._jdf.queryExecution().executedPlan(), 0
    waiting = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while waiting:
        node = waiting.pop()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())] + ([node.plan()] if "QueryStage" in node.nodeName() else [])
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most <= 300


def test_merge(spark):
    old = spark.createDataFrame([(1, "x", "o"), (2, "", "o"), (3, "z", "o")], "id int, a string, b string")
    new = spark.createDataFrame([(1, "y", None), (2, "y", "n"), (4, "w", "n")], "id int, a string, b string")
    got = {r.id: (r.a, r.b, r.action) for r in rows.merge_fill(old, new, "id", ["a"], ["b"]).collect()}
    assert got == {1: ("x", None, "updated"), 2: ("y", "n", "updated"), 3: ("z", "o", "kept"), 4: ("w", "n", "created")}
