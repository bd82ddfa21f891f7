"""Contact files: people by mail or name, companies by key, one action that may come twice."""

from __future__ import annotations

import pytest

from prospark.operators import contacts, crm, imports
from prospark.sinks.store import Store


def lines(spark, *rows):
    return spark.createDataFrame([(i, *(r.get(c) for c in imports.LINE)) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{c} string" for c in imports.LINE))


def test_plan(spark):
    rows = lines(
        spark,
        {"prenom": "M. Jean", "nom": "Roy", "societe": "ACME SARL", "email": "jean@acme.fr / contact@acme.fr", "tel": "06 12 34 56 78; 01 42 68 53 00", "ville": "Lyon"},
        {"prenom": "Jean", "nom": "Roi", "societe": "Acme", "email": "JEAN@acme.fr", "poste": "gérant", "site": "acme.fr"},
        {"nom_complet": "Anne Do / Léo Ba (Co-gérants)", "societe": "Bêta", "tel": "0611111111"},
        {"nom_complet": "Anne Do", "societe": "BETA", "linkedin": "https://linkedin.com/in/anne-do"},
        {"societe": "Gamma SAS", "email": "gam@gmail.com", "tel": "0622222222", "adresse": "1 rue X"},
        {"societe": "Madame Céline Brun", "email": "info@brun.fr"},
        {"societe": "true", "nom": "Solo", "email": "solo@gmail.com", "tel": "0142685301"},
        {"prenom": "Zoé", "linkedin": "https://www.linkedin.com/in/zoe-le-gall-12ab3/", "societe": "Acme"},
        {},
    )
    companies, people = imports.plan(rows)
    c = {r.cle: r for r in companies.collect()}
    assert set(c) == {"acme", "beta", "gamma", "celine brun"}
    assert (c["acme"].raison_sociale, c["acme"].email, c["acme"].tel, c["acme"].site, c["acme"].ville, c["acme"].rows) == ("ACME SARL", "contact@acme.fr", "01 42 68 53 00", "acme.fr", "Lyon", 3)
    assert (c["gamma"].email, c["gamma"].tel) == ("gam@gmail.com", "0622222222") and c["celine brun"].email == "info@brun.fr"
    p = {r.key: r for r in people.collect()}
    assert set(p) == {"e:jean@acme.fr", "n:anne do|beta", "n:leo ba|beta", "n:celine brun|celine brun", "e:solo@gmail.com", "n:zoe le gall|acme"}
    jean = p["e:jean@acme.fr"]
    assert (jean.civilite, jean.prenom, jean.nom, jean.tel, jean.poste, jean.statut, jean.rows) == ("M.", "Jean", "Roy", "06 12 34 56 78", "gérant", "pro", 2)
    assert (p["n:anne do|beta"].poste, p["n:anne do|beta"].tel, p["n:anne do|beta"].linkedin) == ("Co-gérant", "0611111111", "https://linkedin.com/in/anne-do")
    assert (p["e:solo@gmail.com"].statut, p["e:solo@gmail.com"].tel) == ("reserve", "0142685301")


def test_import_is_one_action_and_comes_twice(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    first = lines(spark, {"prenom": "Jean", "nom": "Roy", "societe": "Acme", "email": "jean@acme.fr"}, {"societe": "Gamma", "ville": "Lyon"}, {"nom_complet": "Ann Lee", "societe": "Acme"})
    assert imports.import_file(store, first) == {"created": 2, "enriched": 0, "entity": 1, "companies": 2}
    assert imports.import_file(store, first) == {"created": 0, "enriched": 2, "entity": 0, "companies": 0}
    assert store.read("contacts").count() == 3 and store.version() == 2
    more = lines(spark, {"prenom": "Jean", "nom": "Roy", "societe": "ACME SAS", "email": "other@acme.fr"}, {"nom_complet": "ANN LEE", "societe": "Acme Sarl", "poste": "chef", "tel": "0611111111"}, {"prenom": "X", "nom": "Y", "email": "jean@acme.fr", "poste": "boss"})
    assert imports.import_file(store, more) == {"created": 1, "enriched": 2, "entity": 0, "companies": 0}
    got = {r.email or r.contact_nom: r for r in store.read("contacts").where("contact_nom is not null").collect()}
    assert set(got) == {"jean@acme.fr", "other@acme.fr", "Ann Lee"}
    assert (got["jean@acme.fr"].contact_nom, got["jean@acme.fr"].poste) == ("Jean Roy", "boss") and (got["Ann Lee"].poste, got["Ann Lee"].phone) == ("chef", "0611111111")
    with pytest.raises(Exception, match="row_id"):
        imports.import_file(store, more.drop("row_id"))
    assert store.version() == 3


def test_mail_against_name(spark):
    """A new mail is a new person, whoever has the same name; without a mail, the keys of name and company tell."""
    stored = spark.createDataFrame([(1, "jean1@x.fr", "Jean Roy", "Acme", "t1"), (2, None, "Ann Lee", "Acme", None)], "id long, email string, name string, company string, tel string")
    rows = spark.createDataFrame([(1, "jean2@x.fr", "Jean Roy", "Acme", None), (2, None, "ann  LEE", "ACME SARL", "t2"), (3, "new@x.fr", "A", "B", None), (4, " NEW@x.fr", "Z", "C", "t4"), (5, "Jean1@x.fr", "Other", "D", "t5")], "row_id long, email string, name string, company string, tel string")
    got = {r.row_id: (r.id, r.outcome, r.tel, r.rows) for r in crm.import_people(stored, rows, ["tel"]).collect()}
    assert got == {1: (None, "created", None, 1), 2: (2, "by name", "t2", 1), 3: (None, "created", "t4", 2), 5: (1, "by mail", "t1", 1)}


def test_headers_of_files():
    assert contacts.header_fields(["Nom", "Adresse", "Ville"]) == ["societe", "adresse", "ville"]
    assert contacts.header_fields(["N°", "Nom", "Prénom", "Région"], [["1", "a", "b", "c"], ["2", "d", "e", "f"]]) == [None, "nom", "prenom", None]
    assert contacts.header_fields(["N°", "Nom"], [["4", "a"], ["2", "b"]])[1] == "nom"
    assert contacts.header_fields(["name", "contact name", "email"]) == [None, "nom_complet", "email"]
    assert contacts.source_of(["First Name", "Last Name", "URL"]) == "linkedin" and contacts.source_of(["E-mail 1 - Value"]) == "gmail"
    assert contacts.source_of(["First Name", "Last Name", "Job Title"]) == "outlook" and contacts.source_of(["Nom", "Tel"]) == "carnet"
