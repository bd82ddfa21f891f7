"""Contact files into companies and people, and these into a store: one action for all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import company_key, professional_mail, split_mails, split_phones
from ..functions.values import blank, first_filled
from ..sinks.store import Action, Store
from .contacts import civility, people
from .crm import name_of_slug
from .rows import first_filled_by

#: Columns of the lines of a file, as its reader and header mapping leave them, beside row_id.
LINE = ("prenom", "nom", "nom_complet", "poste", "societe", "email", "tel", "linkedin", "linkedin_entreprise", "site", "adresse", "ville", "cp", "forme_juridique", "note_societe", "source")
COMPANY = ("raison_sociale", "email", "tel", "site", "linkedin", "adresse", "ville", "cp", "forme_juridique", "note_societe", "source")
PERSON = ("civilite", "prenom", "nom", "poste", "email", "tel", "linkedin", "note_personne", "source")
#: Columns of a contact that an import fills where they are blank; those of its company come from the company's lines.
FACE = {"website": "site", "adresse": "adresse", "zip": "cp", "ville": "ville", "societe_email": "email", "societe_tel": "tel", "societe_linkedin": "linkedin", "forme_juridique": "forme_juridique", "note_societe": "note_societe"}
OWN = {"prenom": "prenom", "nom_personne": "nom", "contact_nom": "full_name", "poste": "poste", "email": "email", "phone": "tel", "linkedin": "linkedin", "note_personne": "note_personne"}


def _lines(rows: DataFrame) -> DataFrame:
    """Lines with their company's key, their people and their phones and mails by whose they are."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    df = rows.select("row_id", *(text(c).alias(c) for c in LINE))
    titled = civility(F.col("societe"))
    flag = F.lower("societe").isin("true", "false", "vrai", "faux", "0", "1")
    nobody = (F.col("prenom") == "") & (F.col("nom") == "") & (F.col("nom_complet") == "")
    df = df.withColumn("_titled", titled.civility != "").withColumn("societe", F.when(flag, "").otherwise(titled.rest))
    df = df.withColumn("nom_complet", F.when(nobody & F.col("_titled"), F.col("societe")).otherwise(F.col("nom_complet")))
    given, one = civility(F.col("prenom")), civility(F.when(F.col("prenom") != "", F.col("prenom")).otherwise(F.col("nom")))
    words = F.split(one.rest, r"\s+")
    kind = "array<struct<civility:string,given:string,family:string,job:string,note:string>>"

    def person(c: Column, g: Column, f: Column) -> Column:
        return F.array(F.struct(c.alias("civility"), g.alias("given"), f.alias("family"), F.col("poste").alias("job"), F.lit("").alias("note"))).cast(kind)

    single = F.when(F.size(words) > 1, person(one.civility, words[0], F.array_join(F.slice(words, 2, 100), " "))).when(F.col("prenom") != "", person(one.civility, one.rest, F.lit(""))).otherwise(person(one.civility, F.lit(""), one.rest))
    found = F.when((F.col("prenom") != "") & (F.col("nom") != ""), person(given.civility, given.rest, F.col("nom"))).when((F.col("prenom") != "") | (F.col("nom") != ""), single).otherwise(people(F.col("nom_complet"), F.col("poste")).cast(kind))
    return df.withColumns({"cle": company_key(F.col("societe")), "gens": found, "tels": split_phones(F.col("tel")), "mails": split_mails(F.col("email"))})


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, people) of the lines of a file, rows(row_id and LINE), each once.

    Companies are told by the key of their name, people by their mail, else by the keys of their name and company; of each
    field the first filled one counts, in the order of row_id.  General mails and fixed lines go to the company, a person's
    own ones to the first person of the line; without a company they all go to this person, without a person to the
    company.  A person with a company, a professional mail or a job is pro, others are reserve.  rows tells how many lines.
    """
    lines = _lines(rows)
    first = lambda *arrays: F.coalesce(*(F.get(a, F.lit(0)) for a in arrays))
    someone, company = F.size("gens") > 0, F.col("cle") != ""
    own = {c: F.col(c) for c in ("site", "adresse", "ville", "cp", "forme_juridique", "note_societe", "source")}
    own |= {"raison_sociale": F.col("societe"), "tel": F.when(someone, first(F.col("tels.company"))).otherwise(first(F.col("tels.company"), F.col("tels.person"))), "email": F.when(someone, first(F.col("mails.company"))).otherwise(first(F.col("mails.company"), F.col("mails.person"))), "linkedin": F.when(someone, F.col("linkedin_entreprise")).otherwise(first_filled("linkedin_entreprise", "linkedin"))}
    companies = first_filled_by(lines.where(company).select("cle", "row_id", *(own[c].alias(c) for c in COMPANY)), ["cle"], ["row_id"], list(COMPANY))
    each = lines.select("*", F.posexplode("gens").alias("place", "g"))
    lead = F.col("place") == 0
    mail = F.when(lead, F.coalesce(first(F.col("mails.person")), F.when(~company, first(F.col("mails.company")))))
    phone = F.when(lead, F.coalesce(first(F.col("tels.person")), F.when(~company, first(F.col("tels.company")))))
    job = first_filled(F.col("g.job"), F.col("poste"))
    each = each.select("row_id", "place", "cle", F.col("g.civility").alias("civilite"), F.col("g.given").alias("prenom"), F.col("g.family").alias("nom"), job.alias("poste"), mail.alias("email"), phone.alias("tel"), F.when(lead, F.col("linkedin")).alias("linkedin"), F.col("g.note").alias("note_personne"), "source")
    # a name that is missing may stand in the address of a network page
    words = F.split(name_of_slug(F.col("linkedin")), " ")
    named = blank("nom") & F.coalesce(F.size(words) > 1, F.lit(False))
    each = each.withColumn("nom", F.when(named, F.array_join(F.slice(words, 2, 100), " ")).otherwise(F.col("nom"))).withColumn("prenom", F.when(named & blank("prenom"), words[0]).otherwise(F.col("prenom")))
    full = F.trim(F.concat_ws(" ", "prenom", "nom"))
    each = each.withColumn("key", F.when(~blank("email"), F.concat(F.lit("e:"), "email")).otherwise(F.concat(F.lit("n:"), company_key(full), F.lit("|"), "cle")))
    each = each.withColumn("statut", F.when((F.col("cle") != "") | professional_mail(F.col("email")) | ~blank("poste"), "pro"))
    found = first_filled_by(each.withColumn("societe_cle", F.col("cle")), ["key"], ["row_id", "place"], [*PERSON, "societe_cle", "statut"])
    return companies, found.withColumns({"full_name": F.trim(F.concat_ws(" ", "prenom", "nom")), "statut": F.coalesce("statut", F.lit("reserve"))})


def _id(prefix: str, key: Column) -> Column:
    """The same for the same key: a file that comes twice makes nobody twice."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 24))


def changes(companies: DataFrame, persons: DataFrame, stored_companies: DataFrame, stored_contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a plan changes: new companies (id, cle_normalisee and COMPANY), and contacts with their outcome.

    stored_companies has id and cle_normalisee, stored_contacts id, email, contact_nom, societe_id, statut, source and the
    columns of OWN and FACE.  A person with a mail meets the contact of this mail only, one without that of the same name and
    company.  Met contacts are enriched where blank, a reserve one may become pro; others are created.  A company without
    people, which no contact stands for, becomes a contact of its own (entity).
    """
    low = F.lower(F.trim(F.col("email")))
    known = stored_companies.where(~blank("cle_normalisee")).groupBy(F.col("cle_normalisee").alias("cle")).agg(F.min("id").alias("known_id"))
    firms = companies.join(known, "cle", "left").withColumn("societe_id", F.coalesce("known_id", _id("s_", F.col("cle"))))
    new_companies = firms.where("known_id is null").select(F.col("societe_id").alias("id"), F.col("cle").alias("cle_normalisee"), *COMPANY)

    face = firms.select(F.col("cle").alias("societe_cle"), "societe_id", "raison_sociale", *(F.col(c).alias(f"_{f}") for f, c in FACE.items()))
    asked = persons.select("key", "societe_cle", "statut", "source", *(F.col(c).alias(f"_{f}") for f, c in OWN.items())).join(face, "societe_cle", "left")
    names = stored_contacts.select("id", company_key(F.col("contact_nom")).alias("_name"), F.coalesce("societe_id", F.lit("")).alias("_company")).where("_name != ''")
    by_mail = stored_contacts.where(~blank("email")).groupBy(low.alias("_mail")).agg(F.min("id").alias("mail_id"))
    by_name = names.groupBy("_name", "_company").agg(F.min("id").alias("name_id"))
    alone = blank("_email")
    asked = asked.withColumns({"_mail": F.when(~alone, F.lower(F.trim("_email"))), "_name": F.when(alone, company_key(F.col("_contact_nom"))), "_company": F.when(alone, F.coalesce("societe_id", F.lit("")))})
    met = asked.join(by_mail, "_mail", "left").join(by_name, ["_name", "_company"], "left").withColumn("id", F.coalesce("mail_id", "name_id"))

    fill = [f"_{f}" for f in (*OWN, *FACE)]
    brought = first_filled_by(met.where("id is not null").withColumn("_pro", F.when(F.col("statut") == "pro", "pro")), ["id"], ["key"], [*fill, "societe_id", "source", "_pro"])
    old = stored_contacts.alias("o").join(brought.alias("b"), F.col("o.id") == F.col("b.id"))
    keep = lambda c, new: F.when(blank(F.col(f"o.{c}").cast("string")), F.col(f"b.{new}")).otherwise(F.col(f"o.{c}")).alias(c)
    status = F.when(blank(F.col("o.statut")), F.coalesce("b._pro", F.lit("reserve"))).when((F.col("o.statut") == "reserve") & F.col("b._pro").isNotNull(), "pro").otherwise(F.col("o.statut"))
    columns = ["id", "nom", *OWN, *FACE, "societe_id", "statut", "source", "status"]
    enriched = old.select(F.col("o.id").alias("id"), F.col("o.nom").alias("nom"), *(keep(f, f"_{f}") for f in (*OWN, *FACE)), keep("societe_id", "societe_id"), status.alias("statut"), keep("source", "source"), F.col("o.status").alias("status")).withColumn("outcome", F.lit("enriched"))

    fresh = met.where("id is null")
    created = fresh.select(_id("c_", F.col("key")).alias("id"), F.coalesce("raison_sociale", "_contact_nom").alias("nom"), *(F.col(f"_{f}").alias(f) for f in (*OWN, *FACE)), "societe_id", "statut", first_filled(F.col("source"), F.lit("import")).alias("source"), F.lit("new").alias("status")).withColumn("outcome", F.lit("created"))
    bare = firms.join(persons.select(F.col("societe_cle").alias("cle")), "cle", "left_anti").join(stored_contacts.where(~blank("societe_id")).select("societe_id"), "societe_id", "left_anti")
    nothing = F.lit(None).cast("string")
    entity = bare.select(_id("c_", F.concat(F.lit("entity|"), "cle")).alias("id"), F.col("raison_sociale").alias("nom"), *(nothing.alias(f) for f in OWN), *(F.col(c).alias(f) for f, c in FACE.items()), "societe_id", F.lit("pro").alias("statut"), first_filled(F.col("source"), F.lit("import")).alias("source"), F.lit("new").alias("status")).withColumn("outcome", F.lit("entity"))
    order = [*columns, "outcome"]
    return new_companies, enriched.select(order).unionByName(created.select(order)).unionByName(entity.select(order))


_COMPANIES = "id string, cle_normalisee string, " + ", ".join(f"{c} string" for c in COMPANY)
_CONTACTS = "id string, nom string, " + ", ".join(f"{c} string" for c in (*OWN, *FACE)) + ", societe_id string, statut string, source string, status string"


def import_file(store: Store, rows: DataFrame) -> dict[str, int]:
    """Takes the lines of a file into the tables companies and contacts of a store, as one action, and tells what it did."""
    spark, told = store.spark, {}
    companies, persons = (x.persist() for x in plan(rows))

    def work(action: Action) -> None:
        read = lambda t, ddl: action.read(t) if action.has(t) else spark.createDataFrame([], ddl)
        firms, contacts = changes(companies, persons, read("companies", _COMPANIES), read("contacts", _CONTACTS))
        contacts = contacts.persist()
        try:
            told.clear()
            told.update({o: 0 for o in ("created", "enriched", "entity")} | {r.outcome: r["count"] for r in contacts.groupBy("outcome").count().collect()})
            action.upsert("companies", firms, ["id"])
            action.upsert("contacts", contacts.drop("outcome"), ["id"])
            told["companies"] = action.counts["companies"]["created"]
        finally:
            contacts.unpersist()

    try:
        store.retry(work)
    finally:
        companies.unpersist(), persons.unpersist()
    return dict(told)
