"""People in cells, headers of imports, names of sites, address probes, prospects made from searches, mail records."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import company_key, fold, street_key
from ..functions.values import blank, first_filled
from .matching import signal_votes

# Beginnings of words that name a job.
JOB_STEMS = ("geran", "cogeran", "presiden", "directeu", "directri", "dg", "pdg", "associ", "fondat", "responsab", "commercial", "dirigean")
# Header words of imports by field.
HEADERS = {
    "prenom": ["prenom", "first name", "given name", "firstname"],
    "nom": ["nom", "last name", "family name", "lastname", "surname", "nom de famille"],
    "nom_complet": ["name", "nom complet", "full name", "display name", "contact", "nom contact", "contact nom", "prenom nom", "nom et prenom", "contact name", "dirigeant", "exploitant", "gerant", "responsable", "interlocuteur"],
    "poste": ["poste", "position", "job title", "title", "fonction", "titre", "organization 1 title", "intitule du poste", "role"],
    "societe": ["societe", "company", "entreprise", "organisation", "organization", "organization 1 name", "employeur", "raison sociale", "agence", "etablissement", "nom etablissement", "enseigne", "nom entreprise", "nom de l entreprise", "nom de l agence", "nom du camping", "nom de l etablissement", "nom de la societe", "denomination", "nom commercial"],
    "email": ["email", "e mail", "mail", "courriel", "email address", "e mail address", "e mail 1 value", "adresse email", "email 1", "adresse e mail", "email professionnel", "e mail value"],
    "tel": ["tel", "telephone", "phone", "mobile", "mobile phone", "business phone", "phone 1 value", "portable", "tel 1", "telephone portable", "telephone mobile", "gsm", "phone number", "tel mobile"],
    "linkedin": ["linkedin", "profil linkedin", "lien linkedin", "url linkedin", "linkedin dirigeant", "linkedin contact"],
    "linkedin_entreprise": ["linkedin entreprise", "page linkedin entreprise", "linkedin societe"],
    "site": ["site", "website", "site web", "url site", "web", "site internet", "www"],
    "adresse": ["adresse", "address", "rue", "street", "adresse postale", "adresse 1", "adresse 2"],
    "ville": ["ville", "city", "commune", "localite", "town"],
    "cp": ["cp", "code postal", "zip", "postal code", "zip code", "codepostal"],
    "forme_juridique": ["statut juridique", "forme juridique", "forme jur", "statut", "nature juridique"],
    "note_societe": ["remarques", "remarques specialites", "specialites", "notes", "note", "commentaire", "commentaires", "observations"],
    "url": ["url"],
}
# Words of headers that speak of a company, headers of places, and headers of row numbers.
COMPANY_WORDS = ("entreprise", "societe", "agence", "camping", "etablissement", "structure", "enseigne", "denomination", "commercial", "commerciale")
PLACE_HEADERS = ("departement", "dept", "region", "code postal", "cp", "ville", "commune", "pays")
NUMBER_HEADERS = ("n", "no", "numero", "num", "rang", "id", "index", "")
# Outcomes of an enrichment that are recorded.
OUTCOMES = ("livre", "sans_resultat", "refus_opposition", "refus_quota")


def civility(name: Column) -> Column:
    """struct<civility,rest>: M. or Mme out of a title before a name, blank without one."""
    text = F.coalesce(name, F.lit(""))
    title = r"(?i)^\s*(mme|madame|mlle|mademoiselle|monsieur|mr|m)\.?\s+"
    found = F.lower(F.regexp_extract(text, title, 1))
    form = F.when(found == "", "").when(found.startswith("m") & found.isin("m", "mr", "monsieur"), "M.").otherwise("Mme")
    return F.struct(form.alias("civility"), F.trim(F.regexp_replace(text, title, "")).alias("rest"))


def is_job(note: Column) -> Column:
    return F.exists(F.split(fold(note), " "), lambda w: w.rlike("^(" + "|".join(JOB_STEMS) + ")"))


def people(cell: Column, job: Column) -> Column:
    """array<struct<civility,given,family,job,note>> of a cell that may name several persons.

    Names part at / & + et and, and at a bracket that another name follows.  A bracket is a job or, if no job word is in it,
    a note; the last one holds for all persons unless brackets part them, and loses its plural s for several.
    """
    whole = F.trim(F.coalesce(cell, F.lit("")))
    parted = F.regexp_replace(whole, r"\)\s+(?=[A-Za-zÀ-ÿ])", ") / ")
    last = F.when(parted == whole, F.trim(F.regexp_extract(whole, r"\(([^)]+)\)\s*$", 1))).otherwise("")
    body = F.when(last == "", parted).otherwise(F.regexp_replace(parted, r"\([^)]+\)\s*$", ""))
    parts = F.filter(F.transform(F.split(body, r"(?i)\s*(?:/|&|\+|\bet\b|\band\b)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    shared = F.coalesce(first_filled(job), F.when(is_job(last), last), F.lit(""))
    note = F.when((last != "") & ~is_job(last), last).otherwise("")

    def person(part: Column) -> Column:
        own = F.trim(F.regexp_extract(part, r"\(([^)]+)\)\s*$", 1))
        name = civility(F.trim(F.regexp_replace(part, r"\([^)]+\)\s*$", "")))
        words = F.split(name.rest, r"\s+")
        many = F.size(words) > 1
        plain = F.when(F.size(parts) > 1, F.trim(F.regexp_replace(shared, "(?i)s$", ""))).otherwise(shared)
        return F.struct(
            name.civility.alias("civility"), F.when(many, F.element_at(words, 1)).otherwise("").alias("given"),
            F.when(many, F.array_join(F.slice(words, 2, 100), " ")).otherwise(name.rest).alias("family"),
            F.when(own == "", plain).when(is_job(own), own).otherwise(shared).alias("job"), F.when((own != "") & ~is_job(own), own).otherwise(note).alias("note"),
        )

    return F.filter(F.transform(parts, person), lambda p: (p.given != "") | (p.family != ""))


def plain_header(h: str | None) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFD", h or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", bare.lower()).strip()


def header_field(header: str | None, words: dict[str, list[str]] = HEADERS) -> str | None:
    """The field that a header names, looked at alone.

    Flags and technical columns have none.  Network pages, then mail, telephone and job words, then names of companies count
    before the listed words; of these an equal one, else the first field with a word that the header holds (never nom or url).
    """
    h = plain_header(header)
    company = any(w in h for w in COMPANY_WORDS)
    if not h or re.search(r"\bis company\b|\bid (name|id)\b|\b(industry|campaign)\b", h):
        return None
    if "linkedin" in h:
        return "linkedin_entreprise" if company else "linkedin"
    for field, pattern in (("email", r"courriel|\be ?mail\b"), ("tel", r"\b(telephone|portable|mobile|gsm|phone|tel)\b"), ("poste", r"\b(poste|fonction)\b")):
        if re.search(pattern, h):
            return field
    if (company or "company" in h or "partner" in h) and re.search(r"\bnom\b|name|denomination|raison", h):
        return "societe"
    exact = {w: field for field, listed in words.items() for w in listed}
    return exact.get(h) or next((f for f, listed in words.items() if f not in ("nom", "url") and any(w in h for w in listed)), None)


def source_of(headers: list[str]) -> str:
    """What a file comes from, by its headers: linkedin, gmail, outlook, prospection or carnet."""
    h = set(map(plain_header, headers))
    person = {"first name", "last name"} <= h
    if person and h & {"connected on", "url"}:
        return "linkedin"
    if {"given name", "family name"} <= h or any(re.search(r"e mail \d value|organization \d (name|title)", x) for x in h):
        return "gmail"
    if person and h & {"e mail address", "job title", "business phone"}:
        return "outlook"
    return "prospection" if h & {"adresse", "ville", "cp"} and not h & {"first name", "prenom"} else "carnet"


def header_fields(headers: list[str], rows: list[list[str]] | None = None, words: dict[str, list[str]] = HEADERS) -> list[str | None]:
    """The field of each header of a file; rows, its first ones, tell columns of row numbers.

    Places are never names.  A plain name column is nothing beside one of contact or partner names.  In a list of companies
    (places, but no company and no given name) a name is the company's.
    """
    plain = [plain_header(h) for h in headers]
    out = [header_field(h, words) for h in headers]

    def numbered(i: int) -> bool:
        values = [r[i].strip() for r in rows or [] if i < len(r) and r[i] and r[i].strip()]
        return len(values) >= 2 and all(v.isdecimal() for v in values) and all(int(a) < int(b) for a, b in zip(values, values[1:]))

    for i, h in enumerate(plain):
        if (h in NUMBER_HEADERS and numbered(i)) or (h in PLACE_HEADERS and out[i] in ("nom", "nom_complet", "societe")):
            out[i] = None
    if any("contact name" in h or "partner name" in h for h in plain):
        out = [None if f == "nom_complet" and h == "name" else f for f, h in zip(out, plain)]
    if source_of(headers) == "prospection" and "societe" not in out and "prenom" not in out:
        out = ["societe" if f in ("nom", "nom_complet") else f for f in out]
    return out


def with_header_fields(df: DataFrame, header: str) -> DataFrame:
    """df with `field`, that of its header: distinct headers are looked at once."""

    def run(parts):
        for pdf in parts:
            yield pdf.assign(field=[header_field(h) for h in pdf[header]])

    known = df.select(header).distinct().mapInPandas(run, f"`{header}` string, field string")
    return df.join(known, header, "left")


def without_title(rows: list[list[str]]) -> list[list[str]]:
    """The first rows of a sheet without a title above the headers: it fills one cell or half as many as the next row."""
    filled = lambda row: [c.strip() for c in row if c and c.strip()]
    if len(rows) < 3:
        return rows
    first, second = filled(rows[0]), filled(rows[1])
    labels = len(second) >= 2 and not any(re.fullmatch(r"[\d\s.,€%/-]+", c) or len(c) > 40 for c in second)
    return rows[1:] if labels and (len(first) == 1 or 2 * len(first) <= len(second)) else rows


def repaired(df: DataFrame) -> DataFrame:
    """adresse, cp, ville, linkedin, linkedin_entreprise and site put right: parts out of blocks, pages by what they are."""
    f = {c: F.coalesce(F.trim(c), F.lit("")) for c in ("adresse", "cp", "ville", "linkedin", "linkedin_entreprise", "site")}
    both = r"^([0-9]{5})\s+(.+)$"
    glued = (f["ville"] == "") & f["cp"].rlike(both)
    block = r"^(.*?)[\s,;]*\b([0-9]{5})\b[\s,;]*(.*)$"
    inside = (f["cp"] == "") & f["adresse"].rlike(block)
    part = lambda i: F.trim(F.regexp_extract(f["adresse"], block, i))
    company, person = r"(?i)/(company|school)/", r"(?i)/in/"
    down = f["linkedin"].rlike(company) & (f["linkedin_entreprise"] == "")
    own = F.when(down, "").otherwise(f["linkedin"])
    page = F.when(down, f["linkedin"]).otherwise(f["linkedin_entreprise"])
    up = page.rlike(person) & (own == "")
    bare = f["site"].rlike(r"^\S+\.\S+$") & ~f["site"].rlike("(?i)^https?://")
    return df.withColumns({
        "adresse": F.when(inside, part(1)).otherwise(f["adresse"]),
        "cp": F.when(glued, F.regexp_extract(f["cp"], both, 1)).when(inside, part(2)).otherwise(f["cp"]),
        "ville": F.when(glued, F.trim(F.regexp_extract(f["cp"], both, 2))).when(inside & (f["ville"] == ""), part(3)).otherwise(f["ville"]),
        "linkedin": F.when(up, page).otherwise(own), "linkedin_entreprise": F.when(up, "").otherwise(page),
        "site": F.when(bare, F.concat(F.lit("https://"), f["site"])).otherwise(f["site"]),
    })


def name_agreement(name: Column, brand: Column, trade: Column, legal: Column, least: int = 4) -> Column:
    """concordant: equal keys, or one of `least` letters within the other; else discordant if there is a name for the public."""
    site = company_key(name)
    legal = F.coalesce(legal, F.lit(""))
    public = F.filter(F.concat(F.array(company_key(brand), company_key(trade)), F.transform(F.regexp_extract_all(legal, F.lit(r"\(([^)]*)\)"), F.lit(1)), company_key)), lambda k: k != "")
    every = F.concat(public, F.filter(F.array(company_key(F.regexp_replace(legal, r"\([^)]*\)", " "))), lambda k: k != ""))
    within = lambda a, b: (F.length(b) >= least) & a.contains(b)
    agree = (site != "") & F.exists(every, lambda k: (k == site) | within(site, k) | within(k, site))
    return F.when(agree, "concordant").when(F.size(public) > 0, "discordant").otherwise("absent")


def address_probe(companies: DataFrame, points: DataFrame, company: str, point: str, answer: str) -> DataFrame:
    """(company, level, point) by name, city and postcode: L3 if street and number agree too, else L2.

    Both sides have name, city, postcode, street and number.  L3 points of several answers mean none at all.  Points are
    summed up per key before the joins, so a key that many rows share makes no pairs.  Blank keys join nothing.
    """
    keys = lambda df: df.withColumns({"_name": company_key(F.col("name")), "_city": fold(F.col("city")), "_cp": F.trim("postcode"), "_street": street_key(F.lit(""), F.col("street")), "_number": F.regexp_extract(F.coalesce("number", F.lit("")), "([0-9]+)", 1)})
    place = ["_name", "_city", "_cp"]
    right = keys(points).where("_name != '' and _city != '' and _cp != ''")
    exact = right.where("_street != '' and _number != ''").groupBy(*place, "_street", "_number").agg(F.count_distinct(answer).alias("_answers"), F.min(point).alias("_exact"))
    near = right.groupBy(*place).agg(F.min(point).alias("_near"))
    out = keys(companies).join(exact, [*place, "_street", "_number"], "left").join(near, place, "left")
    hit = F.col("_exact").isNotNull()
    level = F.when(hit & (F.col("_answers") == 1), "L3").when(~hit & F.col("_near").isNotNull(), "L2")
    return out.withColumn("level", level).where("level is not null").select(company, "level", F.when(F.col("level") == "L3", F.col("_exact")).otherwise(F.col("_near")).alias(point))


def match_companies(companies: DataFrame, points: DataFrame, company: str, point: str, answer: str, certain: list[str], weak: list[str]) -> DataFrame:
    """Every company with how it was matched: an exact address decides, an L2 address is one more signal of the vote."""
    probed = address_probe(companies, points, company, point, answer)
    exact = probed.where("level = 'L3'").select(company, F.col(point).alias("_exact"))
    seed = probed.where("level = 'L2'").select(company, F.col(point).alias("seed"))
    left = companies.join(exact, company, "left").join(seed, company, "left")
    votes = signal_votes(left.where("_exact is null"), points.withColumn("seed", F.col(point)), company, point, certain, ["seed", *weak])
    out = left.join(votes.select(company, F.col(point).alias("_voted"), F.col("level").alias("_level")), company, "left")
    outcome = F.when(F.col("_exact").isNotNull(), "certain address").otherwise(F.coalesce("_level", F.lit("rejected")))
    return out.select(company, F.coalesce("_exact", "_voted").alias(point), outcome.alias("outcome"), F.col("seed").isNotNull().alias("seeded"))


def match_counters(matched: DataFrame, *keys: str) -> DataFrame:
    """How many companies were treated, and how many had each outcome."""
    of = lambda name, label: F.count_if(F.col("outcome") == name).alias(label)
    return matched.groupBy(*keys).agg(F.count("*").alias("treated"), of("certain address", "certain_address"), of("certain", "certain"), of("presumed", "presumed"), of("rejected", "rejected"), F.count_if("seeded").alias("presumed_address"))


def companies_of_points(points: DataFrame, companies: DataFrame, point: str, company: str) -> DataFrame:
    """Each point's company: that of its siren, else of its name and city; the smallest id of several; others are left out."""
    name, city = company_key(F.col("name")), fold(F.col("city"))
    by_siren = companies.where(~blank("siren")).groupBy(F.trim("siren").alias("_siren")).agg(F.min(company).alias("_a"))
    by_name = companies.select(name.alias("_name"), city.alias("_city"), company).where("_name != '' and _city != ''").groupBy("_name", "_city").agg(F.min(company).alias("_b"))
    out = points.join(by_siren, F.trim("siren") == F.col("_siren"), "left").join(by_name, (name == F.col("_name")) & (city == F.col("_city")), "left")
    return out.where("_a is not null or _b is not null").select(point, F.coalesce("_a", "_b").alias(company), F.when(F.col("_a").isNotNull(), "siren").otherwise("name and city").alias("by"))


def prospects(asked: DataFrame, companies: DataFrame, cards: DataFrame, blocked: DataFrame) -> DataFrame:
    """What each request (request_id, user_id, siren, siret, state, people) makes: refusal, or a company, contacts, a card.

    companies and cards hold (user_id, siren) of what is there, blocked holds siret_hash.  Of several requests for one
    company the first makes what is missing; contacts come with new companies only.  The three frames to write are
    selections of the result: new_company, n_contacts > 0 with people, new_card.
    """
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "")
    rows = asked.withColumns({"siren": plain("siren"), "siret": plain("siret")})
    rows = rows.join(blocked.select(F.col("siret_hash").alias("_b")).distinct(), F.sha2("siret", 256) == F.col("_b"), "left")
    refusal = F.when(F.col("siren") == "", "no siren").when(F.col("_b").isNotNull() & (F.col("siret") != ""), "opted out").when(~blank("state") & (F.trim("state") != "A"), "closed")
    rows = rows.withColumn("refusal", refusal).drop("_b")
    there = lambda df, flag: df.select("user_id", F.trim("siren").alias("siren")).distinct().withColumn(flag, F.lit(True))
    rows = rows.join(there(companies, "_company"), ["user_id", "siren"], "left").join(there(cards, "_card"), ["user_id", "siren"], "left")
    # the first request that isn't refused, found by an aggregate: a company asked for by many makes no large window
    first = rows.where("refusal is null").groupBy("user_id", "siren").agg(F.min("request_id").alias("_first"))
    rows = rows.join(first, ["user_id", "siren"], "left")
    makes = F.col("refusal").isNull() & (F.col("request_id") == F.col("_first"))
    rows = rows.withColumns({"new_company": F.coalesce(makes & F.col("_company").isNull(), F.lit(False)), "new_card": F.coalesce(makes & F.col("_card").isNull(), F.lit(False))})
    return rows.withColumn("n_contacts", F.when(F.col("new_company"), F.coalesce(F.size("people"), F.lit(0))).otherwise(0)).drop("_company", "_card", "_first")


def valid_naf(code: Column) -> Column:
    return F.coalesce(F.trim(code).rlike(r"^([0-9]{4}[A-Z]|[0-9]{2}\.[0-9]{2}[A-Z])$"), F.lit(False))


def search_id(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[^a-z0-9]", ""), 1, 32)


def captured_searches(raw: DataFrame) -> DataFrame:
    """Searches (user_id, naf, search_id, n_results) that are recorded: of a user, with a code in one of its two forms."""
    kept = raw.where(F.col("user_id").isNotNull() & valid_naf(F.col("naf")))
    return kept.withColumns({"naf": F.replace(F.trim("naf"), F.lit("."), F.lit("")), "search_id": search_id(F.col("search_id")), "n_results": F.coalesce("n_results", F.lit(0))})


def captured_attempts(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("user_id").isNotNull() & F.col("outcome").isin(*OUTCOMES))


def spf_targets(record: Column) -> Column:
    """Domains that an SPF record includes or redirects to; null for other records."""
    marks = F.split(F.lower(F.trim(record)), r"\s+")
    found = F.filter(F.transform(marks, lambda m: F.regexp_replace(F.regexp_extract(m, r"^(?:\+?include:|redirect=)(.+)$", 1), r"\.$", "")), lambda m: m != "")
    return F.when(F.coalesce(F.trim(record), F.lit("")).rlike(r"(?i)^v=spf1(\s|$)"), found)


def is_dkim_key(record: Column, least: int = 32) -> Column:
    """A record with a public key of some length; an empty key is a revoked one."""
    return F.length(F.regexp_extract(F.coalesce(record, F.lit("")), r"(?:^|;)\s*p\s*=\s*([A-Za-z0-9+/=]*)", 1)) >= least


def dmarc_policy(record: Column) -> Column:
    """none, quarantine or reject; blank for a record without one, null for other records."""
    text = F.coalesce(F.trim(record), F.lit(""))
    return F.when(text.rlike("(?i)^v=DMARC1"), F.lower(F.regexp_extract(text, r"(?i)(?:^|;)\s*p\s*=\s*(none|quarantine|reject)", 1)))


def mail_setup(records: DataFrame, provider: str) -> DataFrame:
    """Per domain, of TXT records (domain, name, txt) already looked up: SPF, whether it covers the provider, DKIM, DMARC."""
    targets = spf_targets(F.col("txt"))
    at = lambda pattern: F.col("name").rlike(pattern)
    root = F.col("name") == F.col("domain")
    return records.groupBy("domain").agg(
        F.count_if(root & targets.isNotNull()).alias("n_spf"), F.coalesce(F.bool_or(root & F.array_contains(targets, provider)), F.lit(False)).alias("covered"),
        F.coalesce(F.bool_or(at(r"\._domainkey\.") & is_dkim_key(F.col("txt"))), F.lit(False)).alias("dkim"), F.max(F.when(at(r"^_dmarc\."), dmarc_policy(F.col("txt")))).alias("dmarc"),
    )
