"""Company names, streets, domains, phones and mail addresses as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their bare forms.
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
# Legal forms and a city that end a company name without telling companies apart.
NAME_ENDINGS = ("sarl", "sasu", "eurl", "sas", "sci", "sa", "sl", "paris")
# Street words and what they stand for, and words that are left out.
STREET_WORDS = {
    "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "r": "rue", "pl": "place", "imp": "impasse",
    "che": "chemin", "chem": "chemin", "all": "allee", "sq": "square", "rte": "route", "crs": "cours", "pass": "passage",
    "pas": "passage", "fg": "faubourg", "car": "carrefour", "crf": "carrefour", "chs": "chaussee", "cite": "cite",
    "dsc": "descente", "esp": "esplanade", "ham": "hameau", "lot": "lotissement", "mte": "montee", "prom": "promenade",
    "prv": "parvis", "qu": "quai", "quai": "quai", "res": "residence", "rle": "ruelle", "rpt": "rond point", "sen": "sente",
    "tra": "traverse", "vla": "villa", "vlge": "village", "ld": "lieu dit", "lieudit": "lieu dit", "za": "zone artisanale",
    "zi": "zone industrielle", "zac": "zone amenagement concerte", "mal": "marechal", "gal": "general", "cdt": "commandant",
    "cmdt": "commandant", "pdt": "president", "dr": "docteur", "st": "saint", "ste": "sainte",
}
STREET_STOPS = ("de", "des", "du", "la", "le", "les", "l", "d")
# Kinds of streets, which don't tell two streets of one address apart.
STREET_KINDS = (
    "rue r avenue av ave cours cr crs place pl chemin che chem impasse imp boulevard bd bld allee all route rte quai qu "
    "passage pass pas square sq faubourg fg ruelle rle sente sen montee mte promenade prom esplanade esp cite hameau ham "
    "lotissement lot residence res villa vla village vlge traverse tra chaussee chs descente dsc carrefour car crf parvis "
    "prv rond point rpt"
).split()
# Mail domains of private persons, local parts that name a company, and senders to leave out.
PERSONAL_DOMAINS = (
    "gmail.com googlemail.com yahoo.com yahoo.fr yahoo.co.uk hotmail.com hotmail.fr hotmail.co.uk outlook.com outlook.fr "
    "live.com live.fr msn.com icloud.com me.com mac.com free.fr orange.fr wanadoo.fr sfr.fr neuf.fr bbox.fr laposte.net "
    "gmx.com gmx.fr aol.com protonmail.com proton.me numericable.fr club-internet.fr voila.fr yandex.com"
).split()
GENERIC_LOCALS = (
    "contact info infos accueil hello bonjour direction commercial commerciale reservation reservations secretariat "
    "administratif compta comptabilite rh sav support admin bureau office service booking welcome mail devis noreply no-reply"
).split()
HOSTERS = (
    "solocal.com wix.com wixsite.com sitew.com e-monsite.com pagesjaunes.fr godaddy.com ionos.fr ionos.com ovh.com ovh.net "
    "gandi.net squarespace.com shopify.com wordpress.com jimdo.com 1and1.fr sentry.io sentry-next.wixpress.com"
).split()


def fold(x: Column) -> Column:
    """Lower case, no accents, one space between runs of letters and digits."""
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTS, BARE)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def company_key(x: Column) -> Column:
    return F.regexp_replace(fold(x), f"((^| )({'|'.join(NAME_ENDINGS)}))+$", "")


def street_key(kind: Column, label: Column) -> Column:
    words = F.split(fold(F.concat_ws(" ", kind, label)), " ")
    full = F.create_map(*(F.lit(w) for pair in STREET_WORDS.items() for w in pair))
    kept = F.filter(words, lambda w: ~w.isin(*STREET_STOPS) & (w != ""))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def same_number(a: Column, b: Column) -> Column:
    """House numbers agree by their first run of digits; a missing one agrees with nothing."""
    first = lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), "([0-9]+)", 1)
    return (first(a) != "") & (first(a) == first(b))


def parse_address(x: Column) -> Column:
    """struct<number, street> of an address in one line, without its postcode and city and without bis or ter."""
    body = F.trim(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\s+[0-9]{5}\s+.+$", ""))
    number = F.regexp_extract(body, "([0-9]+)", 1)
    after = F.regexp_replace(F.regexp_extract(body, "[0-9]+(.*)$", 1), r"(?i)^\s*(bis|ter|quater|quinquies|[a-z])\b", " ")
    return F.struct(number.alias("number"), street_key(F.lit(""), F.when(number != "", after).otherwise(body)).alias("street"))


def street_words(x: Column) -> Column:
    """The words of a street without its kind at the beginning."""
    words = F.filter(F.split(fold(x), " "), lambda w: w != "")
    return F.when(F.element_at(F.concat(words, F.array(F.lit(""))), 1).isin(*STREET_KINDS), F.slice(words, 2, 1000)).otherwise(words)


def streets_agree(a: Column, b: Column) -> Column:
    """Same words in order without the kind of street; a word may be cut to two letters or more."""
    own = street_words

    def near(x, y):
        return (x == y) | ((F.least(F.length(x), F.length(y)) >= 2) & (x.startswith(y) | y.startswith(x)))

    return (F.size(own(a)) > 0) & (F.size(own(a)) == F.size(own(b))) & F.forall(F.zip_with(own(a), own(b), lambda x, y: F.coalesce(near(x, y), F.lit(False))), lambda ok: ok)


def domain(url: Column) -> Column:
    """Lower-case host without www.; empty for blanks."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(plain, "^(?:[^/@?#]*@)?([^/:?#]*)", 1), r"^www\.", "")


def phone(x: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s.()\-]", "")
    return F.regexp_replace(plain, r"^(\+33|0033)", "0")


def phone_class(x: Column) -> Column:
    p = phone(x)
    return F.when(p == "", None).when(p.rlike("^0[123459][0-9]{8}$"), "fixe").when(p.rlike("^0[67][0-9]{8}$"), "mobile").otherwise("douteux")


def split_phones(cell: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "[/;,\\n\\r]+"), lambda p: F.trim(p)), lambda p: p.rlike("[0-9]"))
    return F.struct(F.filter(parts, lambda p: phone_class(p) != "mobile").alias("company"), F.filter(parts, lambda p: phone_class(p) == "mobile").alias("person"))


def mail_class(x: Column) -> Column:
    e = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    local = F.substring_index(e, "@", 1)
    generic = local.isin(*GENERIC_LOCALS) | F.regexp_extract(local, "^([^._+-]*)", 1).isin(*GENERIC_LOCALS)
    return F.when(~e.contains("@"), None).when(generic, "societe").otherwise("personne")


def split_mails(cell: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"[/;,\s]+"), F.lower), lambda p: p.contains("@"))
    return F.struct(F.filter(parts, lambda p: mail_class(p) == "societe").alias("company"), F.filter(parts, lambda p: mail_class(p) == "personne").alias("person"))


def professional_mail(x: Column) -> Column:
    d = F.lower(F.trim(F.get(F.split(F.coalesce(x, F.lit("")), "@"), F.lit(1))))
    return F.coalesce((d != "") & ~d.isin(*PERSONAL_DOMAINS), F.lit(False))


def mails_in(text: Column) -> Column:
    """Distinct useful mail addresses of a text: no automatic senders, examples, pictures or hosters."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), F.lit(0)), F.lower))
    senders = "^(no-?reply|ne-?pas-?repondre|nepasrepondre|postmaster|webmaster|mailer-daemon|daemon|abuse|hostmaster)$"

    def useful(e):
        host = F.regexp_replace(F.substring_index(e, "@", -1), r"^www\.", "")
        hoster = host.rlike("(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in HOSTERS) + ")$")
        return ~F.substring_index(e, "@", 1).rlike(senders) & ~host.rlike(r"(^|\.)example\.(com|org|net)$") & ~host.rlike(r"\.(png|jpg|jpeg|gif|webp|svg)$") & ~hoster

    return F.filter(found, useful)


def own_domain_first(mails: Column, host: Column) -> Column:
    own = lambda e: F.substring_index(e, "@", -1) == F.regexp_replace(host, r"^www\.", "")
    return F.concat(F.filter(mails, own), F.filter(mails, lambda e: ~own(e)))


def phones_in(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?:\+33|0)\s?[1-9](?:[\s.\- ]?[0-9]{2}){4}\b"), F.lit(0)), lambda m: F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[^0-9+]", ""), r"^\+33", "0"), "[^0-9]", ""))
    return F.array_distinct(F.filter(found, lambda d: (F.length(d) == 10) & ~d.startswith("08")))


def sirets_in(text: Column) -> Column:
    return _grouped(text, r"\b[0-9]{3}[\s. ]?[0-9]{3}[\s. ]?[0-9]{3}[\s. ]?[0-9]{5}\b")


def sirens_in(text: Column) -> Column:
    return _grouped(text, r"\b[0-9]{3}[\s. ]?[0-9]{3}[\s. ]?[0-9]{3}\b")


def _grouped(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, "[^0-9]", "")))


def html_text(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def render(template: Column, values: Column) -> Column:
    """{{ key }} replaced by values[key] of a map, missing keys by nothing; the template is cut at its marks once."""
    parts = F.split(template, r"\{\{\s*", -1)
    key = lambda p: F.trim(F.regexp_extract(p, r"^([^}]*?)\s*\}\}", 1))
    rest = lambda p: F.regexp_replace(p, r"(?s)^[^}]*?\s*\}\}", "")
    return F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) | ~p.contains("}}"), p).otherwise(F.concat(F.coalesce(F.try_element_at(values, key(p)), F.lit("")), rest(p)))), "")
