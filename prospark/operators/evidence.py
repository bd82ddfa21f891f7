"""What the pages of a site say about the company that the site is taken for, and which pages to read for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold, parse_address, sirens_in, sirets_in, street_key

# What leads to legal pages, and where they often are.
LEGAL_WORDS = ("mentions legales", "mentions-legales", "mentions", "legal", "cgv", "cgu", "contact", "qui sommes nous", "informations legales")
LEGAL_PATHS = ("/mentions-legales", "/mentions", "/legal", "/cgv", "/contact")


def site_evidence(records: DataFrame, pages: DataFrame, text: str = "text") -> DataFrame:
    """record_id, verdict and signals of records (record_id, host, siren, raison_sociale, dirigeant_nom, ville, code_postal,
    numero_voie, type_voie, libelle_voie, adresse, attested) from the texts of pages (host, text).

    certain where the company's number is on a page; else presumed by two signals, or one if the site is attested: its name,
    its address (city and postcode, or its street, with its number or of two words or more), its manager.  Each page is read
    for its own site's records only, and leaves a row of flags; a site's pages are never gathered.
    """
    street, parsed = street_key(F.col("type_voie"), F.col("libelle_voie")), parse_address(F.col("adresse"))
    known = records.select(
        "record_id", "host", F.coalesce("siren", F.lit("")).alias("_siren"), fold(F.col("raison_sociale")).alias("_name"), fold(F.col("dirigeant_nom")).alias("_manager"), fold(F.col("ville")).alias("_city"),
        F.regexp_replace(F.coalesce("code_postal", F.lit("")), "[^0-9]", "").alias("_cp"), F.when(street != "", street).otherwise(parsed.street).alias("_street"),
        F.when(street != "", F.regexp_extract(F.coalesce("numero_voie", F.lit("")), "([0-9]+)", 1)).otherwise(parsed.number).alias("_number"),
    )
    body = F.coalesce(F.col(text), F.lit(""))
    read = pages.select("host", body.alias("_raw"), fold(body).alias("_plain"), F.concat(F.lit(" "), street_key(F.lit(""), body), F.lit(" ")).alias("_streets"), F.array_distinct(F.concat(sirens_in(body), F.transform(sirets_in(body), lambda x: F.substring(x, 1, 9)))).alias("_sirens"))
    both = known.join(read, "host")
    holds = lambda needle, least: (F.length(needle) >= least) & F.contains("_plain", needle)
    several = F.size(F.split("_street", " ")) >= 2
    cited = (F.length("_street") >= 4) & (((F.col("_number") != "") & F.contains("_streets", F.concat(F.lit(" "), "_number", F.lit(" "), "_street", F.lit(" ")))) | (several & F.contains("_streets", F.concat(F.lit(" "), "_street", F.lit(" ")))))
    flags = {
        "siret": (F.col("_siren") != "") & F.array_contains("_sirens", F.col("_siren")), "raison_sociale": holds(F.col("_name"), 4), "city": holds(F.col("_city"), 3),
        "cp": (F.length("_cp") == 5) & F.regexp_like("_raw", F.concat(F.lit("\\b"), F.col("_cp"), F.lit("\\b"))), "street": cited, "dirigeant_nom": holds(F.col("_manager"), 3),
    }
    found = both.groupBy("record_id").agg(*(F.bool_or(c).alias(f"_{n}") for n, c in flags.items()))
    told = records.select("record_id", "attested").join(found, "record_id", "left")
    has = {n: F.coalesce(F.col(f"_{n}"), F.lit(False)) for n in flags}
    signals = {"siret": has["siret"], "raison_sociale": has["raison_sociale"], "adresse": (has["city"] & has["cp"]) | has["street"], "dirigeant_nom": has["dirigeant_nom"]}
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in signals.items())))
    enough = F.size(named) >= F.when(F.coalesce("attested", F.lit(False)), 1).otherwise(2)
    return told.select("record_id", F.when(signals["siret"], "certain").when(enough, "presumed").otherwise("none").alias("verdict"), named.alias("signals"))


def absolute(href: Column, base: Column) -> Column:
    """The http(s) address that a link leads to from a page of address `base`, if it stays on its host and port, else null."""
    h = F.trim(href)
    part = lambda u, p, i=1: F.regexp_extract(u, p, i)
    address = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)(\?[^#]*)?"
    origin = F.concat(F.lower(part(base, address, 1)), F.lit("://"), F.lower(part(base, address, 2)))
    path = F.when(part(base, address, 3) == "", "/").otherwise(part(base, address, 3))
    whole = (
        F.when(h.rlike("^(?i)https?://"), h).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(h.startswith("//"), F.concat(F.lower(part(base, address, 1)), F.lit(":"), h)).when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path, h)).when((h == "") | h.startswith("#"), F.concat(origin, path, part(base, address, 4), h)).otherwise(F.concat(origin, F.regexp_extract(path, "^(.*/)", 1), h))
    )
    tail = F.regexp_extract(whole, r"^(?i)https?://[^/?#]*([^?#]*)(.*)$", 2)
    steps = F.regexp_extract(whole, r"^(?i)https?://[^/?#]*([^?#]*)", 1)
    names = F.split(F.regexp_replace(steps, "^/", ""), "/", -1)
    walked = F.aggregate(names, F.array().cast("array<string>"), lambda a, n: F.when(n == ".", a).when(n == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, n)))
    open_end = F.when(F.element_at(names, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    host = F.lower(part(whole, address, 2))
    same = (host != "") & (host == F.lower(part(base, address, 2)))
    return F.when(same, F.concat(F.lower(part(whole, address, 1)), F.lit("://"), host, F.lit("/"), F.array_join(walked, "/"), open_end, tail))


def legal_links(html: Column, base: Column) -> Column:
    """Distinct addresses on the page's host to which links lead whose words or address speak of legal or contact pages."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\b[^>]*href\s*=\s*["'][^"']+["'][^>]*>.*?</a>"""), F.lit(0))

    def link(a: Column) -> Column:
        href = F.regexp_extract(a, r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["']""", 1)
        label = fold(F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a>$", 1), "<[^>]+>", " "))
        plain = fold(F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href))
        hit = F.lit(False)
        for w in LEGAL_WORDS:
            hit = hit | label.contains(w) | plain.contains(w.replace(" ", "")) | plain.contains(w)
        return F.when(hit, absolute(href, base))

    return F.array_distinct(F.array_compact(F.transform(anchors, link)))


def visit_budget(candidates: DataFrame, site: str, url: str, place: str, budget: int = 4) -> DataFrame:
    """The `budget` candidates of each site to visit: the first legal and the first contact page, then the others in order."""
    path = F.regexp_extract(url, r"^(?i)[a-z]+://[^/?#]*([^#]*)", 1)
    nature = F.when(fold(F.coalesce(F.try_url_decode(path), path)).contains("contact"), "contact").otherwise("mentions")
    first = Window.partitionBy(site, "nature").orderBy(place)
    rows = candidates.withColumn("nature", nature).withColumn("_reserved", F.row_number().over(first) == 1)
    rank = Window.partitionBy(site).orderBy(F.desc("_reserved"), place)
    return rows.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= budget).drop("_n", "_reserved")
