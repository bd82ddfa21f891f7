"""Names that include each other, streets that agree, the register's tiers, sector search and evidence on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from prospark import registry
from prospark.functions.names import streets_agree
from prospark.operators import evidence, purge, register, rows, sector


def test_included_names(spark):
    r = random.Random(9)
    words = ["lac", "bleu", "camping", "du", "port", "le", "mer"]
    names = ["".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(120)] + ["a", "ab", "abc", "abcd"]
    left, right = [(k % 3, n) for k, n in enumerate(names)], [(k % 3, n) for k, n in enumerate(reversed(names))]
    got = register.included_names(*(spark.createDataFrame(x, "block int, name string") for x in (left, right)), ["block"]).collect()
    mode = lambda a, b: "equal" if a == b else "left in right" if len(a) >= 4 and a in b else "right in left" if len(b) >= 4 and b in a else None
    want = {(i, a, b, mode(a, b)) for i, a in left for j, b in right if i == j and mode(a, b)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_streets_join_equals_all_pairs(spark):
    r = random.Random(10)
    kinds, words = ["rue", "av", "", "bd", "quai"], ["docteur", "doct", "noel", "n", "no", "victor", "vic", "hugo", "r", "été", "ete"]
    streets = sorted({" ".join([r.choice(kinds), *(r.choice(words) for _ in range(r.randint(0, 3)))]).strip() for _ in range(160)})
    a, b = (spark.createDataFrame([(k % 2, s) for k, s in enumerate(x)], "block int, street string") for x in (streets, streets[::-1]))
    got = {tuple(x) for x in register.agreeing_streets(a, b, ["block"]).collect()}
    both = a.select("block", F.col("street").alias("l")).join(b.select("block", F.col("street").alias("r")), "block")
    assert got == {tuple(x) for x in both.where(streets_agree(F.col("l"), F.col("r"))).collect()} and len(got) > 100


SITE = "cle string, nom string, website string, domaine string, housenumber string, street string, postcode string"
COMPANY = "siret string, raison_sociale string, enseigne string, nom_commercial string, code_postal string, numero_voie string, type_voie string, libelle_voie string, adresse string, website string"


def test_tiers_and_refusals(spark):
    sites = [
        ("1", "Camping du Lac", "lac.fr", None, "12", "Rue des Lilas", "29000"), ("2", "Camping du Port", "port.fr", None, "3 bis", "Quai du Port", "29000"), ("3", "Le Phare", "", None, "5", "Rue du Phare", "29000"),
        ("4", "Hotel A", "chain.fr/a", "chain.fr", "1", "Rue Haute", "29000"), ("5", "Hotel B", "chain.fr/b", "chain.fr", "2", "Rue Basse", "29000"), ("6", "Dune", "dune1.fr", None, "9", "Rue Dune", "29100"), ("7", "Dune", "dune2.fr", None, "9", "Rue Dune", "29100"),
    ]
    companies = [
        ("A", "SCI X", "CAMPING DU LAC SARL", None, "29000", "12", "R.", "DES LILAS", None, None), ("A2", "SCI Quatre Vents", None, None, "29000", "", "", "", "3 QUAI DU PORT 29000 BREST", ""), ("B", "X (Camping du Lac)", None, None, "29000", "99", "RUE", "DES LILAS", None, " "),
        ("site", "Y", "Le Phare", None, "29000", "5", "RUE", "DU PHARE", None, None), ("pooled", "Z", "Hotel A", None, "29000", "1", "RUE", "HAUTE", None, None), ("two", "W", "Dune", None, "29100", "9", "RUE", "DUNE", None, None),
        ("against", "V", "Autre nom", None, "29000", "12", "RUE", "DES LILAS", None, None), ("noname", "SCI U", None, None, "29000", "77", "RUE", "DES LILAS", None, None), ("cp", "T", None, None, "29000", "1", "RUE", "DU LOIN", None, None), ("none", "S", None, None, "75001", "1", "RUE", "X", None, None), ("done", "R", None, None, "29000", "1", "RUE", "X", None, "r.fr"),
    ]
    got = register.match_register(spark.createDataFrame(companies, COMPANY), spark.createDataFrame(sites, SITE))
    told = {r.siret: (r.tier, r.outcome, r.website) for r in got.collect()}
    assert told == {
        "A": ("A", "matched", "lac.fr"), "A2": ("A2", "matched", "port.fr"), "B": ("B", "matched", "lac.fr"), "site": ("A", "no site", None), "pooled": ("A", "pooled domain", None), "two": ("A", "ambiguous", None),
        "against": (None, "name against", None), "noname": (None, "no name", None), "cp": (None, "postcode only", None), "none": (None, "no candidate", None),
    }
    c = register.register_counters(got).first()
    assert (c.companies, c.a, c.a2, c.b, c.matched, c.ambiguous, c.pooled_domain) == (10, 4, 1, 1, 3, 1, 1)


def test_sector_ladder(spark):
    catalogue = spark.createDataFrame([(0, "56.10A", "Restauration traditionnelle"), (1, "43.31Z", "Travaux de plâtrerie"), (2, "96.02A", "Coiffure"), (3, "56.10B", "Cafétérias et autres libres-services"), (4, "47.11A", "Commerce de détail")], "place long, code string, label string")
    synonyms = spark.createDataFrame([("resto", "56.10A"), ("salon de coiffure", "96.02A")], "synonym string, code string")
    asked = ["5610a", "56", "resto", "salon de", "plâtrier", "coiffeurs", "commerces de", "libres services et", "detail xyz", "x", "des", "rest"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = sector.search(queries, catalogue, synonyms)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.position)):
        got.setdefault(asked[r.query_id], []).append((r.code, r.score))
    assert got["5610a"] == [("56.10A", 100)] and got["56"] == [("56.10A", 95), ("56.10B", 95)] and got["resto"][0] == ("56.10A", 90)
    assert got["salon de"][0] == ("96.02A", 75) and got["plâtrier"] == [("43.31Z", 80)] and got["coiffeurs"] == [("96.02A", 80)]
    assert ("47.11A", 80) in got["commerces de"] and ("56.10B", 80) in got["libres services et"] and got["detail xyz"] == [("47.11A", 50)] and "x" not in got
    left = sector.fallback(spark.createDataFrame([(50, "averi"), (51, "latre")], "query_id long, query string"), catalogue, found).collect()
    assert [(r.query_id, r.code, r.score) for r in left] == [(51, "43.31Z", 50)]


def _sector_best(queries, catalogue, synonyms, best):
    """The rules one by one, over all pairs."""
    fold = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    forms = lambda w: [w, w[:-1]] if len(w) > 4 and w[-1] == "s" else [w, w + "s"] if len(w) > 3 and w[-1] != "s" else [w]
    meets = lambda w, v: any(len(b) >= 2 and b.startswith(a) for a in forms(w) for b in forms(v)) or (len(w) >= 5 and len(v) >= 5 and w[:5] == v[:5])
    of_code: dict = {}
    for _, code, label in catalogue:
        of_code.setdefault(code, set()).update(fold(label).split())
    out = set()
    for i, query in queries:
        q, found = fold(query), []
        words = {w for w in q.split() if len(w) >= 2}
        for place, code, label in catalogue if len(query.strip()) >= 2 and q else []:
            met = {w for w in words if any(meets(w, v) for v in of_code[code])}
            long = sum(len(w) >= 3 for w in met)
            known = [fold(s) for s, c in synonyms if c == code]
            low = code.lower()
            rules = [(low == q or low.replace(".", "") == q.replace(" ", ""), 100), (low.startswith(q), 95), (q in known, 90), (len(q) >= 3 and any(q in k for k in known), 75), (words and met == words, 80), (len(q) >= 3 and q in fold(label), 70), (long > 0, 40 + 10 * long)]
            found += [(-score, place, code) for fires, score in rules if fires][:1]
        out |= {(i, code, -score, k + 1) for k, (score, _, code) in enumerate(sorted(found)[:best])}
    return out


def test_sector_search_with_copies(spark):
    """Few words, labels and codes shared by many items, queries by many askers; synonyms hide the first items of their class."""
    r = random.Random(12)
    words = ["tole", "toles", "acier", "acieries", "bois", "bar", "bars", "ba", "10", "fer a", "o"]
    some = lambda least, most: " ".join(r.choice(words) for _ in range(r.randint(least, most)))
    labels = [some(1, 3) for _ in range(20)]
    catalogue = [(p, f"{p % 70 % 12:02d}.{p % 70}", r.choice(labels)) for p in range(240)]
    synonyms = [(some(1, 2), catalogue[r.randrange(60)][1]) for _ in range(25)]
    asked = [some(1, 3) for _ in range(25)] + ["10", "10.10", "1010", "ois", "ole a", "bar bo", "x", "--"]
    queries = list(enumerate(asked + asked[:12]))
    frames = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(catalogue, "place long, code string, label string"), spark.createDataFrame(synonyms, "synonym string, code string")
    for best in (3, 12):
        got = [tuple(x) for x in sector.search(*frames, best).collect()]
        assert set(got) == _sector_best(queries, catalogue, synonyms, best) and len(got) == len(set(got)) > 90


def test_a_label_counts_for_its_own_item(spark):
    """Two items of one code: only that whose label holds the letters is found by them, both by their words."""
    catalogue = spark.createDataFrame([(0, "01.1", "acier"), (1, "01.1", "bois"), (2, "02.2", "bois")], "place long, code string, label string")
    found = sector.search(spark.createDataFrame([(0, "ois"), (1, "bois")], "query_id long, query string"), catalogue, spark.createDataFrame([], "synonym string, code string"))
    assert sorted(map(tuple, found.collect())) == [(0, "01.1", 70, 1), (0, "02.2", 70, 2), (1, "01.1", 80, 1), (1, "01.1", 80, 2), (1, "02.2", 80, 3)]


def test_sector_search_broadcasts_nothing_told_apart(spark, sf_dir):
    """The rows of an explode are underestimated: those of runs of letters went through the driver as a small table."""
    plan = registry.QUERIES["sector_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(plan):
        if "BroadcastExchange" in x:
            below = next((k for k in range(i + 1, len(plan)) if depth(plan[k]) <= depth(x)), len(plan))
            assert not any("Generate" in y for y in plan[i:below])


def test_links_of_a_host(spark):
    base = "https://Firm.fr/a/b/page?x=1#y"
    cases = {"/legal": "https://firm.fr/legal", "c": "https://firm.fr/a/b/c", "../c/./d?q#f": "https://firm.fr/a/c/d?q#f", "../../../c": "https://firm.fr/c", "?z": "https://firm.fr/a/b/page?z", "#top": "https://firm.fr/a/b/page?x=1#top", "//firm.fr/x": "https://firm.fr/x", "//other.fr/x": None, "http://FIRM.fr": "http://firm.fr/", "https://firm.fr:8080/": None, "mailto:a@firm.fr": None, "javascript:x()": None, "./": "https://firm.fr/a/b/"}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r.h: r.u for r in df.select("h", evidence.absolute(F.col("h"), F.lit(base)).alias("u")).collect()} == cases


def test_first_filled_of_many_rows(spark):
    df = spark.createDataFrame([(1, 3, "c", None), (1, 1, " ", "x"), (1, 2, "b", ""), (2, 1, None, None)], "k int, place int, a string, b string")
    assert {(r.k, r.a, r.b, r.rows) for r in rows.first_filled_by(df, ["k"], ["place"], ["a", "b"]).collect()} == {(1, "b", "x", 3), (2, None, None, 1)}


def test_purge(spark):
    table = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    tables = {
        "account": table("id int", (1,), (2,)), "quote": table("id int, owner int, paid boolean", (10, 1, True), (11, 1, False), (12, 2, False), (13, 1, None)), "signature": table("quote int", (10,), (11,), (12,), (13,)),
        "log": table("owner int, text string", (1, "a"), (2, "b"), (None, "c")), "invoice": table("owner int", (1,), (2,)),
    }
    rules = [purge.Rule("quote", "owner", "account", unless="paid"), purge.Rule("signature", "quote", "quote"), purge.Rule("log", "owner", "account", "anonymise"), purge.Rule("invoice", "owner", "account", "keep")]
    left, counts = purge.purge(tables, rules, "account", table("id int", (1,), (1,), (7,)), {"account": "id", "quote": "id"})
    assert {r.id for r in left["quote"].collect()} == {10, 12} and {r["quote"] for r in left["signature"].collect()} == {10, 12}
    assert sorted((r.owner or 0, r.text) for r in left["log"].collect()) == [(0, "a"), (0, "c"), (2, "b")] and left["invoice"].count() == 2
    assert {tuple(r) for r in counts.collect()} == {("account", "delete", 1), ("quote", "delete", 2), ("quote", "keep", 1), ("signature", "delete", 2), ("log", "anonymise", 1), ("invoice", "keep", 1)}
