"""Companies matched with a register of establishments: names that include each other, streets that agree, tiers, refusals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import company_key, domain, parse_address, street_key, street_words, streets_agree
from ..functions.values import blank, first_filled
from .matching import shared_values

#: A name found within another has so many letters at least.
LEAST = 4


def needles(raison: Column, enseigne: Column, commercial: Column) -> Column:
    """struct<against, all>: keys of a company's trade names, which may speak against a match, and with its own name's body.

    Trade names are the sign, the commercial name and what stands in brackets in the company's name.
    """
    raison = F.coalesce(raison, F.lit(""))
    trade = F.concat(F.array(enseigne, commercial), F.regexp_extract_all(raison, F.lit(r"\(([^)]*)\)"), F.lit(1)))
    keys = lambda a: F.array_distinct(F.filter(F.transform(a, company_key), lambda k: k != ""))
    body = F.regexp_replace(raison, r"\([^)]*\)", " ")
    return F.struct(keys(trade).alias("against"), keys(F.concat(trade, F.array(body))).alias("all"))


def _grams(name: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (LEAST - 1)), lambda i: F.substring(name, i, LEAST)))


def included_names(left: DataFrame, right: DataFrame, block: list[str], name: str = "name") -> DataFrame:
    """(block, left_name, right_name, mode): distinct names of a block that are equal, or of which one holds the other.

    The shorter one has LEAST letters at least.  It is found by its rarest run of LEAST letters, among all such runs of the
    longer one: names of a block that share no such run are never compared.  mode is equal, left in right or right in left.
    """
    a, b = (x.select(*block, name).where(F.col(name) != "").distinct() for x in (left, right))
    long = F.length(name) >= LEAST
    runs = {k: x.where(long).select(*block, name, F.explode(_grams(F.col(name))).alias("gram")) for k, x in (("a", a), ("b", b))}
    counts = runs["a"].select("gram").unionByName(runs["b"].select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    same = a.join(b, [*block, name]).select(*block, F.col(name).alias("left_name"), F.col(name).alias("right_name"), F.lit("equal").alias("mode"))
    out = [same]
    for short, other, mode in (("a", "b", "left in right"), ("b", "a", "right in left")):
        rare = runs[short].join(counts, "gram").groupBy(*block, name).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        found = rare.withColumnRenamed(name, "_short").join(runs[other].withColumnRenamed(name, "_long"), [*block, "gram"])
        found = found.where(F.contains("_long", "_short") & (F.col("_long") != F.col("_short")))
        sides = ("_short", "_long") if short == "a" else ("_long", "_short")
        out.append(found.select(*block, F.col(sides[0]).alias("left_name"), F.col(sides[1]).alias("right_name"), F.lit(mode).alias("mode")))
    return reduce(DataFrame.unionByName, out)


def agreeing_streets(left: DataFrame, right: DataFrame, block: list[str], street: str = "street") -> DataFrame:
    """(block, left_street, right_street): distinct streets of a block that agree as `streets_agree` says.

    Agreeing streets have as many words, with the same first two letters each: these are the key, so a street meets those
    that may be its abbreviations, and not all of its postcode.
    """
    key = F.array_join(F.transform(street_words(F.col(street)), lambda w: F.substring(w, 1, 2)), " ")
    a, b = (x.select(*block, street).distinct().withColumn("_key", key).where("_key != ''").withColumnRenamed(street, f"{side}_street") for x, side in ((left, "left"), (right, "right")))
    return a.join(b, [*block, "_key"]).where(streets_agree(F.col("left_street"), F.col("right_street"))).drop("_key")


def match_register(companies: DataFrame, sites: DataFrame) -> DataFrame:
    """Companies without a website against register sites: siret, candidates, outcome, tier, website, site, needle, mode.

    Within a postcode, a site of the same street and number with a confirming name is A, one where the company has no trade
    name to speak against it is A2, one of the same street with a confirming name is B.  outcome is matched, or why not:
    no candidate, postcode only, name against (a site on the street, but a trade name differs), no name (on the street, no
    trade name, another number), ambiguous (the best sites have several websites, none being one), no site, pooled domain
    (that of several establishments).  Only names and streets that agree make pairs; all else is summed up per address.
    """
    digits = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), "([0-9]+)", 1)
    own, parsed = street_key(F.col("type_voie"), F.col("libelle_voie")), parse_address(F.col("adresse"))
    c = companies.where(blank("website")).select(
        "siret", F.coalesce(F.trim("code_postal"), F.lit("")).alias("cp"), F.when(own != "", own).otherwise(parsed.street).alias("street"),
        F.when(own != "", digits(F.col("numero_voie"))).otherwise(parsed.number).alias("number"), needles(F.col("raison_sociale"), F.col("enseigne"), F.col("nom_commercial")).alias("names"),
    )
    site = F.coalesce(F.trim("website"), F.lit(""))
    s = sites.where(~blank("postcode")).select(
        "cle", F.trim("postcode").alias("cp"), street_key(F.lit(""), F.col("street")).alias("street"), digits(F.col("housenumber")).alias("number"), company_key(F.col("nom")).alias("key"),
        site.alias("website"), F.coalesce(first_filled(F.col("domaine"), domain(F.col("website"))), F.lit("")).alias("domain"),
    )
    pooled = shared_values(s, "domain", "cle").select(F.col("domain").alias("_pooled"))
    best = (F.min("website").alias("low"), F.max("website").alias("high"), F.min(F.struct("cle", "domain")).alias("first"))
    placed = s.where("street != ''")
    named = placed.groupBy("cp", "street", "number", "key").agg(*best)
    numbered = placed.where("number != ''").groupBy("cp", "street", "number").agg(*(b.alias(f"at_{n}") for b, n in zip((F.min("website"), F.max("website"), F.min(F.struct("cle", "domain"))), ("low", "high", "first"))))
    per_cp, streets = s.groupBy("cp").agg(F.count("*").alias("candidates")), placed.select("cp", "street").distinct().withColumn("on_street", F.lit(True))

    wanted = c.where("street != ''").select("siret", "cp", "street", F.col("number").alias("own_number"), F.posexplode("names.all").alias("place", "left_name"))
    names = included_names(wanted.withColumnRenamed("left_name", "name"), named.withColumnRenamed("key", "name"), ["cp", "street"])
    agreeing = wanted.join(names, ["cp", "street", "left_name"]).join(named.withColumnRenamed("key", "right_name"), ["cp", "street", "right_name"])
    at_door = (F.col("own_number") != "") & (F.col("own_number") == F.col("number"))
    said = F.struct(F.col("first.cle").alias("cle"), "place", F.col("left_name").alias("needle"), "mode", F.col("first.domain").alias("domain"))
    sums = agreeing.groupBy("siret").agg(*(f for there, x in ((at_door, "a"), (~at_door, "b")) for f in (F.min(F.when(there, F.col("low"))).alias(f"{x}_low"), F.max(F.when(there, F.col("high"))).alias(f"{x}_high"), F.min(F.when(there, said)).alias(f"{x}_said"))))

    all_ = c.join(per_cp, "cp", "left").join(streets, ["cp", "street"], "left").join(numbered, ["cp", "street", "number"], "left").join(sums, "siret", "left")
    open_ = F.size("names.against") == 0
    a, a2, b = F.col("a_said").isNotNull(), open_ & F.col("at_first").isNotNull(), F.col("b_said").isNotNull()
    tier = F.when(a, "A").when(a2, "A2").when(b, "B")
    # where nothing speaks against a name, all sites at the door are equally good
    low, high = (F.when(a2, F.col(f"at_{x}")).when(a, F.col(f"a_{x}")).when(b, F.col(f"b_{x}")) for x in ("low", "high"))
    found = F.when(a, F.struct("a_said.cle", "a_said.needle", "a_said.mode", "a_said.domain")).when(a2, F.struct("at_first.cle", F.lit("").alias("needle"), F.lit("").alias("mode"), "at_first.domain")).when(b, F.struct("b_said.cle", "b_said.needle", "b_said.mode", "b_said.domain"))
    told = all_.select("siret", F.coalesce("candidates", F.lit(0)).alias("candidates"), tier.alias("tier"), low.alias("low"), high.alias("high"), found.alias("found"), F.coalesce("on_street", F.lit(False)).alias("on_street"), open_.alias("open"))
    told = told.join(pooled, F.col("found.domain") == F.col("_pooled"), "left")
    none = F.when(F.col("candidates") == 0, "no candidate").when(~F.col("on_street"), "postcode only").when(~F.col("open"), "name against").otherwise("no name")
    outcome = F.when(F.col("tier").isNull(), none).when(F.col("low") != F.col("high"), "ambiguous").when(F.col("low") == "", "no site").when(F.col("_pooled").isNotNull(), "pooled domain").otherwise("matched")
    ok = F.col("outcome") == "matched"
    told = told.withColumn("outcome", outcome)
    return told.select("siret", "candidates", "outcome", "tier", F.when(ok, F.col("low")).alias("website"), *(F.when(ok, F.col(f"found.{x}")).alias(y) for x, y in (("cle", "site"), ("needle", "needle"), ("mode", "mode"))))


def register_counters(matched: DataFrame) -> DataFrame:
    """One row: companies, candidates, a, a2, b, and a counter for each outcome."""
    outcomes = ("matched", "no candidate", "postcode only", "name against", "no name", "ambiguous", "no site", "pooled domain")
    tiers = (F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("A", "A2", "B"))
    return matched.agg(F.count("*").alias("companies"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"), *tiers, *(F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in outcomes))
