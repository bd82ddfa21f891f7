"""Entity matching on blocking keys: votes of weak signals, tiers of address evidence, and abstention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import company_key, domain, fold, phone, street_key
from ..functions.values import blank


def shared_values(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Values of two or more owners: such a pooled domain or phone identifies nobody."""
    return df.where(~blank(value)).groupBy(value).agg(F.count_distinct(owner).alias("owners")).where("owners >= 2")


def signal_votes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, certain: list[str], weak: list[str], least: int = 2) -> DataFrame:
    """(left_id, right_id, level, n_signals): certain keys decide in order; else `least` weak signals on one candidate.

    The best candidate has the most signals, then the smallest id.  Candidates are summed up to the smallest id for each set
    of signals that may agree, and rows of left with equal keys are one: as the largest set that meets tells the best, each
    such row meets one row a set, however many candidates share it.  Sets double with each weak signal, which are few.
    Blank keys join nothing.
    """
    text = lambda df, i: df.select(F.col(i), *(F.when(blank(F.col(c).cast("string")), "").otherwise(F.col(c).cast("string")).alias(f"_k_{c}") for c in [*certain, *weak]))
    a, b = text(left, left_id), text(right, right_id)
    signals = [f"_k_{c}" for c in weak]

    def sets(df: DataFrame, keep: list[str], least: int) -> DataFrame:
        """Each row once for every set of `least` filled signals or more; signals outside the set are empty."""
        every = [n for n in range(2 ** len(signals)) if n.bit_count() >= least]
        filled = sum((F.when(F.col(c) != "", 1 << i).otherwise(0) for i, c in enumerate(signals)), F.lit(0))
        rows = df.withColumn("_filled", filled).withColumn("_set", F.explode(F.filter(F.array(*map(F.lit, every)), lambda n: n.bitwiseAND(F.col("_filled")) == n)))
        return rows.select(*keep, "_set", *(F.when(F.col("_set").bitwiseAND(1 << i) != 0, F.col(c)).otherwise("").alias(c) for i, c in enumerate(signals)))

    def votes(order: int, sure: list[str], least: int) -> DataFrame:
        """left_id with the best of the candidates that share `sure` and `least` signals or more."""
        keys = [*sure, *signals]
        own = {k: f"_own{k}" for k in keys}
        given = reduce(lambda x, y: x & y, [F.col(k) != "" for k in sure], F.lit(True))
        sums = sets(b.where(given).groupBy(*keys).agg(F.min(right_id).alias(right_id)), [*sure, right_id], least).groupBy(*sure, "_set", *signals).agg(F.min(right_id).alias(right_id))
        rows = a.where(given).select(*keys).distinct()
        if sure:  # most have a number that no candidate has
            rows = rows.join(b.where(given).select(*sure).distinct().hint("merge"), sure, "left_semi")
        rows = sets(rows.select("*", *(F.col(k).alias(o) for k, o in own.items())), [*sure, *own.values()], least)
        # merged, as sets make many rows of what looks small enough to broadcast
        met = rows.join(sums.hint("merge"), [*sure, "_set", *signals])
        vote = F.struct(F.lit(order).alias("order"), (-F.bit_count("_set")).alias("signals"), F.col(right_id).alias("id"))
        best = met.groupBy(*own.values()).agg(F.min(vote).alias("_vote")).withColumnsRenamed({o: k for k, o in own.items()})
        return a.join(best.hint("merge"), keys).select(left_id, "_vote")

    found = [votes(i, [f"_k_{c}"], 0) for i, c in enumerate(certain)]
    found += [votes(len(certain), [], least)] if least <= len(weak) else []
    best = reduce(DataFrame.unionByName, found).groupBy(left_id).agg(F.min("_vote").alias("_vote"))
    return best.select(left_id, F.col("_vote.id").alias(right_id), F.when(F.col("_vote.order") < len(certain), "certain").otherwise("presumed").alias("level"), (-F.col("_vote.signals")).cast("bigint").alias("n_signals"))


def match_points(companies: DataFrame, points: DataFrame) -> DataFrame:
    """companies met with points of interest: siret, osm_id, level, n_signals and the contacts of the point.

    certain by the establishment's number, then the company's; else presumed by two signals or more on one point: domain,
    telephone, mail, the address, and name with town.  The last one only confirms, as one signal alone is none.  The point
    with the most signals counts, then the smallest osm_id.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    number = lambda siret, siren: F.when(bare(siren) != "", bare(siren)).otherwise(F.substring(bare(siret), 1, 9))

    def both(name: Column, town: Column) -> Column:
        return F.when((company_key(name) != "") & (fold(town) != ""), F.concat_ws("|", company_key(name), fold(town)))

    def place(cp: Column, street: Column, house: Column) -> Column:
        digits = F.regexp_extract(F.coalesce(house, F.lit("")), "([0-9]+)", 1)
        return F.when(~blank(cp) & (street != "") & (digits != ""), F.concat_ws("|", F.trim(cp), street, digits))

    c, p = F.col, F.col
    own = companies.select("siret", bare(c("siret")).alias("_siret"), number(c("siret"), c("siren")).alias("_siren"), domain(c("website")).alias("_domain"), phone(c("societe_tel")).alias("_tel"), F.lower(F.trim("societe_email")).alias("_mail"), both(c("raison_sociale"), c("ville")).alias("_name"), place(c("code_postal"), street_key(c("type_voie"), c("libelle_voie")), c("numero_voie")).alias("_place"))
    seen = points.select("osm_id", bare(p("siret")).alias("_siret"), number(p("siret"), p("siren")).alias("_siren"), domain(p("website")).alias("_domain"), phone(p("phone")).alias("_tel"), F.lower(F.trim("email")).alias("_mail"), both(p("nom"), p("city")).alias("_name"), place(p("postcode"), street_key(F.lit(""), p("street")), p("housenumber")).alias("_place"))
    found = signal_votes(own, seen, "siret", "osm_id", ["_siret", "_siren"], ["_domain", "_tel", "_mail", "_name", "_place"])
    contacts = points.select("osm_id", F.trim("website").alias("website"), F.trim("email").alias("societe_email"), F.trim("phone").alias("societe_tel"))
    return found.join(contacts, "osm_id").select("siret", "osm_id", "level", "n_signals", "website", "societe_email", "societe_tel")


def tiered(left: DataFrame, right: DataFrame, tiers: list[tuple[int, list[str]]], left_id: str, right_id: str, answer: str) -> DataFrame:
    """The answer of the first tier whose keys a row shares with candidates; several distinct answers there mean none.

    tiers go from the narrowest keys to the widest.  Candidates are summed up per key before they are joined, so each tier
    costs a row a key, however many candidates share it.  Blank keys join nothing.
    """
    text = lambda c: F.col(c).cast("string")
    out = left
    for level, keys in tiers:
        filled = reduce(lambda x, y: x & y, [~blank(text(c)) for c in keys])
        found = F.struct(F.lit(level).alias("tier"), F.count_distinct(answer).alias("n_answers"), F.min(answer).alias("answer"), F.min(right_id).alias("id")).alias(f"_t{level}")
        sums = right.where(filled).groupBy(*(text(c).alias(f"_k_{c}") for c in keys)).agg(found)
        out = out.join(sums, reduce(lambda x, y: x & y, [text(c) == F.col(f"_k_{c}") for c in keys]), "left").drop(*(f"_k_{c}" for c in keys))
    best = out.withColumn("_b", F.coalesce(*(f"_t{level}" for level, _ in tiers))).where("_b is not null")
    one = F.col("_b.n_answers") == 1
    return best.select(left_id, "_b.tier", "_b.n_answers", F.when(one, F.col("_b.answer")).alias("answer"), F.when(one, F.col("_b.id")).alias(right_id))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 0.5) -> DataFrame:
    """Points (lat, lng) in boxes (lat_min, lat_max, lng_min, lng_max): an equi-join on grid cells, then the exact test."""
    at = lambda c: F.floor(F.col(c) / cell)
    grid = boxes.withColumn("_y", F.explode(F.sequence(at("lat_min"), at("lat_max")))).withColumn("_x", F.explode(F.sequence(at("lng_min"), at("lng_max"))))
    placed = points.withColumn("_y", at("lat")).withColumn("_x", at("lng"))
    return placed.join(grid, ["_y", "_x"]).where(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lng").between(F.col("lng_min"), F.col("lng_max"))).drop("_y", "_x")


def verdict(siret_agrees: Column, evidence: list[Column], attested: Column) -> Column:
    """certain by identifier; else presumed by two pieces of evidence, or one if the page attests itself; else none."""
    n = reduce(lambda a, b: a + b, [F.when(e, 1).otherwise(0) for e in evidence])
    return F.when(siret_agrees, "certain").when(n >= F.when(attested, 1).otherwise(2), "presumed").otherwise("none")
