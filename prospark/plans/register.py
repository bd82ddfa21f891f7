"""Register matching over names and streets put together from parts, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import register
from ..registry import query
from ..session import load

# Sites: every part, at one of 40 postcodes, with its name and kind as its name; some websites are blank or shared.
_SITES = """s as (select p_partkey as cle, case p_partkey % 5 when 0 then 'Camping ' || p_name when 1 then p_name || ' SARL' when 2 then upper(p_name) when 3 then 'Les ' || p_name || ' de ' || p_type else substr(p_name, 1, 3) end as nom,
 (10000 + p_size % 40)::varchar as postcode, case p_partkey % 4 when 0 then 'Av. de la ' else 'rue ' end || p_type as street, case when p_partkey % 7 > 0 then (p_partkey % 6) || case when p_partkey % 2 = 0 then ' bis' else '' end end as housenumber,
 case when p_partkey % 9 = 0 then ' ' when p_partkey % 11 = 0 then 'https://www.chain.fr/' || p_partkey else 'site' || p_partkey % 37 || '-' || p_size || '.fr' end as website from part)"""
_COMPANIES = """c as (select c_custkey as siret, case when c_custkey % 3 = 0 then p_name when c_custkey % 13 = 0 then 'SARL' end as enseigne, case when c_custkey % 8 = 1 then p_name || ' ' || p_type end as nom_commercial,
 'SCI ' || case when c_custkey % 4 = 0 then p_name || ' (' || substr(p_name, 1, 3) || ')' when c_custkey % 4 = 1 then 'Holding ' || c_custkey else 'Camping ' || p_name || ' SAS' end as raison_sociale,
 case when c_custkey % 17 = 0 then '' else (10000 + p_size % 43)::varchar end as code_postal, case when c_custkey % 2 = 0 then 'rue' end as type_voie, case when c_custkey % 2 = 0 then 'de ' || p_type end as libelle_voie, (c_custkey % 6)::varchar as numero_voie,
 (c_custkey % 6) || ' ter avenue de l''' || p_type || ' 10000 PARIS' as adresse, case when c_custkey % 10 = 0 then 'x.fr' else '' end as website from customer join part on p_partkey = c_custkey * 7 % (select count(*) from part))"""
_KEY = "regexp_replace(trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g')), '((^| )(sarl|sasu|eurl|sas|sci|sa|sl|paris))+$', '')"
_SQL = f"""with {_SITES}, {_COMPANIES},
fs as (select cle, postcode as cp, case when starts_with(street, 'Av') then 'avenue ' else 'rue ' end || lower(regexp_extract(street, '(\\w+)$', 1)) as street, coalesce(regexp_extract(housenumber, '([0-9]+)', 1), '') as number, {_KEY.format("nom")} as key, trim(website) as website,
 regexp_replace(regexp_extract(regexp_replace(lower(trim(website)), '^[a-z]+://', ''), '^([^/]*)', 1), '^www\\.', '') as dom from s),
pooled as (select dom from fs where dom <> '' group by 1 having count(distinct cle) >= 2),
fc as (select siret, code_postal as cp, case when type_voie is not null then 'rue ' else 'avenue ' end || lower(regexp_extract(coalesce(libelle_voie, regexp_extract(adresse, '''([A-Za-z]+)', 1)), '(\\w+)$', 1)) as street, numero_voie as number,
 list_filter(list_concat([{_KEY.format("enseigne")}, {_KEY.format("nom_commercial")}], list_transform(regexp_extract_all(raison_sociale, '\\(([^)]*)\\)', 1), lambda x: {_KEY.format("x")})), lambda k: k <> '') as against, {_KEY.format("regexp_replace(raison_sociale, '\\([^)]*\\)', ' ', 'g')")} as body
 from c where website = ''),
p as (select fc.siret, fs.cle, fs.website, fs.dom, fs.street = fc.street as same_street, fs.street = fc.street and fs.number <> '' and fs.number = fc.number as door, len(against) = 0 as free,
 fs.key <> '' and len(list_filter(list_concat(against, [body]), lambda k: k <> '' and (k = fs.key or (length(k) >= 4 and contains(fs.key, k)) or (length(fs.key) >= 4 and contains(k, fs.key))))) > 0 as agrees
 from fc join fs using (cp)),
r as (select *, case when same_street and door and (agrees or free) then 4 when same_street and agrees then 3 when same_street then 2 else 1 end as rank from p),
b as (select siret, max(rank) as best, count(*) as candidates from r group by 1),
t as (select siret, best, any_value(candidates) as candidates, count(distinct website) as sites, min(website) as website, bool_or(agrees) as agrees, bool_or(dom in (select dom from pooled)) as pooled, any_value(free) as free from b join r using (siret) where rank = best group by 1, 2)
select fc.siret, coalesce(candidates, 0)::bigint as candidates, case best when 4 then case when agrees then 'A' else 'A2' end when 3 then 'B' end as tier,
 case when best is null then 'no candidate' when best = 1 then 'postcode only' when best = 2 then case when free then 'no name' else 'name against' end when sites > 1 then 'ambiguous' when t.website = '' then 'no site' when pooled then 'pooled domain' else 'matched' end as outcome,
 case when best >= 3 and sites = 1 and t.website <> '' and not pooled then t.website end as website
from fc left join t using (siret)"""


def _frames(spark, d: str) -> tuple[DataFrame, DataFrame]:
    part, customer = load(spark, d, "part"), load(spark, d, "customer")
    k, c = F.col("p_partkey"), F.col("c_custkey")
    text = lambda x: x.cast("string")
    start = F.substring("p_name", 1, 3)
    nom = F.when(k % 5 == 0, F.concat(F.lit("Camping "), "p_name")).when(k % 5 == 1, F.concat("p_name", F.lit(" SARL"))).when(k % 5 == 2, F.upper("p_name")).when(k % 5 == 3, F.concat(F.lit("Les "), "p_name", F.lit(" de "), "p_type")).otherwise(start)
    website = F.when(k % 9 == 0, " ").when(k % 11 == 0, F.concat(F.lit("https://www.chain.fr/"), k)).otherwise(F.concat(F.lit("site"), k % 37, F.lit("-"), "p_size", F.lit(".fr")))
    sites = part.select(k.alias("cle"), nom.alias("nom"), text(F.col("p_size") % 40 + 10000).alias("postcode"), F.concat(F.when(k % 4 == 0, "Av. de la ").otherwise("rue "), "p_type").alias("street"), F.when(k % 7 > 0, F.concat(k % 6, F.when(k % 2 == 0, " bis").otherwise(""))).alias("housenumber"), website.alias("website"), F.lit(None).cast("string").alias("domaine"), F.lit("").alias("city"))
    rows = customer.join(part, k == c * 7 % part.count())
    raison = F.concat(F.lit("SCI "), F.when(c % 4 == 0, F.concat("p_name", F.lit(" ("), start, F.lit(")"))).when(c % 4 == 1, F.concat(F.lit("Holding "), c)).otherwise(F.concat(F.lit("Camping "), "p_name", F.lit(" SAS"))))
    companies = rows.select(
        c.alias("siret"), F.when(c % 3 == 0, F.col("p_name")).when(c % 13 == 0, "SARL").alias("enseigne"), F.when(c % 8 == 1, F.concat("p_name", F.lit(" "), "p_type")).alias("nom_commercial"), raison.alias("raison_sociale"),
        F.when(c % 17 == 0, "").otherwise(text(F.col("p_size") % 43 + 10000)).alias("code_postal"), F.when(c % 2 == 0, "rue").alias("type_voie"), F.when(c % 2 == 0, F.concat(F.lit("de "), "p_type")).alias("libelle_voie"), text(c % 6).alias("numero_voie"),
        F.concat(c % 6, F.lit(" ter avenue de l'"), "p_type", F.lit(" 10000 PARIS")).alias("adresse"), F.when(c % 10 == 0, "x.fr").otherwise("").alias("website"),
    )
    return companies, sites


@query(_SQL)
def register_match(spark, d):
    """Companies and register sites: the tier, the outcome and the website of each company without one."""
    return register.match_register(*_frames(spark, d)).select("siret", "candidates", "tier", "outcome", "website")


@query(f"""with o as ({_SQL}) select count(*) as companies, coalesce(sum(candidates), 0)::bigint as candidates, count(*) filter (tier = 'A') as a, count(*) filter (tier = 'A2') as a2, count(*) filter (tier = 'B') as b,
 {", ".join(f"count(*) filter (outcome = '{o}') as {o.replace(' ', '_')}" for o in ("matched", "no candidate", "postcode only", "name against", "no name", "ambiguous", "no site", "pooled domain"))} from o""")
def register_counts(spark, d):
    return register.register_counters(register.match_register(*_frames(spark, d)))


_STREETS = """l as (select distinct p_size as block, 'rue ' || p_name || ' ' || p_type as street from part), r as (select distinct p_size as block, case p_partkey % 3 when 0 then 'Av ' when 1 then 'r. ' else '' end ||
 substr(split_part(p_name, ' ', 1), 1, (1 + p_partkey % 7)::int) || ' ' || substr(split_part(p_name, ' ', 2), 1, (2 + p_partkey % 5)::int) || case when p_partkey % 11 > 0 then ' ' || p_type else '' end as street from part)"""


@query(f"""with {_STREETS},
w as (select block, street, case when list_contains(['rue', 'r', 'av'], x[1]) then x[2:] else x end as x from (select block, street, string_split(trim(regexp_replace(lower(street), '[^a-z0-9]+', ' ', 'g')), ' ') as x, from r)),
v as (select block, street, string_split(lower(substr(street, 5)), ' ') as x from l)
select block, v.street as left_street, w.street as right_street from v join w using (block)
where len(v.x) = len(w.x) and list_bool_and(list_transform(range(1, len(v.x) + 1), lambda i: v.x[i] = w.x[i] or (length(w.x[i]) >= 2 and length(v.x[i]) >= 2 and (starts_with(v.x[i], w.x[i]) or starts_with(w.x[i], v.x[i])))))""")
def street_agreement(spark, d):
    """Streets against streets with words cut short and another kind: those of a block that agree."""
    k = F.col("p_partkey")
    part = load(spark, d, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    cut = F.concat(F.when(k % 3 == 0, "Av ").when(k % 3 == 1, "r. ").otherwise(""), F.substring(word(1), F.lit(1), (k % 7 + 1).cast("int")), F.lit(" "), F.substring(word(2), F.lit(1), (k % 5 + 2).cast("int")), F.when(k % 11 > 0, F.concat(F.lit(" "), "p_type")).otherwise(""))
    left = part.select(F.col("p_size").alias("block"), F.concat(F.lit("rue "), "p_name", F.lit(" "), "p_type").alias("street"))
    return register.agreeing_streets(left, part.select(F.col("p_size").alias("block"), cut.alias("street")), ["block"])
