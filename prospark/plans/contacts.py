"""Imports of contacts, address probes, prospects and mail records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts
from ..registry import query
from ..session import load

_KEY = "regexp_replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), '((^| )(sarl|sasu|eurl|sas|sci|sa|sl|paris))+$', '')"


@query("""
with c as (select c_custkey, c_custkey % 6 as k, c_mktsegment as s from customer)
select c_custkey, case k when 0 then 'M.|Jean|' || s || '||' when 1 then '|Anne|Roy|Co-gérant|;Mme|Théo|' || s || '|Co-gérant|' when 2 then '|Ann|' || s || '||Bretagne;|Cy|Do|gérant|'
 when 3 then '||' || s || '|Acheteurs|' when 4 then '|Le|Roux ' || s || '||Val de Loire' else '' end as people from c""")
def people_split(spark, d):
    k, s = F.col("c_custkey") % 6, F.col("c_mktsegment")
    cell = F.when(k == 0, F.concat(F.lit("Monsieur Jean "), s)).when(k == 1, F.concat(F.lit("Anne Roy / Mlle Théo "), s, F.lit(" (Co-gérants)"))).when(k == 2, F.concat(F.lit("Ann "), s, F.lit(" (Bretagne) Cy Do (gérant)")))
    cell = cell.when(k == 3, s).when(k == 4, F.concat(F.lit("Le  Roux "), s, F.lit(" (Val de Loire) "))).otherwise(" ")
    found = contacts.people(cell, F.when(k == 3, "Acheteurs"))
    line = F.transform(found, lambda p: F.concat_ws("|", p.civility, p.given, p.family, p.job, p.note))
    return load(spark, d, "customer").select("c_custkey", F.array_join(line, ";").alias("people"))


_HEADERS = (
    ("Prénom", "prenom"), ("Nom", "nom"), ("E-mail pro", "email"), ("Tél. portable", "tel"), ("Page LinkedIn société", "linkedin_entreprise"), ("Profil LinkedIn", "linkedin"), ("Code Postal", "cp"), ("Couleur", None),
    ("Full name", "nom_complet"), ("Name", "nom_complet"), ("CONTACT", "nom_complet"), ("Nom complet", "nom_complet"), ("Forme juridique", "forme_juridique"), ("Remarques / Spécialités", "note_societe"), ("Agence", "societe"),
    ("Nom du camping", "societe"), ("partner_is_company", None), ("industry_id/name", None), ("Client/Contacts/Courriel", "email"), ("Fonction dirigeant", "poste"), ("Nom dirigeant", "nom_complet"), ("URL", "url"), ("company name", "societe"), ("zip", "cp"),
)


@query("with h(i, header, field) as (values " + ", ".join(f"({i}, '{h}', {repr(f) if f else 'null'})" for i, (h, f) in enumerate(_HEADERS)) + ") select c_custkey, case when c_custkey % 5 = 0 then upper(header) else header end as header, field from customer join h on i = c_custkey % 24")
def header_mapping(spark, d):
    """The header that each customer's file has for a column, in either case, and the field it names."""
    k = F.col("c_custkey")
    header = F.element_at(F.array(*(F.lit(h) for h, _ in _HEADERS)), (k % 24 + 1).cast("int"))
    rows = load(spark, d, "customer").select("c_custkey", F.when(k % 5 == 0, F.upper(header)).otherwise(header).alias("header"))
    return contacts.with_header_fields(rows, "header").select("c_custkey", "header", "field")


@query("""
with c as (select c_custkey, c_custkey % 3 as k, c_mktsegment as s, lpad((c_custkey % 90000)::varchar, 5, '0') as p from customer)
select c_custkey, case k when 0 then '' else '12 rue ' || s end as adresse, p as cp, s as ville, case k when 1 then 'https://linkedin.com/in/' || s else '' end as linkedin,
 case k when 0 then 'https://linkedin.com/company/' || s else '' end as linkedin_entreprise, case k when 2 then 'http://x.org' else 'https://' || lower(s) || '.fr' end as site from c""")
def repaired_cells(spark, d):
    """Postcodes glued to towns, addresses in one block, pages in the wrong column, sites without a scheme."""
    k, s, p = F.col("c_custkey") % 3, F.col("c_mktsegment"), F.lpad((F.col("c_custkey") % 90000).cast("string"), 5, "0")
    rows = load(spark, d, "customer").select(
        "c_custkey", F.when(k == 1, F.concat(F.lit("12 rue "), s, F.lit(", "), p, F.lit(" "), s)).when(k == 2, F.concat(F.lit("12 rue "), s)).alias("adresse"),
        F.when(k == 0, F.concat_ws(" ", p, s)).when(k == 2, p).otherwise("").alias("cp"), F.when(k == 2, s).alias("ville"),
        F.when(k == 0, F.concat(F.lit("https://linkedin.com/company/"), s)).alias("linkedin"), F.when(k == 1, F.concat(F.lit("https://linkedin.com/in/"), s)).alias("linkedin_entreprise"),
        F.when(k == 2, "http://x.org").otherwise(F.concat(F.lower(s), F.lit(".fr"))).alias("site"),
    )
    return contacts.repaired(rows)


@query(f"""
with p as (select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then p_name || ' ' || p_brand when 2 then p_type else '' end as name, case when p_partkey % 3 = 0 then p_brand else '' end as brand, case when p_partkey % 5 = 0 then p_type else '' end as bracket, p_name as base from part),
k as (select p_partkey, {_KEY.format("name")} as n, [{_KEY.format("brand")}, {_KEY.format("bracket")}] as public, {_KEY.format("base")} as base from p),
e as (select p_partkey, n, unnest(public || [base]) as key, public[1] <> '' or public[2] <> '' as has_public from k)
select p_partkey, case when bool_or(n <> '' and key <> '' and (key = n or (length(key) >= 4 and contains(n, key)) or (length(n) >= 4 and contains(key, n)))) then 'concordant' when any_value(has_public) then 'discordant' else 'absent' end as verdict from e group by 1""")
def name_verdicts(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat_ws(" ", "p_name", "p_brand")).when(k % 4 == 2, F.col("p_type"))
    legal = F.when(k % 5 == 0, F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")"))).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", contacts.name_agreement(name, F.when(k % 3 == 0, F.col("p_brand")), F.lit(None).cast("string"), legal).alias("verdict"))


_PROBE_SQL = """l as (select c_custkey as soc, 'firm ' || (c_custkey % 40) as name, 'c' || (c_custkey % 5) as city, 'p' || (c_custkey % 2) as cp, 'rue ' || (c_custkey % 3) as street, case when c_custkey % 7 > 0 then c_custkey % 4 end as num, 't' || (c_custkey % 35) as tel, 'w' || (c_custkey % 50) as domain, case when c_custkey % 40 = 1 then c_custkey % 97 end as siret from customer),
r as (select s_suppkey as poi, 'firm ' || (s_suppkey % 40) as name, 'c' || (s_suppkey % 5) as city, 'p' || (s_suppkey % 2) as cp, 'rue ' || (s_suppkey % 3) as street, s_suppkey % 4 as num, 't' || (s_suppkey % 35) as tel, 'w' || (s_suppkey % 50) as domain, s_suppkey % 97 as siret, s_suppkey % 11 as answer from supplier),
p as (select soc, poi, answer, coalesce(l.street = r.street and l.num = r.num, false) as exact from l join r using (name, city, cp)),
a as (select soc, bool_or(exact) as hit, count(distinct answer) filter (exact) as answers, min(poi) filter (exact) as exact_poi, min(poi) as near from p group by 1),
probe as (select soc, case when hit then 'L3' else 'L2' end as level, case when hit then exact_poi else near end as poi from a where not hit or answers = 1)"""


def _probe_sides(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")

    def side(df, key, name):
        k = F.col(key)
        part = lambda prefix, n: F.concat(F.lit(prefix), k % n)
        return df.select(k.alias(name), F.concat(F.lit("Firm "), k % 40, F.lit(" SARL")).alias("name"), part("C", 5).alias("city"), part("p", 2).alias("postcode"), part("r ", 3).alias("street"), (k % 4).cast("string").alias("number"), part("t", 35).alias("tel"), part("w", 50).alias("domain"), (k % 97).cast("string").alias("siret"), (k % 11).alias("answer"))

    k = F.col("soc")
    left = side(c, "c_custkey", "soc").withColumns({"number": F.when(k % 7 > 0, F.col("number")), "siret": F.when(k % 40 == 1, F.col("siret"))})
    return left, side(s, "s_suppkey", "poi")


@query(f"with {_PROBE_SQL} select soc, level, poi from probe")
def address_probes(spark, d):
    left, right = _probe_sides(spark, d)
    return contacts.address_probe(left, right, "soc", "poi", "answer")


@query(f"""with {_PROBE_SQL},
v as (select soc, r.poi, coalesce(l.siret = r.siret, false) as sure, coalesce(r.poi = seed.poi, false)::int + (l.tel = r.tel)::int + (l.domain = r.domain)::int as n
 from l left join (select * from probe where level = 'L2') seed using (soc), r where soc not in (select soc from probe where level = 'L3')),
b as (select *, row_number() over (partition by soc order by sure desc, n desc, poi) as k from v where sure or n >= 2),
o as (select soc, soc % 10 as dept, case when x.level = 'L3' then 'certain address' when b.sure then 'certain' when b.soc is not null then 'presumed' else 'rejected' end as outcome, coalesce(x.level = 'L2', false) as seeded from l left join probe x using (soc) left join (select * from b where k = 1) b using (soc))
select dept, count(*) as treated, count(*) filter (outcome = 'certain address') as certain_address, count(*) filter (outcome = 'certain') as certain, count(*) filter (outcome = 'presumed') as presumed, count(*) filter (outcome = 'rejected') as rejected, count(*) filter (seeded) as presumed_address from o group by 1""")
def matching_counters(spark, d):
    left, right = _probe_sides(spark, d)
    matched = contacts.match_companies(left, right, "soc", "poi", "answer", ["siret"], ["tel", "domain"])
    return contacts.match_counters(matched.withColumn("dept", F.col("soc") % 10), "dept")


@query("""
with l as (select c_custkey as soc, case when c_custkey % 2 = 0 then 'x' || (c_custkey % 60) else '' end as siren, 'n' || (c_custkey % 45) as name, 'c' || (c_custkey % 3) as city from customer),
r as (select s_suppkey as poi, case when s_suppkey % 3 > 0 then 'x' || (s_suppkey % 70) end as siren, 'n' || (s_suppkey % 50) as name, 'c' || (s_suppkey % 3) as city from supplier),
a as (select poi, min(soc) as soc from r join l using (siren) where siren <> '' group by 1), b as (select poi, min(soc) as soc from r join l using (name, city) group by 1)
select poi, coalesce(a.soc, b.soc) as soc, case when a.soc is not null then 'siren' else 'name and city' end as by from a full join b using (poi)""")
def points_to_companies(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    companies = load(spark, d, "customer").select(c.alias("soc"), F.when(c % 2 == 0, F.concat(F.lit("x"), c % 60)).alias("siren"), F.concat(F.lit("N"), c % 45).alias("name"), F.concat(F.lit("c"), c % 3).alias("city"))
    points = load(spark, d, "supplier").select(s.alias("poi"), F.when(s % 3 > 0, F.concat(F.lit("x"), s % 70)).alias("siren"), F.concat(F.lit("n"), s % 50).alias("name"), F.concat(F.lit("C"), s % 3).alias("city"))
    return contacts.companies_of_points(points, companies, "poi", "soc")


@query("""
with q as (select o_orderkey as request_id, o_custkey % 9 as user_id, case when o_orderkey % 13 = 0 then '' else 's' || (o_orderkey % 400) end as siren, 'e' || (o_orderkey % 800) as siret, case when o_orderkey % 17 = 0 then 'C' when o_orderkey % 2 = 0 then 'A' else '' end as state, o_orderkey % 3 as people from orders),
f as (select *, case when siren = '' then 'no siren' when siret in (select 'e' || (s_suppkey * 5) from supplier where s_suppkey <= 100) then 'opted out' when state = 'C' then 'closed' end as refusal from q),
w as (select *, refusal is null and row_number() over (partition by user_id, siren, refusal is null order by request_id) = 1 as makes from f),
c as (select distinct c_custkey % 9 as user_id, 's' || (c_custkey % 200) as siren from customer), k as (select distinct user_id, siren from c where siren like '%1')
select request_id, refusal, makes and c.siren is null as new_company, makes and k.siren is null as new_card, case when makes and c.siren is null then people else 0 end::int as n_contacts from w left join c using (user_id, siren) left join k using (user_id, siren)""")
def materialised_prospects(spark, d):
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    person = F.struct(F.lit("Ann").alias("given"), F.lit("Roy").alias("family"))
    asked = load(spark, d, "orders").select(
        o.alias("request_id"), (F.col("o_custkey") % 9).alias("user_id"), F.when(o % 13 == 0, None).otherwise(F.concat(F.lit("s "), o % 400)).alias("siren"), F.concat(F.lit("e "), o % 800).alias("siret"),
        F.when(o % 17 == 0, "C").when(o % 2 == 0, "A").alias("state"), F.array_repeat(person, (o % 3).cast("int")).alias("people"),
    )
    companies = load(spark, d, "customer").select((c % 9).alias("user_id"), F.concat(F.lit("s"), c % 200).alias("siren"))
    blocked = load(spark, d, "supplier").where("s_suppkey <= 100").select(F.sha2(F.concat(F.lit("e"), F.col("s_suppkey") * 5), 256).alias("siret_hash"))
    made = contacts.prospects(asked, companies, companies.where("siren like '%1'"), blocked)
    return made.select("request_id", "refusal", "new_company", "new_card", "n_contacts")


@query("""
select o_orderkey, lpad((o_custkey % 9999)::varchar, 4, '0') || 'Z' as naf, 'ab' || o_orderkey as search_id, case when o_orderkey % 4 = 0 then 0 else o_custkey end as n_results from orders where o_orderkey % 3 > 0 and o_orderkey % 11 > 0""")
def captured_searches(spark, d):
    k, n = F.col("o_orderkey"), F.lpad((F.col("o_custkey") % 9999).cast("string"), 4, "0")
    naf = F.when(k % 3 == 0, F.concat(n, F.lit("z"))).when(k % 3 == 1, F.concat(n, F.lit("Z "))).otherwise(F.concat(F.substring(n, 1, 2), F.lit("."), F.substring(n, 3, 2), F.lit("Z")))
    raw = load(spark, d, "orders").select("o_orderkey", F.when(k % 11 > 0, F.col("o_custkey")).alias("user_id"), naf.alias("naf"), F.concat(F.lit(" A-b"), k, F.lit("!")).alias("search_id"), F.when(k % 4 > 0, F.col("o_custkey")).alias("n_results"))
    return contacts.captured_searches(raw).drop("user_id")


@query("select o_orderpriority as priority, count(*) filter (o_orderkey % 5 < 4 and o_orderkey % 7 > 0) as n from orders group by 1 having n > 0")
def captured_attempts(spark, d):
    k = F.col("o_orderkey")
    raw = load(spark, d, "orders").select("o_orderpriority", F.when(k % 7 > 0, F.col("o_custkey")).alias("user_id"), F.get(F.array(*map(F.lit, [*contacts.OUTCOMES, "autre"])), (k % 5).cast("int")).alias("outcome"))
    return contacts.captured_attempts(raw).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("""
with c as (select c_custkey as k, 'd' || c_custkey || '.fr' as domain from customer)
select domain, case k % 4 when 0 then 2 when 3 then 0 else 1 end::bigint as n_spf, k % 4 < 2 as covered, k % 3 = 0 as dkim, case k % 5 when 0 then 'reject' when 1 then 'none' when 2 then '' end as dmarc from c""")
def mail_records(spark, d):
    k = F.col("c_custkey")
    domain = F.concat(F.lit("d"), k, F.lit(".fr"))
    record = lambda name, txt: F.struct(name.alias("name"), txt.alias("txt"))
    root = F.when(k % 4 == 1, "V=SPF1 ip4:1.2.3.4 +include:Spf.Sender.example. -all").when(k % 4 == 2, "v=spf1 include:other.example ~all").when(k % 4 == 3, "v=spf10 include:spf.sender.example").otherwise("v=spf1 redirect=spf.sender.example")
    key = F.when(k % 3 == 0, F.concat(F.lit("v=DKIM1; k=rsa; p="), F.repeat(F.lit("Ab"), 40))).when(k % 3 == 1, "v=DKIM1; p=").otherwise("note")
    policy = F.when(k % 5 == 0, "v=DMARC1; p=Reject; pct=100").when(k % 5 == 1, "v=DMARC1;p=none").when(k % 5 == 2, "v=DMARC1").otherwise("other")
    records = F.array(record(domain, root), record(domain, F.when(k % 4 == 0, "v=spf1 -all").otherwise("note")), record(F.concat(F.lit("s1._domainkey."), domain), key), record(F.concat(F.lit("_dmarc."), domain), policy))
    rows = load(spark, d, "customer").select(domain.alias("domain"), F.explode(records).alias("r")).select("domain", "r.name", "r.txt")
    return contacts.mail_setup(rows, "spf.sender.example")
