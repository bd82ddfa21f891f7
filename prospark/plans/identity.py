"""Entity matching, pooled values, catalogue scores and robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STREET_STOPS, STREET_WORDS, domain, html_text
from ..operators.evidence import LEGAL_WORDS, legal_links, site_evidence, visit_budget
from ..operators.matching import shared_values, signal_votes, tiered
from ..registry import query
from ..session import load
from ..sources.files import robots_table, robots_verdicts


@query("""
with h as (select page_id, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/:?#]*)', 1), '^www\\.', '') as host from pages)
select host, count(distinct page_id) as owners from h group by 1 having count(distinct page_id) >= 2""")
def pooled_domains(spark, d):
    p = load(spark, d, "pages").select("page_id", domain(F.col("url")).alias("host"))
    return shared_values(p, "host", "page_id")


def _sides(spark, d: str) -> tuple[DataFrame, DataFrame]:
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    left = c.select(
        k.alias("soc"), F.when(k % 40 == 0, (k % 97).cast("string")).alias("siret"), F.concat(F.lit("w"), k % 50).alias("domain"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("t"), k % 35)).alias("tel"), F.concat(F.lit("m"), "c_nationkey").alias("email"),
    )
    right = s.select(
        j.alias("poi"), F.when(j % 5 == 0, (j % 97).cast("string")).alias("siret"), F.concat(F.lit("w"), j % 50).alias("domain"),
        F.concat(F.lit("t"), j % 35).alias("tel"), F.when(j % 4 == 0, None).otherwise(F.concat(F.lit("m"), "s_nationkey")).alias("email"),
    )
    return left, right


_SIDES_SQL = """l as (select c_custkey as soc, case when c_custkey % 40 = 0 then (c_custkey % 97)::varchar end as siret, 'w' || (c_custkey % 50) as domain, case when c_custkey % 3 = 0 then '' else 't' || (c_custkey % 35) end as tel, 'm' || c_nationkey as email from customer),
r as (select s_suppkey as poi, case when s_suppkey % 5 = 0 then (s_suppkey % 97)::varchar end as siret, 'w' || (s_suppkey % 50) as domain, 't' || (s_suppkey % 35) as tel, case when s_suppkey % 4 <> 0 then 'm' || s_nationkey end as email from supplier)"""


@query("with " + _SIDES_SQL + """,
v as (select soc, poi, coalesce(l.siret = r.siret, false) as sure, coalesce(l.domain = r.domain, false)::int + coalesce(l.tel = r.tel and l.tel <> '', false)::int + coalesce(l.email = r.email, false)::int as n from l, r),
b as (select *, row_number() over (partition by soc order by sure desc, n desc, poi) as k from v where sure or n >= 2)
select soc, poi, case when sure then 'certain' else 'presumed' end as level, n::bigint as n_signals from b where k = 1""")
def signal_vote_match(spark, d):
    left, right = _sides(spark, d)
    return signal_votes(left, right, "soc", "poi", ["siret"], ["domain", "tel", "email"])


@query("""
with l as (select c_custkey as soc, c_nationkey::varchar as cp, 'street ' || (c_custkey % 9) as street, c_custkey % 4 as num from customer),
r as (select s_suppkey as poi, s_nationkey::varchar as cp, 'street ' || (s_suppkey % 9) as street, s_suppkey % 4 as num, 'site' || (s_suppkey % 6) as site from supplier),
p as (select soc, poi, site, case when l.street = r.street and l.num = r.num then 4 when l.street = r.street then 2 else 1 end as tier from l join r using (cp)),
b as (select *, rank() over (partition by soc order by tier desc) as k from p)
select soc, any_value(tier)::int as tier, count(distinct site) as n_answers, case when count(distinct site) = 1 then min(site) end as answer, case when count(distinct site) = 1 then min(poi) end as poi from b where k = 1 group by soc""")
def tiered_match(spark, d):
    """Within a postcode: street and number, street only, postcode only; several sites in the best tier mean none."""
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    left = c.select(F.col("c_custkey").alias("soc"), F.col("c_nationkey").cast("string").alias("cp"), F.concat(F.lit("street "), F.col("c_custkey") % 9).alias("street"), (F.col("c_custkey") % 4).alias("num"))
    right = s.select(F.col("s_suppkey").alias("poi"), F.col("s_nationkey").cast("string").alias("cp"), F.concat(F.lit("street "), F.col("s_suppkey") % 9).alias("street"), (F.col("s_suppkey") % 4).alias("num"), F.concat(F.lit("site"), F.col("s_suppkey") % 6).alias("site"))
    return tiered(left, right, [(4, ["cp", "street", "num"]), (2, ["cp", "street"]), (1, ["cp"])], "soc", "poi", "site")


def _folded(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(replace(replace(coalesce({x}, ''), 'ß', ' '), 'ẞ', ' '))), '[^a-z0-9]+', ' ', 'g'))"


def _streets(x: str) -> str:
    words = ", ".join(f"'{k}': '{v}'" for k, v in STREET_WORDS.items())
    stops = ", ".join(f"'{w}'" for w in STREET_STOPS)
    return f"array_to_string(list_transform(list_filter(string_split({_folded(x)}, ' '), lambda w: w <> '' and not list_contains([{stops}], w)), lambda w: coalesce(map_extract(MAP {{{words}}}, w)[1], w)), ' ')"


_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_OWN = "case page_id % 13 when 0 then ' SIRET 123.456.789 00012' when 1 then ' RCS 987 654 321, 75002' when 2 then ' 12 r. du Bac 75002' else '' end"


@query(f"""
with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, {_TEXT} || {_OWN} as text from pages),
f as (select host, string_split(min_by(text, page_id), ' ') as w, length(host) as n from p group by 1),
r as (select host, case n % 4 when 0 then '123456789' when 1 then '987654321' else '' end as siren, case when n % 3 = 0 then w[6] || ' ' || w[5] else w[5] || '-' || w[6] end as name, case n % 2 when 0 then w[9] else 'Zzyzx' end as manager, w[12] as city, case n % 5 when 0 then '75002' else '' end as cp,
 case n % 6 when 0 then 'rue' else '' end as kind, case n % 6 when 0 then 'du Bac' when 1 then w[15] || ' des ' || w[16] else '' end as street, case n % 6 when 2 then '12 RUE DU BAC 75002 PARIS' when 3 then w[20] end as address, n % 7 = 0 as attested from f),
k as (select *, {_folded("name")} as fname, {_folded("manager")} as fman, {_folded("city")} as fcity, case when street <> '' then {_streets("kind || ' ' || street")} when address like '12 %' then 'rue bac' when address is not null and not regexp_matches(address, '[0-9]') then {_streets("address")} else '' end as fstreet, case when street = '' and address like '12 %' then '12' else '' end as number from r),
x as (select page_id, host, text, {_folded("text")} as plain, ' ' || {_streets("text")} || ' ' as streets, list_transform(regexp_extract_all(text, '\\b[0-9]{{3}}[\\s. ]?[0-9]{{3}}[\\s. ]?[0-9]{{3}}\\b'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')) as sirens,
 list_transform(regexp_extract_all(text, '\\b[0-9]{{3}}[\\s. ]?[0-9]{{3}}[\\s. ]?[0-9]{{3}}[\\s. ]?[0-9]{{5}}\\b'), lambda v: left(regexp_replace(v, '[^0-9]', '', 'g'), 9)) as sirets from p),
s as (select k.host, any_value(attested) as attested, bool_or(siren <> '' and (list_contains(sirens, siren) or list_contains(sirets, siren))) as a, bool_or(length(fname) >= 4 and contains(plain, fname)) as b, bool_or(length(fcity) >= 3 and contains(plain, fcity)) as c, bool_or(length(cp) = 5 and regexp_matches(text, '\\b' || cp || '\\b')) as d,
 bool_or(length(fstreet) >= 4 and ((number <> '' and contains(streets, ' ' || number || ' ' || fstreet || ' ')) or (contains(fstreet, ' ') and contains(streets, ' ' || fstreet || ' ')))) as e, bool_or(length(fman) >= 3 and contains(plain, fman)) as f from k join x on k.host = x.host group by 1)
select host, case when a then 'certain' when b::int + ((c and d) or e)::int + f::int >= case when attested then 1 else 2 end then 'presumed' else 'none' end as verdict,
 array_to_string(list_filter([case when a then 'siret' end, case when b then 'raison_sociale' end, case when (c and d) or e then 'adresse' end, case when f then 'dirigeant_nom' end], lambda v: v is not null), ',') as signals from s""")
def evidence_crosscheck(spark, d):
    """A record for each host, put together from words of its pages, against all pages of the host."""
    i = F.col("page_id") % 13
    more = F.when(i == 0, " SIRET 123.456.789 00012").when(i == 1, " RCS 987 654 321, 75002").when(i == 2, " 12 r. du Bac 75002").otherwise("")
    pages = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.concat(html_text(F.col("html")), more).alias("text"))
    n, word = F.length("host"), lambda k: F.try_element_at("w", F.lit(k))
    first = pages.groupBy("host").agg(F.split(F.min_by("text", "page_id"), " ").alias("w"))
    records = first.select(
        F.col("host").alias("record_id"), "host", F.when(n % 4 == 0, "123456789").when(n % 4 == 1, "987654321").otherwise("").alias("siren"), F.when(n % 3 == 0, F.concat(word(6), F.lit(" "), word(5))).otherwise(F.concat(word(5), F.lit("-"), word(6))).alias("raison_sociale"),
        F.when(n % 2 == 0, word(9)).otherwise("Zzyzx").alias("dirigeant_nom"), word(12).alias("ville"), F.when(n % 5 == 0, "75002").otherwise("").alias("code_postal"), F.lit("").alias("numero_voie"), F.when(n % 6 == 0, "rue").otherwise("").alias("type_voie"),
        F.when(n % 6 == 0, "du Bac").when(n % 6 == 1, F.concat(word(15), F.lit(" des "), word(16))).otherwise("").alias("libelle_voie"), F.when(n % 6 == 2, "12 RUE DU BAC 75002 PARIS").when(n % 6 == 3, word(20)).alias("adresse"), (n % 7 == 0).alias("attested"),
    )
    return site_evidence(records, pages).select(F.col("record_id").alias("host"), "verdict", F.array_join("signals", ",").alias("signals"))


_LINK = """case page_id % 5 when 0 then '<A class="x" href="../mentions-legales?x=1">Mentions <b>l&eacute;gales</b></A>' when 1 then '<a href=''//OTHER.example/contact''>Contact</a><a href="?cgv">x</a>' when 2 then '<a href="./a/./b/../nous-contacter">Nous contacter</a><a href="mailto:contact@x.fr">contact</a>' when 3 then '<a href="/Legal#top">a</a><a href="/legal/">b</a><a href="/legal/">c</a>' else '' end"""


@query(rf"""
with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, html || {_LINK} as html from pages),
a as (select page_id, origin, path, unnest(regexp_extract_all(html, '<a\b[^>]*href\s*=\s*["''][^"'']+["''][^>]*>.*?</a>', 0, 'is')) as a from h),
l as (select page_id, origin, path, regexp_extract(a, 'href\s*=\s*["'']([^"'']+)["'']', 1, 'i') as href, {_folded("regexp_replace(regexp_extract(a, '^<a\b[^>]*>(.*)</a>$', 1, 'is'), '<[^>]+>', ' ', 'g')")} as label from a),
k as (select *, {_folded("href")} as plain from l),
w(word) as (values {", ".join(f"('{x}')" for x in LEGAL_WORDS)}),
m as (select distinct page_id, origin, path, href from k join w on contains(label, word) or contains(plain, replace(word, ' ', '')) or contains(plain, word)),
u as (select page_id, case when starts_with(href, '//') or href like 'mailto:%' then null when starts_with(href, '/') then origin || href when starts_with(href, '?') then origin || path || href
 when starts_with(href, '../') then origin || case when len(string_split(path, '/')) > 3 then array_to_string(string_split(path, '/')[:-3], '/') else '' end || substr(href, 3) when starts_with(href, './') then origin || regexp_extract(path, '^(.*/)', 1) || 'a/nous-contacter' else origin || regexp_extract(path, '^(.*/)', 1) || href end as url from m)
select page_id, array_to_string(list_sort(list(distinct url)), ' ') as links from u where url is not null group by 1""")
def same_host_links(spark, d):
    """Legal and contact links of pages as addresses on their own host: relative ones resolved, other hosts and mail left out."""
    i = F.col("page_id") % 5
    more = F.when(i == 0, '<A class="x" href="../mentions-legales?x=1">Mentions <b>l&eacute;gales</b></A>').when(i == 1, "<a href='//OTHER.example/contact'>Contact</a><a href=\"?cgv\">x</a>").when(i == 2, '<a href="./a/./b/../nous-contacter">Nous contacter</a><a href="mailto:contact@x.fr">contact</a>').when(i == 3, '<a href="/Legal#top">a</a><a href="/legal/">b</a><a href="/legal/">c</a>').otherwise("")
    links = load(spark, d, "pages").select("page_id", legal_links(F.concat("html", more), F.col("url")).alias("links"))
    return links.where(F.size("links") > 0).select("page_id", F.array_join(F.array_sort("links"), " ").alias("links"))


@query(f"""
with c as (select page_id, place, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || path as url, contains(path, 'contact') as contact from pages, (values (0, '/a'), (1, '/legal-1'), (2, '/b'), (3, '/mentions-legales'), (4, '/mentions'), (5, '/cgv'), (6, '/contact')) t(place, path) where (page_id + place) % 3 > 0 or place = 6),
r as (select *, row_number() over (partition by page_id, contact order by place) = 1 as reserved from c), n as (select *, row_number() over (partition by page_id order by reserved desc, place) as n from r)
select page_id, url, case when contact then 'contact' else 'mentions' end as nature from n where n <= 4""")
def visit_plan(spark, d):
    """Which of a site's candidate pages to read: one legal and one contact page are kept, the others in order."""
    paths = [(0, "/a"), (1, "/legal-1"), (2, "/b"), (3, "/mentions-legales"), (4, "/mentions"), (5, "/cgv"), (6, "/contact")]
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("path")) for i, p in paths))
    c = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("origin"), F.explode(each).alias("p")).where("(page_id + p.place) % 3 > 0 or p.place = 6")
    return visit_budget(c.select("page_id", F.concat("origin", "p.path").alias("url"), "p.place"), "page_id", "url", "place").select("page_id", "url", "nature")


@query("""
with q(query) as (values ('red widget'), ('small'), ('economy'), ('brand#2')),
s as (select query, p_partkey, case when lower(p_brand) = query then 100 when starts_with(lower(p_brand), query) then 95 when lower(p_type) = query then 90 when contains(lower(p_type), query) then 75
 when lower(p_name) = query then 80 when contains(lower(p_name), query) then 70 end as score from q, part),
r as (select *, row_number() over (partition by query order by score desc, p_partkey) as n from s where score is not null)
select query, p_partkey, score::int as score from r where n <= 12""")
def score_catalogue(spark, d):
    """The first rule that fires gives a label's score for a query; the best twelve of each query."""
    q = spark.createDataFrame([("red widget",), ("small",), ("economy",), ("brand#2",)], "query string")
    low = lambda c: F.lower(F.col(c))
    k = F.col("query")
    score = F.when(low("p_brand") == k, 100).when(low("p_brand").startswith(k), 95).when(low("p_type") == k, 90).when(low("p_type").contains(k), 75).when(low("p_name") == k, 80).when(low("p_name").contains(k), 70)
    # a stated list of queries against the whole catalogue
    s = load(spark, d, "part").crossJoin(F.broadcast(q)).withColumn("score", score).where("score is not null")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "p_partkey")
    return s.withColumn("n", F.row_number().over(top)).where("n <= 12").select("query", "p_partkey", "score")


_ROBOTS = {
    0: "User-agent: *\nDisallow: /\nAllow: /en/ # pages\n",
    1: "User-agent: *\nDisallow: /\n\nUser-agent: Prosp\nUser-agent: other\nDisallow: /fr/\nAllow: /fr/*ref=\nDisallow: /es/*1$\nDisallow:\n",
}


@query("""
with u as (select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, regexp_replace(url, '^[a-z]+://[^/]*', '') as path from pages),
rules(kind, allow, pattern, size) as (values (0, false, '^/', 1), (0, true, '^/en/', 4), (1, false, '^/fr/', 4), (1, true, '^/fr/.*ref=', 9), (1, false, '^/es/.*1$', 7)),
m as (select page_id, coalesce(max(size) filter (allow and regexp_matches(path, pattern)), -1) as a, coalesce(max(size) filter (not allow and regexp_matches(path, pattern)), -1) as b from u left join rules on kind = length(host) % 2 and length(host) % 3 > 0 group by 1)
select page_id, a >= b as allowed from m""")
def robots_evaluation(spark, d):
    """Each host's robots text (hosts of some lengths have none) against the paths of its pages."""
    pages = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    robots = pages.select("host").distinct().where(F.length("host") % 3 > 0).withColumn("text", F.when(F.length("host") % 2 == 0, _ROBOTS[0]).otherwise(_ROBOTS[1]))
    return robots_verdicts(pages, robots_table(robots, "Prospark-Bot")).select("page_id", "allowed")
