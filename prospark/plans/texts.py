"""Extraction and normalisation queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import HOSTERS, company_key, domain, html_text, mails_in, own_domain_first, phones_in, sirens_in, sirets_in, street_key
from ..functions.values import department
from ..registry import query
from ..session import load

_ENDS = "'((^| )(sarl|sasu|eurl|sas|sci|sa|sl|paris))+$'"


@query("""select page_id, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/:?#]*)', 1), '^www\\.', '') as host from pages""")
def host_domain(spark, d):
    return load(spark, d, "pages").select("page_id", domain(F.col("url")).alias("host"))


@query("select doc_id, regexp_replace(trim(regexp_replace(strip_accents(lower(replace(replace(w, 'ß', ' '), 'ẞ', ' '))), '[^a-z0-9]+', ' ', 'g')), " + _ENDS + ", '') as key from (select doc_id, replace(text, chr(10), ' ') || case when doc_id % 3 = 0 then ' SARL' when doc_id % 3 = 1 then ' sas Paris' else '' end as w from documents)")
def company_keys(spark, d):
    """Whole texts as names, with legal forms put behind some of them."""
    k = F.col("doc_id") % 3
    name = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.when(k == 0, " SARL").when(k == 1, " sas Paris").otherwise(""))
    return load(spark, d, "documents").select("doc_id", company_key(name).alias("key"))


@query("""with s as (select c_custkey, case c_custkey % 4 when 0 then 'av' when 1 then 'bd' when 2 then 'r' else 'che' end as kind, case c_custkey % 3 when 0 then 'des Lilas' when 1 then 'du Gal Leclerc' else 'St Martin' end as label from customer)
select c_custkey, case kind when 'av' then 'avenue' when 'bd' then 'boulevard' when 'r' then 'rue' else 'chemin' end || ' ' || case label when 'des Lilas' then 'lilas' when 'du Gal Leclerc' then 'general leclerc' else 'saint martin' end as key from s""")
def street_keys(spark, d):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("av", "bd", "r", "che"))), (k % 4 + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, ("des Lilas", "du Gal Leclerc", "St Martin"))), (k % 3 + 1).cast("int"))
    return load(spark, d, "customer").select("c_custkey", street_key(kind, label).alias("key"))


@query("""with p as (select c_custkey, case when c_custkey % 10 = 0 then 'x' else lpad((c_custkey * 977 % 99000)::varchar, 5, '0') end as cp from customer)
select c_custkey, case when not regexp_matches(cp, '^[0-9]{5}$') then '' when regexp_matches(cp, '^9[78]') then cp[1:3] when cp[1:2] = '20' then case when cp < '20200' then '2A' else '2B' end else cp[1:2] end as dept from p""")
def dept_from_postcode(spark, d):
    k = F.col("c_custkey")
    cp = F.when(k % 10 == 0, "x").otherwise(F.lpad((k * 977 % 99000).cast("string"), 5, "0"))
    return load(spark, d, "customer").select("c_custkey", department(cp).alias("dept"))


@query("""select doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b[0-9]{3}[\\s.' || chr(160) || ']?[0-9]{3}[\\s.' || chr(160) || ']?[0-9]{3}[\\s.' || chr(160) || ']?[0-9]{5}\\b'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')))), ','), '') as sirets, len(regexp_extract_all(text, '[0-9]{9,}')) as runs from documents""")
def extract_sirets(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.array_sort(sirets_in(F.col("text"))), ",").alias("sirets"), F.size(F.regexp_extract_all("text", F.lit("[0-9]{9,}"), F.lit(0))).cast("bigint").alias("runs"))


_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_HOSTERS = "|".join(h.replace(".", r"\.") for h in HOSTERS)


@query(rf"""
with p as (select page_id, regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/:?#]*)', 1), '^www\.', '') as host, {_TEXT} || case page_id % 4 when 0 then ' Contact@' || regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\.', '') || ', ann@firm.fr; noreply@firm.fr logo@2x.png a@wix.com 01.42 68-53 00' when 1 then ' tel +33 6 12 34 56 78 or 0800 123 456 RCS 123 456.789' else '' end as text from pages),
m as (select page_id, host, list_distinct(list_transform(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b'), lambda x: lower(x))) as mails,
 list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?:\+33|0)\s?[1-9](?:[\s.\- ]?[0-9]{{2}}){{4}}\b'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '[^0-9+]', '', 'g'), '^\+33', '0'), '[^0-9]', '', 'g')), lambda d: length(d) = 10 and not starts_with(d, '08'))) as phones,
 list_distinct(list_transform(regexp_extract_all(text, '\b[0-9]{{3}}[\s. ]?[0-9]{{3}}[\s. ]?[0-9]{{3}}\b'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))) as sirens from p),
u as (select *, list_filter(mails, lambda e: not regexp_matches(split_part(e, '@', 1), '^(no-?reply|ne-?pas-?repondre|nepasrepondre|postmaster|webmaster|mailer-daemon|daemon|abuse|hostmaster)$') and not regexp_matches(regexp_replace(split_part(e, '@', 2), '^www\.', ''), '(^|\.)example\.(com|org|net)$')
 and not regexp_matches(split_part(e, '@', 2), '\.(png|jpg|jpeg|gif|webp|svg)$') and not regexp_matches(regexp_replace(split_part(e, '@', 2), '^www\.', ''), '(^|\.)({_HOSTERS})$')) as useful from m)
select page_id, array_to_string(list_sort(list_filter(useful, lambda e: split_part(e, '@', 2) = host)), ',') as own_mails, array_to_string(list_sort(list_filter(useful, lambda e: split_part(e, '@', 2) <> host)), ',') as other_mails, array_to_string(list_sort(phones), ',') as phones, array_to_string(list_sort(sirens), ',') as sirens from u""")
def extract_contacts(spark, d):
    """Mails (those of the page's own host apart), phones and company numbers of pages' texts, to which some are put."""
    k, bare = F.col("page_id") % 4, F.regexp_replace(F.regexp_extract("url", "://([^/]*)", 1), r"^www\.", "")
    more = F.when(k == 0, F.concat(F.lit(" Contact@"), bare, F.lit(", ann@firm.fr; noreply@firm.fr logo@2x.png a@wix.com 01.42 68-53 00"))).when(k == 1, " tel +33 6 12 34 56 78 or 0800 123 456 RCS 123 456.789").otherwise("")
    p = load(spark, d, "pages").select("page_id", domain(F.col("url")).alias("host"), F.concat(html_text(F.col("html")), more).alias("text"))
    mails = own_domain_first(mails_in(F.col("text")), F.col("host"))
    own = lambda e: F.substring_index(e, "@", -1) == F.col("host")
    line = lambda a: F.array_join(F.array_sort(a), ",")
    return p.select("page_id", line(F.filter(mails, own)).alias("own_mails"), line(F.filter(mails, lambda e: ~own(e))).alias("other_mails"), line(phones_in(F.col("text"))).alias("phones"), line(sirens_in(F.col("text"))).alias("sirens"))


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages""")
def html_texts(spark, d):
    return load(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("""
with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)
select page_id, count(*) as links, count(*) filter (starts_with(href, '/') or not contains(href, '://')) as own, count(*) filter (regexp_matches(lower(href), 'legal|mentions|contact|about|privacy')) as legal from l group by 1""")
def legal_links(spark, d):
    """Links of pages: how many stay on the host, and how many lead to legal or contact pages."""
    p = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    own = F.col("href").startswith("/") | ~F.col("href").contains("://")
    return p.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(own).alias("own"), F.count_if(F.lower("href").rlike("legal|mentions|contact|about|privacy")).alias("legal"))


@query("""
with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages),
k as (select page_id, href, case when contains(lower(href), 'contact') then 'contact' when regexp_matches(lower(href), 'legal|mentions|privacy') then 'legal' else 'other' end as nature from l),
o as (select page_id, nature, min(href) as href from k group by 1, 2), r as (select *, row_number() over (partition by page_id order by case nature when 'legal' then 0 when 'contact' then 1 else 2 end, href) as n from o)
select page_id, nature, href from r where n <= 2""")
def page_budget(spark, d):
    """Two pages to visit per site, one of each nature, legal ones first."""
    from ..operators.rows import newest

    low = F.lower("href")
    nature = F.when(low.contains("contact"), "contact").when(low.rlike("legal|mentions|privacy"), "legal").otherwise("other")
    p = load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    one = p.groupBy("page_id", nature.alias("nature")).agg(F.min("href").alias("href"))
    order = F.when(F.col("nature") == "legal", 0).when(F.col("nature") == "contact", 1).otherwise(2)
    return newest(one, ["page_id"], [order, F.col("href")], 2)
