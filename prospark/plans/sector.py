"""Sector search over a catalogue made of the parts' names, kinds and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sector
from ..registry import query
from ..session import load

_FOLD = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_VARIANTS = "list_filter([{0}, case when length({0}) > 4 and suffix({0}, 's') then left({0}, length({0}) - 1) when length({0}) > 3 and not suffix({0}, 's') then {0} || 's' end], lambda v: v is not null)"


@query(f"""
with cat as (select p_partkey as place, lpad((p_partkey % 97)::varchar, 2, '0') || '.' || lpad(p_partkey::varchar, 5, '0') || chr((65 + p_partkey % 6)::int) as code, p_name || case p_partkey % 3 when 0 then 's (' || p_type || ')' when 1 then ', ' || p_brand else '' end as label from part),
syn as (select case p_partkey % 4 when 0 then 'atelier' || p_size when 1 then 'shop ' || p_brand else 'machinery' end as synonym, lpad((p_partkey % 97)::varchar, 2, '0') || '.' || lpad(p_partkey::varchar, 5, '0') || chr((65 + p_partkey % 6)::int) as code from part where p_partkey % 10 = 0),
raw as (select s_suppkey as query_id, case s_suppkey % 9 when 0 then left(p_name, 3) when 1 then upper(p_name) when 2 then split_part(p_name, ' ', 2) || 's ' || lower(p_brand) when 3 then lpad((s_suppkey % 97)::varchar, 2, '0') when 4 then (select code from cat where place = s_suppkey)
 when 5 then 'atelier' || p_size when 6 then 'shop bra' when 7 then left(p_name, 6) || 'zz nothing ' || p_type else 'x' end as query from supplier join part on p_partkey = s_suppkey),
q as (select query_id, {_FOLD.format("query")} as q from raw where length(trim(query)) >= 2),
c as (select place, code, lower(code) as low, {_FOLD.format("label")} as label from cat), y as (select {_FOLD.format("synonym")} as synonym, code from syn),
w as (select query_id, unnest(list_distinct(list_filter(string_split(q, ' '), lambda x: length(x) >= 2))) as w from q), v as (select distinct unnest(string_split(label, ' ')) as word from c),
m as (select distinct w.w, v.word from (select distinct w from w) w, v where len(list_filter({_VARIANTS.format("w.w")}, lambda a: len(list_filter({_VARIANTS.format("v.word")}, lambda b: length(b) >= 2 and starts_with(b, a))) > 0)) > 0 or (length(w.w) >= 5 and length(v.word) >= 5 and left(w.w, 5) = left(v.word, 5))),
lw as (select distinct code, unnest(string_split(label, ' ')) as word from c),
h as (select query_id, code, count(distinct w.w) as n, count(distinct w.w) filter (length(w.w) >= 3) as long from w join m using (w) join lw using (word) group by 1, 2), k as (select query_id, count(*) as n from w group by 1),
s as (select q.query_id, c.code, place, case when low = q or replace(low, '.', '') = regexp_replace(q, '[^a-z0-9]', '', 'g') then 100 when starts_with(low, q) then 95
 when (q.q, c.code) in (select (synonym, code) from y) then 90 when length(q) >= 3 and exists (select 1 from y where y.code = c.code and contains(y.synonym, q.q)) then 75 when h.n = k.n then 80 when length(q) >= 3 and contains(label, q) then 70 when h.long > 0 then 40 + 10 * h.long end as score
 from q cross join c left join h on h.query_id = q.query_id and h.code = c.code left join k on k.query_id = q.query_id),
r as (select *, row_number() over (partition by query_id order by score desc, place) as position from s where score is not null)
select query_id, code, score::int as score, position::int as position from r where position <= 12""")
def sector_search(spark, d):
    """Queries of every kind (codes, words cut short, plurals, synonyms) against the catalogue: the best twelve of each."""
    k = F.col("p_partkey")
    part = load(spark, d, "part")
    code = F.concat(F.lpad((k % 97).cast("string"), 2, "0"), F.lit("."), F.lpad(k.cast("string"), 5, "0"), F.chr((k % 6 + 65).cast("int")))
    label = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit("s ("), "p_type", F.lit(")"))).when(k % 3 == 1, F.concat(F.lit(", "), "p_brand")).otherwise(""))
    catalogue = part.select(k.alias("place"), code.alias("code"), label.alias("label"))
    synonym = F.when(k % 4 == 0, F.concat(F.lit("atelier"), "p_size")).when(k % 4 == 1, F.concat(F.lit("shop "), "p_brand")).otherwise("machinery")
    synonyms = part.where(k % 10 == 0).select(synonym.alias("synonym"), code.alias("code"))
    s = F.col("s_suppkey")
    word = F.element_at(F.split("p_name", " "), 2)
    text = (
        F.when(s % 9 == 0, F.substring("p_name", 1, 3)).when(s % 9 == 1, F.upper("p_name")).when(s % 9 == 2, F.concat(word, F.lit("s "), F.lower("p_brand"))).when(s % 9 == 3, F.lpad((s % 97).cast("string"), 2, "0"))
        .when(s % 9 == 4, code).when(s % 9 == 5, F.concat(F.lit("atelier"), "p_size")).when(s % 9 == 6, "shop bra").when(s % 9 == 7, F.concat(F.substring("p_name", 1, 6), F.lit("zz nothing "), "p_type")).otherwise("x")
    )
    queries = load(spark, d, "supplier").join(part, s == k).select(s.alias("query_id"), text.alias("query"))
    return sector.search(queries, catalogue, synonyms)
