"""Listings, predicates, imports, opt-outs, claims and rates of the CRM operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import department
from ..operators import crm
from ..registry import query
from ..session import load

_NOW_SQL = "timestamp '1998-01-01 00:00:00'"
_CARDS_SQL = """cards as (select o_orderkey as id, o_custkey as user_id, o_orderpriority as naf, o_orderdate as made, o_totalprice as price,
 case o_orderkey % 7 when 0 then 'deleted' when 1 then null else o_orderstatus end as status, case when o_orderkey % 3 = 0 then o_orderdate end as sent,
 case when o_orderkey % 4 > 0 then 'site' || o_orderkey end as site, case when o_orderkey % 5 > 1 then 't' || o_orderkey else ' ' end as tel, case when o_orderkey % 6 > 0 then 'm' || o_orderkey end as mail from orders)"""


def _now():
    return F.expr(_NOW_SQL)


def _cards(spark, d):
    k = F.col("o_orderkey")
    named = lambda c, m, least: F.when(k % m > least, F.concat(F.lit(c), k))
    status = F.when(k % 7 == 0, "deleted").when(k % 7 == 1, None).otherwise(F.col("o_orderstatus"))
    return load(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("naf"), F.col("o_orderdate").alias("made"), F.col("o_totalprice").alias("price"), status.alias("status"),
        F.when(k % 3 == 0, F.col("o_orderdate")).alias("sent"), named("site", 4, 0).alias("site"), F.coalesce(named("t", 5, 1), F.lit(" ")).alias("tel"), named("m", 6, 0).alias("mail"),
    )


@query(f"with {_CARDS_SQL} select id, made from cards where made > {_NOW_SQL} - interval 30 day")
def fresh_rows(spark, d):
    return _cards(spark, d).where(crm.fresh(F.col("made"), _now())).select("id", "made")


@query(f"with {_CARDS_SQL} select id from cards where user_id::varchar = '7' and replace(naf, '.', '') = '2-HIGH' and made > {_NOW_SQL} - interval 30 day")
def scope_filter(spark, d):
    rows = _cards(spark, d).withColumns({"dept": F.col("user_id").cast("string"), "refreshed_at": F.col("made")})
    return rows.where(crm.scope("7", "2-HI.GH", now=_now())).select("id")


@query(f"with {_CARDS_SQL} select id from cards where site is not null and (trim(tel) = '' or mail is null) and (sent is null or sent < {_NOW_SQL} - interval 30 day)")
def crawl_candidates(spark, d):
    return _cards(spark, d).where(crm.to_crawl(F.col("site"), F.col("tel"), F.col("mail"), F.col("sent"), _now())).select("id")


@query(f"with {_CARDS_SQL} select id from cards where made >= {_NOW_SQL} - interval 90 day and made < {_NOW_SQL} and sent is null")
def due_unsent(spark, d):
    return _cards(spark, d).where(crm.due(F.col("made"), _now() - F.expr("interval 90 days"), _now(), F.col("sent"))).select("id")


@query(f"with {_CARDS_SQL} select coalesce(status, '') as status, count(*) as n from cards where coalesce(status, '') <> 'deleted' group by 1")
def visible_rows(spark, d):
    return _cards(spark, d).where(crm.visible(F.col("status"))).groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name from customer")
def stripped_secrets(spark, d):
    return crm.without_secrets(load(spark, d, "customer").select("c_custkey", "c_name", F.lit("x").alias("password_hash"), F.lit("y").alias("apiToken")))


@query(f"with {_CARDS_SQL} select case when id % 11 > 0 then id end as id, case when id % 11 > 0 and id % 2 = 0 then mail end as mail, id % 11 = 0 as hidden from cards")
def entitled_fields(spark, d):
    return crm.entitled(_cards(spark, d), ["id"], ["mail"], F.col("id") % 2 == 0, F.col("id") % 11 == 0)


@query("""with u as (select page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as origin from pages),
k as (select *, row_number() over (partition by origin order by page_id) as n from u where origin <> '' and origin <> 'example.net' and not ends_with(origin, '.example.net')) select page_id, url, origin from k where n = 1""")
def allowed_hosts(spark, d):
    return crm.allowed_hosts(load(spark, d, "pages").select("page_id", "url"), "url", ["example.net"], ["page_id"])


@query(f"with {_CARDS_SQL} select id, made from cards where user_id = 7 and coalesce(status, '') = 'F' order by made desc, id")
def user_listing(spark, d):
    rows = _cards(spark, d).withColumn("status", F.coalesce("status", F.lit("")))
    return crm.listing(rows, "user_id", F.lit(7), [F.desc("made"), F.asc("id")], ("status", F.lit("F"))).select("id", "made")


@query(f"""with {_CARDS_SQL}, r as (select user_id, id, count(*) over (partition by user_id) as total, row_number() over (partition by user_id order by made desc, id) as position from cards)
select * from r where position > 2 and position <= 7""")
def paged_history(spark, d):
    return crm.paged(_cards(spark, d), ["user_id"], [F.desc("made"), F.asc("id")], 5, 2).select("user_id", "id", "total", "position")


@query(f"with {_CARDS_SQL}, r as (select id, row_number() over (order by price desc, id) as position from cards) select id, position, case when position <= 5 then 'shown' else 'marker' end as kind from r where position <= 50")
def search_preview(spark, d):
    return crm.preview(_cards(spark, d), [F.desc("price"), F.asc("id")], 5, 50).select("id", "position", "kind")


_KEY = "regexp_replace(trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g')), '((^| )(sarl|sasu|eurl|sas|sci|sa|sl|paris))+$', '')"
_PEOPLE_SQL = f"""old as (select c_custkey as id, case when c_custkey % 3 > 0 then 'p' || (c_custkey % 900) || '@x.org' end as email, 'n' || (c_custkey % 400) as name, c_mktsegment as company, case when c_custkey % 2 = 0 then 'tel' || c_custkey else '' end as tel, case when c_custkey % 5 = 0 then ' ' else 'job' end as poste from customer),
new as (select s_suppkey as row_id, case when s_suppkey % 3 = 0 then ' P' || (s_suppkey % 40 * 7) || '@X.org' when s_suppkey % 7 = 0 then ' ' end as email, case s_suppkey % 4 when 0 then 'N-' else 'n' end || (s_suppkey % 60 * 3) as name, case s_suppkey % 3 when 1 then 'furniture SARL' when 2 then 'Bâtiment ' || s_suppkey % 2 end as company, case when s_suppkey % 4 > 0 then 'new' || s_suppkey end as tel, case when s_suppkey % 6 = 0 then 'chef' || s_suppkey else ' ' end as poste from supplier),
keyed as (select *, case when trim(coalesce(email, '')) <> '' then lower(trim(email)) else '' end as mail from new),
grouped as (select mail, case when mail = '' then {_KEY.format("name")} else '' end as n, case when mail = '' then {_KEY.format("company")} else '' end as c, min(row_id) as row_id, count(*) as rows,
 min_by(tel, row_id) filter (trim(tel) <> '') as tel, min_by(poste, row_id) filter (trim(poste) <> '') as poste from keyed group by 1, 2, 3),
m as (select lower(trim(email)) as mail, min(id) as mail_id from old where trim(email) <> '' group by 1), k as (select {_KEY.format("name")} as n, {_KEY.format("company")} as c, min(id) as name_id from old group by 1, 2)"""


@query(f"""with {_PEOPLE_SQL}, f as (select g.*, mail_id, name_id, coalesce(mail_id, name_id) as found from grouped g left join m on g.mail <> '' and g.mail = m.mail left join k on g.mail = '' and g.n = k.n and g.c = k.c and k.n <> '')
select row_id, rows, found as id, case when mail_id is not null then 'by mail' when name_id is not null then 'by name' else 'created' end as outcome,
 case when trim(coalesce(old.tel, '')) <> '' then old.tel else f.tel end as tel, case when trim(coalesce(old.poste, '')) <> '' then old.poste else f.poste end as poste from f left join old on old.id = found""")
def import_people(spark, d):
    """A file with repeated people: by mail or not at all where there is one, by the keys of name and company where not."""
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    old = load(spark, d, "customer").select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("p"), k % 900, F.lit("@x.org"))).alias("email"), F.concat(F.lit("n"), k % 400).alias("name"), F.col("c_mktsegment").alias("company"), F.when(k % 2 == 0, F.concat(F.lit("tel"), k)).otherwise("").alias("tel"), F.when(k % 5 == 0, " ").otherwise("job").alias("poste"))
    mail = F.when(j % 3 == 0, F.concat(F.lit(" P"), j % 40 * 7, F.lit("@X.org"))).when(j % 7 == 0, " ")
    name = F.concat(F.when(j % 4 == 0, "N-").otherwise("n"), j % 60 * 3)
    company = F.when(j % 3 == 1, "furniture SARL").when(j % 3 == 2, F.concat(F.lit("Bâtiment "), j % 2))
    new = load(spark, d, "supplier").select(j.alias("row_id"), mail.alias("email"), name.alias("name"), company.alias("company"), F.when(j % 4 > 0, F.concat(F.lit("new"), j)).alias("tel"), F.when(j % 6 == 0, F.concat(F.lit("chef"), j)).otherwise(" ").alias("poste"))
    return crm.import_people(old, new, ["tel", "poste"])


@query("""with t as (select c_custkey as id, 'old' as site, case when c_custkey % 2 = 0 then 'm' || c_custkey end as mail from customer), s as (select s_suppkey as id, case when s_suppkey % 3 > 0 then 's' || s_suppkey else ' ' end as web, 'm' || (s_suppkey * (s_suppkey % 2)) as mail2 from supplier)
select t.id, case when trim(coalesce(web, '')) <> '' then web else site end as site, coalesce(mail2, mail) as mail, s.id is not null and (trim(web) <> '' or mail2 <> coalesce(mail, '')) as changed from t left join s using (id)""")
def propagated_fields(spark, d):
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    t = load(spark, d, "customer").select(k.alias("id"), F.lit("old").alias("site"), F.when(k % 2 == 0, F.concat(F.lit("m"), k)).alias("mail"))
    s = load(spark, d, "supplier").select(j.alias("id"), F.when(j % 3 > 0, F.concat(F.lit("s"), j)).otherwise(" ").alias("web"), F.concat(F.lit("m"), j * (j % 2)).alias("mail2"))
    return crm.propagate(t, s, ["id"], {"web": "site", "mail2": "mail"})


@query("select c_nationkey::varchar || c_mktsegment as domain, min(c_custkey) as c_custkey from customer group by 1 having min(c_custkey) = max(c_custkey)")
def domain_single_owner(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("domain"))
    return crm.single_owner(c, "domain", "c_custkey")


@query(f"""select c_custkey as id, case when c_custkey % 4 = 3 then 'unknown' when c_custkey % 3 = 0 then 'used' when c_custkey % 5 = 0 then 'expired' else 'verified' end as answer from customer""")
def optout_verify(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer")
    token = F.concat(F.lit("tok"), k)
    requests = c.where(k % 4 < 3).select(F.sha2(token, 256).alias("token_hash"), F.when(k % 3 == 0, "done").otherwise("pending").alias("status"), F.when(k % 5 == 0, _now() - F.expr("interval 1 hour")).otherwise(_now() + F.expr("interval 1 hour")).alias("expires_at"))
    return crm.verify_optouts(requests, c.select(k.alias("id"), token.alias("token")), _now()).select("id", "answer")


@query(f"""with r as (select sha256('s' || c_custkey) as h, {_NOW_SQL} - (c_custkey % 120) * interval 1 minute as made from customer where c_custkey % 2 = 0), n as (select distinct sha256('s' || c_custkey) as subject_hash from customer),
k as (select h, max(made) as made from r where made > {_NOW_SQL} - interval 1 hour group by 1) select subject_hash, made is not null as reused, coalesce(made, {_NOW_SQL}) as created_at, coalesce(made, {_NOW_SQL}) + interval 24 hour as expires_at from n left join k on h = subject_hash""")
def optout_request(spark, d):
    k = F.col("c_custkey")
    c = load(spark, d, "customer")
    requests = c.where(k % 2 == 0).select(F.sha2(F.concat(F.lit("s"), k), 256).alias("subject_hash"), F.lit("pending").alias("status"), (_now() - F.make_dt_interval(mins=(k % 120).cast("int"))).alias("created_at"))
    return crm.request_optouts(requests, c.select(F.concat(F.lit(" S"), k).alias("subject")), _now())


@query(f"with {_CARDS_SQL} select naf, (user_id % 90)::varchar as dept, count(*) as rows, count(site) as n_site, count(*) filter (trim(tel) <> '') as n_tel, count(mail) as n_mail from cards group by 1, 2")
def fill_rates_by_key(spark, d):
    return crm.fill_rates(_cards(spark, d), [F.col("naf"), (F.col("user_id") % 90).cast("string").alias("dept")], ["site", "tel", "mail"])


@query(f"with {_CARDS_SQL} select naf, count(*) as n, max(made) as completed_at from cards group by 1")
def completion_markers(spark, d):
    return crm.completed(_cards(spark, d), [F.col("naf")], "made")


@query("select c_custkey, case when c_custkey % 3 = 2 and c_custkey % 4 < 2 or c_custkey % 3 = 1 and c_custkey % 4 = 0 then case c_custkey % 3 when 1 then 'contact' else 'pro' end else case c_custkey % 4 when 0 then 'reserve' when 1 then 'contact' else 'pro' end end as status from customer")
def raised_status(spark, d):
    k = F.col("c_custkey")
    new = F.when(k % 3 == 0, "reserve").when(k % 3 == 1, "contact").otherwise("pro")
    old = F.when(k % 4 == 0, "reserve").when(k % 4 == 1, "contact").otherwise("pro")
    return load(spark, d, "customer").select("c_custkey", crm.raised(old, new, ["reserve", "contact", "pro"]).alias("status"))


@query("select c_custkey, case when c_custkey % 4 = 0 then c_name else c_mktsegment || '|' || c_name end as list from customer")
def distinct_lists(spark, d):
    values = F.when(F.col("c_custkey") % 4 > 0, F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit(""), F.col("c_name"), F.col("c_mktsegment")))
    return load(spark, d, "customer").select("c_custkey", F.array_join(crm.distinct_list(values, F.col("c_name")), "|").alias("list"))


@query(f"with {_CARDS_SQL} select id, case when sent is null then {_NOW_SQL} else sent end as sent, sent is null as claimed from cards")
def claimed_rows(spark, d):
    return crm.claim(_cards(spark, d), "sent", F.col("sent").isNull(), _now()).select("id", "sent", "claimed")


@query(f"with {_CARDS_SQL} select count(*) filter (status = 'O' and made < {_NOW_SQL}) as n_changed from cards")
def expired_states(spark, d):
    return crm.flip(_cards(spark, d), "status", (F.col("status") == "O") & (F.col("made") < _now()), "expired")[1]


@query("select l_orderkey as id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::int as number, l_linenumber from lineitem")
def unfolded_rows(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    nested = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("items"))  # an order's lines are few
    return crm.unfold(nested, "id", "items", ["l_linenumber"])


@query("""select c_custkey, case c_custkey % 3 when 0 then 'Ann ' || c_name when 1 then 'Ann ' || c_name || ',Bo X' else '' end as names from customer""")
def manager_names(spark, d):
    k = F.col("c_custkey")
    one = lambda kind, given, family: F.struct(F.lit(kind).alias("kind"), F.lit(given).alias("given"), family.alias("family"))
    name, company = F.col("c_name"), one("company", "Ann", F.lit("Co"))
    people = F.when(k % 3 == 0, F.array(one("natural", "Ann Mary", name), company, one("natural", "ANN", name))).when(k % 3 == 1, F.array(one("natural", "Ann", name), one("natural", "Bo B", F.lit("X")))).otherwise(F.array(company))
    return load(spark, d, "customer").select("c_custkey", F.array_join(F.transform(crm.managers(people), lambda p: F.concat_ws(" ", p.given, p.family)), ",").alias("names"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'a' || c_custkey || '|b' else 'b|a' end as emails, c_custkey % 3 = 0 as consent from customer""")
def person_records(spark, d):
    k = F.col("c_custkey")
    empty = F.array().cast("array<string>")
    people = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit(" a"), k)).alias("email"), F.when(k % 2 == 0, F.array(F.lit("b"), F.concat(F.lit("a"), k))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("emails"), F.lit(None).cast("string").alias("phone"), empty.alias("phones"), F.when(k % 3 == 0, "oui").when(k % 3 == 1, "no").alias("consent"))
    return crm.person(people).select("c_custkey", F.array_join("emails", "|").alias("emails"), "consent")


@query(f"with {_CARDS_SQL} select count(*) as rows, count(*) filter (id % 6 = 0 and id % 4 = 0) as remaining from cards")
def backfill_remaining(spark, d):
    return crm.backfill(_cards(spark, d), "mail", F.col("site"))[1]


@query("select o_orderkey, make_timestamp((o_orderkey * 100000)::bigint * 1000000) as made from orders")
def epoch_times(spark, d):
    return load(spark, d, "orders").select("o_orderkey", crm.from_epoch(F.col("o_orderkey") * 100000).alias("made"))


@query("""select o_orderkey, case when day(o_orderdate) = 1 then '1er' else day(o_orderdate)::varchar end || ' ' || (['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'])[month(o_orderdate)] || ' ' || year(o_orderdate) as day from orders""")
def french_dates(spark, d):
    return load(spark, d, "orders").select("o_orderkey", crm.french_date(F.col("o_orderdate")).alias("day"))


@query("select c_custkey, 'Jean ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as name from customer")
def slug_names(spark, d):
    url = F.concat(F.lit("https://www.linkedin.com/in/Jean-"), "c_mktsegment", F.lit("-4a1b"), F.col("c_custkey"), F.lit("/?x=1"))
    return load(spark, d, "customer").select("c_custkey", crm.name_of_slug(url).alias("name"))


@query("select c_custkey, case when c_custkey % 2 = 0 then lpad((c_custkey % 95000)::varchar, 5, '0') else '' end as postcode, case when c_custkey % 2 = 0 and c_custkey % 95000 >= 20000 and c_custkey % 95000 < 21000 then case when lpad((c_custkey % 95000)::varchar, 5, '0') < '20200' then '2A' else '2B' end when c_custkey % 2 = 0 then lpad((c_custkey % 95000)::varchar, 5, '0')[1:2] else '' end as dept, c_mktsegment as town from customer")
def split_towns(spark, d):
    k = F.col("c_custkey")
    cell = F.when(k % 2 == 0, F.concat_ws(" ", F.lpad((k % 95000).cast("string"), 5, "0"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", crm.split_town(cell).alias("x")).select("c_custkey", "x.postcode", department(F.col("x.postcode")).alias("dept"), "x.town")


@query("""select user_id, table_name, count(*) as n, sum(k) as total from (select c_custkey as user_id, 'customer' as table_name, c_custkey as k from customer union all select o_custkey, 'orders', o_orderkey from orders) group by 1, 2""")
def user_export(spark, d):
    out = crm.export_user({"customer": (load(spark, d, "customer"), "c_custkey"), "orders": (load(spark, d, "orders"), "o_custkey")}, "user_id")
    key = F.coalesce(F.get_json_object("document", "$.o_orderkey"), F.get_json_object("document", "$.c_custkey")).cast("bigint")
    return out.groupBy("user_id", "table_name").agg(F.count("*").alias("n"), F.sum(key).alias("total"))


@query("""with s as (select l_orderkey, sum(floor((l_quantity * l_discount + 2.220446049250313e-16) * 100 + 0.5))::bigint as net from lineitem group by 1),
q as (select o_orderkey as quote_id, o_custkey as user_id, case when o_orderkey % 2 = 0 then o_orderstatus else o_orderpriority end as client, coalesce(net, 0) as net, row_number() over (partition by o_custkey order by o_orderkey) as n from orders left join s on l_orderkey = o_orderkey)
select quote_id, user_id, 'FA-1998-' || lpad(n::varchar, 4, '0') as number, client, net, ((net * 20 + 50) // 100)::bigint as vat, net + ((net * 20 + 50) // 100)::bigint as total from q""")
def invoice_from_quote(spark, d):
    k = F.col("o_orderkey")
    quotes = load(spark, d, "orders").select(k.alias("quote_id"), F.col("o_custkey").alias("user_id"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("name"), F.col("o_orderpriority").alias("company"))
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("quote_id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("price"))
    return crm.from_quote(quotes, lines, F.lit(1998), "FA", 20, ["name", "company"])
