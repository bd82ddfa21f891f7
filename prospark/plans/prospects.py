"""Prospect selection, enrichment, merging, purging and campaign queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import render
from ..functions.values import blank, department, first_filled
from ..operators.matching import points_in_boxes
from ..operators.rows import changed_fields, merge_fill, purge, without, without_hashed
from ..registry import query
from ..session import load

# Departments of each region.
REGIONS = {
    "11": "75 77 78 91 92 93 94 95", "24": "18 28 36 37 41 45", "27": "21 25 39 58 70 71 89 90", "28": "14 27 50 61 76",
    "32": "02 59 60 62 80", "44": "08 10 51 52 54 55 57 67 68 88", "52": "44 49 53 72 85", "53": "22 29 35 56",
    "75": "16 17 19 23 24 33 40 47 64 79 86 87", "76": "09 11 12 30 31 32 34 46 48 65 66 81 82",
    "84": "01 03 07 15 26 38 42 43 63 69 73 74", "93": "04 05 06 13 83 84", "94": "2A 2B",
}
# City codes with districts, and the first and last district code.
DISTRICTS = {"75056": (75101, 75120), "69123": (69381, 69389), "13055": (13201, 13216)}

LEADS_SQL = """leads as (select c_custkey as siret, c_custkey // 3 as siren, c_mktsegment as naf,
 lpad((c_custkey * 977 % 98000 + 1000)::varchar, 5, '0') as cp, case when c_custkey % 10 = 0 then 'C' else 'A' end as etat,
 case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then '' when c_custkey % 11 = 0 then 'F' else 'A' end as etat_local,
 case when c_custkey % 12 = 0 then 'P' when c_custkey % 25 = 0 then null else 'O' end as diffusion from customer)"""


def leads(spark, d: str) -> DataFrame:
    """Company rows made from customers, with closed, undisclosed and missing states."""
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(
        k.alias("siret"), F.expr("c_custkey div 3").alias("siren"), F.col("c_mktsegment").alias("naf"),
        F.lpad((k * 977 % 98000 + 1000).cast("string"), 5, "0").alias("cp"), F.when(k % 10 == 0, "C").otherwise("A").alias("etat"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, "").when(k % 11 == 0, "F").otherwise("A").alias("etat_local"),
        F.when(k % 12 == 0, "P").when(k % 25 == 0, None).otherwise("O").alias("diffusion"),
    )


def prospectable(df: DataFrame, allow_inactive: bool = False) -> DataFrame:
    """Active companies at an active address (the establishment's state, else the company's), fully disclosed."""
    active = (F.col("etat") == "A") & (F.when(blank("etat_local"), F.col("etat")).otherwise(F.trim("etat_local")) == "A")
    disclosed = F.coalesce(F.col("diffusion") == "O", F.lit(False))
    return df.where(disclosed if allow_inactive else disclosed & active)


@query("with " + LEADS_SQL + """
select siret, siren, naf, cp from leads where etat = 'A' and case when trim(coalesce(etat_local, '')) = '' then etat else trim(etat_local) end = 'A' and diffusion = 'O' and naf in ('BUILDING', 'MACHINERY')
and siret not in (select o_custkey from orders where o_orderkey % 40 = 0) and siren not in (select o_custkey from orders where o_orderkey % 90 = 0)""")
def lead_filter(spark, d):
    o = load(spark, d, "orders")
    owned = o.select(F.when(F.col("o_orderkey") % 40 == 0, F.col("o_custkey")).alias("siret_owned"), F.when(F.col("o_orderkey") % 90 == 0, F.col("o_custkey")).alias("siren_owned"))
    kept = prospectable(leads(spark, d)).where(F.col("naf").isin("BUILDING", "MACHINERY"))
    return without(kept, owned, [("siret", "siret_owned"), ("siren", "siren_owned")]).select("siret", "siren", "naf", "cp")


@query("""
with b as (select distinct sha256(o_custkey::varchar) as h from orders where o_orderkey % 50 = 0)
select c_custkey, c_name from customer where sha256(c_custkey::varchar) not in (select h from b) and sha256((c_custkey // 3)::varchar) not in (select h from b)""")
def optout_anti_join(spark, d):
    """Companies whose own or parent's hashed number is on the opt-out list are left out."""
    listed = load(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("h"))
    k = F.col("c_custkey").cast("string")
    return without_hashed(load(spark, d, "customer"), listed, "h", [k, F.expr("cast(c_custkey div 3 as string)")]).select("c_custkey", "c_name")


@query("""select distinct key from (select 'c' || o_custkey as key from orders where o_orderstatus = 'F' union all select 's' || l_suppkey from lineitem where l_returnflag = 'R')""")
def engaged_keys(spark, d):
    a = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), "o_custkey").alias("key"))
    b = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("key"))
    return a.union(b).distinct()


def region_table(spark) -> DataFrame:
    return spark.createDataFrame([(r, x) for r, ds in REGIONS.items() for x in ds.split()], "region string, dept string")


@query("with " + LEADS_SQL + ", r(region, dept) as (values " + ", ".join(f"('{r}', '{x}')" for r, ds in REGIONS.items() for x in ds.split()) + """),
c as (select *, case when cp[1:2] in ('97', '98') then cp[1:3] when cp[1:2] = '20' then case when cp < '20200' then '2A' else '2B' end else cp[1:2] end as dept from leads)
select region, c.dept, count(*) as n from c left join r on c.dept = r.dept group by 1, 2""")
def region_department_lookup(spark, d):
    c = leads(spark, d).withColumn("dept", department(F.col("cp")))
    return c.join(F.broadcast(region_table(spark)), "dept", "left").groupBy("region", "dept").agg(F.count("*").alias("n"))


@query("""with d(city, first, last) as (values """ + ", ".join(f"('{c}', {a}, {b})" for c, (a, b) in DISTRICTS.items()) + """), c as (select c_custkey, case c_custkey % 5 when 0 then ' 75056' when 1 then '69123' when 2 then '13055 ' when 3 then '44109' end as city from customer)
select c_custkey, (first + i)::varchar as district from c join d on trim(c.city) = d.city, range(30) r(i) where first + i <= last""")
def city_districts(spark, d):
    """The districts of the towns that customers ask for: a row each; other towns have none."""
    k = F.col("c_custkey") % 5
    asked = load(spark, d, "customer").select("c_custkey", F.when(k == 0, " 75056").when(k == 1, "69123").when(k == 2, "13055 ").when(k == 3, "44109").alias("city"))
    return with_districts(asked, "city").select("c_custkey", "district")


def with_districts(df, city: str):
    """df with a row for each district of its town's code, if that is one of those with districts."""
    code = F.trim(F.col(city))
    ends = F.coalesce(*(F.when(code == c, F.array(F.lit(a), F.lit(b))) for c, (a, b) in DISTRICTS.items()))
    return df.where(ends.isNotNull()).withColumn("district", F.explode(F.transform(F.sequence(ends[0], ends[1]), lambda x: x.cast("string"))))


@query("""
with b as (select nation.n_nationkey, n_nationkey * 3 - 40 as lat_min, n_nationkey * 3 - 34 as lat_max, n_nationkey * 5 - 60 as lng_min, n_nationkey * 5 - 45 as lng_max from nation)
select c_custkey, n_nationkey from customer, b where (c_custkey * 31 % 700) / 10.0 - 35 between lat_min and lat_max and (c_custkey * 17 % 1200) / 10.0 - 60 between lng_min and lng_max""")
def bbox_grid_join(spark, d):
    k = F.col("c_custkey")
    points = load(spark, d, "customer").select("c_custkey", ((k * 31 % 700) / 10 - 35).alias("lat"), ((k * 17 % 1200) / 10 - 60).alias("lng"))
    n = F.col("n_nationkey")
    boxes = load(spark, d, "nation").select("n_nationkey", (n * 3 - 40).alias("lat_min"), (n * 3 - 34).alias("lat_max"), (n * 5 - 60).alias("lng_min"), (n * 5 - 45).alias("lng_max"))
    return points_in_boxes(points, boxes).select("c_custkey", "n_nationkey")


@query("""
with s as (select s_suppkey, case when s_suppkey % 3 = 0 then null else 'w' end as site, case when s_suppkey % 4 < 2 then '' else 'l' end as linkedin, case when s_suppkey % 5 = 0 then null else 't' end as tel from supplier)
select * from (select s_suppkey, row_number() over (order by (case when coalesce(tel, '') <> '' then 1 else 0 end + case when coalesce(site, '') <> '' then 1 else 0 end) desc, coalesce(site, '') <> '' desc, coalesce(linkedin, '') <> '' desc, s_suppkey)::int as rank from s) where rank <= 100""")
def contact_rank(spark, d):
    """The hundred rows with the most complete contacts; ties by site, network page, then input order."""
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").select(k, F.when(k % 3 != 0, "w").alias("site"), F.when(k % 4 < 2, "").otherwise("l").alias("linkedin"), F.when(k % 5 != 0, "t").alias("tel"))
    filled = lambda c: F.when(blank(c), 0).otherwise(1)
    order = [F.desc(filled("tel") + filled("site")), F.desc(filled("site")), F.desc(filled("linkedin")), F.col("s_suppkey")]
    best = s.orderBy(*order).limit(100)  # bounded, so the numbering below sees a hundred rows
    from pyspark.sql import Window

    return best.select("s_suppkey", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _versions(spark, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    c = load(spark, d, "customer")
    old = c.where(k % 5 != 4).select(k.alias("id"), F.when(k % 7 == 0, None).when(k % 7 == 1, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    new = c.where(k % 3 != 2).select(k.alias("id"), F.concat(F.lit("new-"), "c_name").alias("name"), F.when(k % 6 != 0, F.lower("c_mktsegment")).alias("segment"))
    return old, new


_VERSIONS_SQL = """o as (select c_custkey as id, case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then '' else c_name end as name, case when c_custkey % 4 = 0 then '' else c_mktsegment end as segment from customer where c_custkey % 5 <> 4),
n as (select c_custkey as id, 'new-' || c_name as name, case when c_custkey % 6 <> 0 then lower(c_mktsegment) end as segment from customer where c_custkey % 3 <> 2)"""


@query("with " + _VERSIONS_SQL + """ select coalesce(o.id, n.id) as id, case when trim(coalesce(o.name, '')) = '' then n.name else o.name end as name, case when n.id is not null then n.segment else o.segment end as segment,
case when o.id is null then 'created' when n.id is not null then 'updated' else 'kept' end as action from o full join n on o.id = n.id""")
def fill_if_empty_merge(spark, d):
    old, new = _versions(spark, d)
    return merge_fill(old, new, "id", ["name"], ["segment"])


@query("with " + _VERSIONS_SQL + """, c as (select o.id, trim(coalesce(o.name, '')) <> trim(coalesce(n.name, '')) as a, trim(coalesce(o.segment, '')) <> trim(coalesce(n.segment, '')) as b from o join n on o.id = n.id)
select id, concat_ws(',', case when a then 'name' end, case when b then 'segment' end) as changed from c""")
def changed_field_sets(spark, d):
    old, new = _versions(spark, d)
    both = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"))
    return both.select(F.col("o.id").alias("id"), F.array_join(changed_fields("o", "n", ["name", "segment"]), ",").alias("changed"))


@query("with " + _VERSIONS_SQL + """ select case when o.id is null then 'created' when n.id % 8 = 0 then 'denied' when n.id is not null then 'updated' else 'kept' end as action, count(*) as n from o full join n on o.id = n.id group by 1""")
def upsert_action(spark, d):
    """Outcomes of an upsert that refuses rows of another owner."""
    old, new = _versions(spark, d)
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    action = F.when(F.col("o.id").isNull(), "created").when(F.col("n.id") % 8 == 0, "denied").when(F.col("n.id").isNotNull(), "updated").otherwise("kept")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""
with g as (select c_custkey as k from customer where c_custkey % 20 = 0)
select 'orders' as table_name, count(*) filter (o_custkey in (select k from g)) as n_deleted, count(*) filter (o_custkey not in (select k from g)) as n_kept from orders
union all select 'events', count(*) filter (user_id in (select k from g)), count(*) filter (user_id not in (select k from g)) from events""")
def cascade_delete_counts(spark, d):
    gone = load(spark, d, "customer").where("c_custkey % 20 = 0")
    _, counts = purge({"orders": (load(spark, d, "orders"), "o_custkey"), "events": (load(spark, d, "events"), "user_id")}, gone, "c_custkey")
    return counts


@query("""select c_custkey, coalesce(case when c_custkey % 4 = 0 then c_name end, case when c_custkey % 4 = 1 then 'n' || c_nationkey end, case when c_custkey % 4 = 2 then c_mktsegment end) as place, case c_custkey % 4 when 0 then 'declared' when 1 then 'geocoded' when 2 then 'signup' end as source from customer""")
def position_fallback(spark, d):
    """Declared place, else geocoded, else that of the signup, with its source."""
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select(k, F.when(k % 4 == 0, F.col("c_name")).alias("declared"), F.when(k % 4 == 1, F.concat(F.lit("n"), "c_nationkey")).alias("geocoded"), F.when(k % 4 == 2, F.col("c_mktsegment")).alias("signup"))
    names = ("declared", "geocoded", "signup")
    return c.select("c_custkey", F.coalesce(*names).alias("place"), F.coalesce(*(F.when(F.col(n).isNotNull(), n) for n in names)).alias("source"))


@query("""
with c as (select c_custkey, c_custkey % 31 = 0 as blocked, c_custkey % 17 = 0 as poor, case when c_custkey % 3 = 0 then c_name end as a, case when c_custkey % 4 = 0 then 'poi' else '' end as b, case when c_custkey % 5 = 0 then 'site' end as e from customer)
select case when blocked then 'refus_opposition' when poor then 'refus_quota' when coalesce(a, nullif(b, ''), e) is null then 'sans_resultat' else 'livre' end as outcome, case when not blocked and not poor then case when a is not null then 'reference' when b <> '' then 'poi' when e is not null then 'site' end end as source, count(*) as n from c group by 1, 2""")
def enrichment_waterfall(spark, d):
    """Ordered sources that fill what is missing, after opt-out and quota; the outcome is logged."""
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select((k % 31 == 0).alias("blocked"), (k % 17 == 0).alias("poor"), F.when(k % 3 == 0, F.col("c_name")).alias("reference"), F.when(k % 4 == 0, "poi").otherwise("").alias("poi"), F.when(k % 5 == 0, "site").alias("site"))
    names = ("reference", "poi", "site")
    source = F.coalesce(*(F.when(~blank(n), n) for n in names))
    outcome = F.when(F.col("blocked"), "refus_opposition").when(F.col("poor"), "refus_quota").when(first_filled(*names).isNull(), "sans_resultat").otherwise("livre")
    return c.groupBy(outcome.alias("outcome"), F.when(~F.col("blocked") & ~F.col("poor"), source).alias("source")).agg(F.count("*").alias("n"))


@query("""select c_custkey, ((c_custkey) // 100)::bigint as batch, 'Hello ' || c_name || ', ' || c_mktsegment || '.' as body from customer""")
def template_render(spark, d):
    """Mails rendered from a template, in batches of 100 by key range; unknown marks become nothing."""
    values = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")
    body = render(F.lit("Hello {{ name }}, {{segment}}{{ unknown }}."), values)
    return load(spark, d, "customer").select("c_custkey", F.expr("c_custkey div 100").alias("batch"), body.alias("body"))


@query("""
with e as (select 'b' || user_id as batch, event_type from events), c as (select c_custkey as campaign, unnest(['b' || c_custkey, 'b' || (2 * c_custkey + 1)]) as batch from customer)
select campaign, event_type, count(*) as n from e join c using (batch) group by 1, 2""")
def campaign_event_attach(spark, d):
    """Delivery events find their campaign by batch id; events of no campaign are dropped."""
    e = load(spark, d, "events").select(F.concat(F.lit("b"), "user_id").alias("batch"), "event_type")
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("campaign"), F.explode(F.array(F.concat(F.lit("b"), "c_custkey"), F.concat(F.lit("b"), 2 * F.col("c_custkey") + 1))).alias("batch"))
    return e.join(c, "batch").groupBy("campaign", "event_type").agg(F.count("*").alias("n"))


@query("""select l_orderkey, count(*) as lines, min(l_partkey) as least_part, string_agg(distinct l_returnflag, '' order by l_returnflag) as flags from lineitem group by 1""")
def array_length_stats(spark, d):
    nested = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_returnflag")).alias("items"))
    return nested.select("l_orderkey", F.size("items").cast("bigint").alias("lines"), F.array_min("items.l_partkey").alias("least_part"), F.array_join(F.array_sort(F.array_distinct("items.l_returnflag")), "").alias("flags"))


@query("""
with f as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), l as (select o_custkey, min(n) as n from f where o_orderstatus = 'F' group by 1)
select f.o_custkey, coalesce(max(f.o_orderkey) filter (f.n = l.n), max(f.o_orderkey) filter (f.n = 1)) as picked, any_value(l.n is not null) as is_local, count(*) as places from f left join l on f.o_custkey = l.o_custkey group by 1""")
def flatten_reference(spark, d):
    """From nested establishments: the first local one in order, else the seat (the first)."""
    local = F.col("o_orderstatus") == "F"
    picked = F.coalesce(F.min(F.when(local, F.col("o_orderkey"))), F.min("o_orderkey"))
    return load(spark, d, "orders").groupBy("o_custkey").agg(picked.alias("picked"), (F.count_if(local) > 0).alias("is_local"), F.count("*").alias("places"))


@query("""with l(code, label) as (values ('ECONOMY', 'Economy form'), ('STANDARD', 'Standard form')) select p_partkey, coalesce(label, p_type) as label from part left join l on code = p_type""")
def legal_form_lookup(spark, d):
    """Labels of codes from a table given as parameter; an unknown code stands for itself."""
    labels = spark.createDataFrame([("ECONOMY", "Economy form"), ("STANDARD", "Standard form")], "code string, label string")
    p = load(spark, d, "part")
    return p.join(F.broadcast(labels), p.p_type == labels.code, "left").select("p_partkey", F.coalesce("label", "p_type").alias("label"))


@query("""
with c as (select c_custkey, c_mktsegment, case when c_custkey % 3 = 0 then null else 'x' end as tel, case when c_custkey % 4 = 0 then '' else 'y' end as mail from customer)
select c_mktsegment, count(*) as total, count(*) filter (coalesce(tel, '') <> '') as tel, count(*) filter (coalesce(mail, '') <> '') as mail, count(*) filter (coalesce(tel, '') <> '' and coalesce(mail, '') <> '') as both_, count(*) filter (coalesce(tel, '') <> '' or coalesce(mail, '') <> '') as any_ from c group by 1 order by any_ desc, total desc, c_mktsegment limit 20""")
def fill_rate_by_group(spark, d):
    """Fill rates of contact fields in one pass; the twenty best groups."""
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select("c_mktsegment", (k % 3 != 0).alias("t"), (k % 4 != 0).alias("m"))
    out = c.groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if("t").alias("tel"), F.count_if("m").alias("mail"), F.count_if(F.col("t") & F.col("m")).alias("both_"), F.count_if(F.col("t") | F.col("m")).alias("any_"))
    return out.orderBy(F.desc("any_"), F.desc("total"), "c_mktsegment").limit(20)
