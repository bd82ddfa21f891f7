"""Quotas, cards of accounts, signups, and companies met with points of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotas
from ..operators.matching import match_points
from ..registry import query
from ..session import load

_NOW = "timestamp '2001-07-10 00:00:00'"
_USERS = """u as (select c_custkey as user_id, c_custkey % 50 = 7 as owner, case when c_custkey % 13 > 0 then c_custkey % 13 = 1 end as bypass, case c_custkey % 4 when 0 then 'converted' when 1 then 'active' when 2 then 'expired' end as trial_status,
 case c_custkey % 5 when 0 then 'croisiere' when 1 then 'activite' when 2 then '' when 3 then 'unknown' end as plan, case when c_custkey % 3 = 0 then 'active' else 'canceled' end as subscription_status from customer),
k as (select o_custkey as user_id, count(*) * 7 as used, max(o_orderdate) as last_reset from orders where o_orderkey % 3 > 0 group by 1)"""


def _users(spark, d):
    k = F.col("c_custkey")
    plan = F.when(k % 5 == 0, "croisiere").when(k % 5 == 1, "activite").when(k % 5 == 2, "").when(k % 5 == 3, "unknown")
    trial = F.when(k % 4 == 0, "converted").when(k % 4 == 1, "active").when(k % 4 == 2, "expired")
    return load(spark, d, "customer").select(k.alias("user_id"), (k % 50 == 7).alias("owner"), F.when(k % 13 > 0, k % 13 == 1).alias("bypass"), trial.alias("trial_status"), plan.alias("plan"), F.when(k % 3 == 0, "active").otherwise("canceled").alias("subscription_status"))


def _used(spark, d):
    return load(spark, d, "orders").where("o_orderkey % 3 > 0").groupBy(F.col("o_custkey").alias("user_id")).agg((F.count("*") * 7).alias("used"), F.max("o_orderdate").alias("last_reset"))


@query(f"""with {_USERS}, e as (select u.user_id, owner, k.used as stored, last_reset, k.user_id is not null as kept, case when coalesce(bypass, false) then 'croisiere' when trial_status = 'converted' then case when coalesce(plan, '') = '' then 'demarrage' else plan end else 'essai' end as plan from u left join k using (user_id)),
r as (select *, kept and plan <> 'essai' and last_reset < timestamp '2001-07-01' as reset, case when not owner then case plan when 'activite' then 60 when 'croisiere' then 120 else 30 end end as lead_limit from e),
x as (select *, case when reset then 0 else coalesce(stored, 0) end as used from r)
select user_id, plan, lead_limit, used, case when lead_limit is not null then greatest(lead_limit - used, 0) end as remaining, reset, coalesce(used >= lead_limit, false) as exhausted from x""")
def quota_with_reset(spark, d):
    """Plans that count, limits and counters in July: counters of paid plans from before begin anew, those of trials don't."""
    return quotas.quotas(_users(spark, d), _used(spark, d), F.expr(_NOW))


@query(f"""with {_USERS}, n as (select o_custkey as user_id, count(*) as cards from orders where o_orderstatus = 'F' group by 1), a as (select count(*) as accounts, count(*) filter (trial_status = 'active') as trials, count(*) filter (trial_status = 'converted') as converted, count(*) filter (subscription_status = 'active') as subscribers,
 count(*) filter (bypass) as guests, coalesce(sum(cards), 0)::bigint as cards, coalesce(sum(used), 0)::bigint as leads from u left join n using (user_id) left join k using (user_id) where not owner)
select *, case when accounts > 0 then floor(subscribers * 100.0 / accounts + 0.5)::bigint else 0 end as subscribers_pct from a""")
def account_kpis(spark, d):
    users = _users(spark, d).join(_used(spark, d), "user_id", "left")
    return quotas.account_cards(users, load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")))


@query(f"""with f as (select o_custkey, min(o_orderdate) as made from orders group by 1), w as (select (date_trunc('week', {_NOW}) - i * interval 7 day)::date as week, i = 0 as partial from range(12) t(i)), n as (select date_trunc('week', made)::date as week, count(*) as n from f group by 1)
select strftime(week, '%Y-%m-%d') as week, coalesce(n, 0) as signups, partial from w left join n using (week)""")
def signups_12_weeks(spark, d):
    """Customers by the week of their first order."""
    first = load(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("made"))
    return quotas.weekly_signups(first, "made", F.expr(_NOW)).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""
with c as (select c_custkey as siret, case when c_custkey % 10 = 0 then (c_custkey * 3)::varchar else '' end as number, 'dom' || c_custkey % 70 || '.fr' as dom, '06' || lpad((c_custkey % 90)::varchar, 8, '0') as tel, case when c_custkey % 2 = 0 then 'm' || c_custkey % 40 || '@x.fr' else '' end as mail, lower(c_mktsegment) || '|ville ' || c_nationkey as name, c_nationkey || '|rue bac|' || c_custkey % 30 as place from customer),
p as (select s_suppkey as osm_id, case when s_suppkey % 5 = 0 then (s_suppkey * 15)::varchar else '' end as number, 'dom' || s_suppkey % 70 || '.fr' as dom, '06' || lpad((s_suppkey % 90)::varchar, 8, '0') as tel, case when s_suppkey % 3 > 0 then 'm' || s_suppkey % 40 || '@x.fr' else '' end as mail,
 case s_suppkey % 3 when 0 then 'building' when 1 then 'furniture' else 'machinery' end || '|ville ' || s_nationkey as name, s_nationkey || '|rue bac|' || s_suppkey % 30 as place from supplier),
v as (select siret, osm_id, c.number <> '' and c.number = p.number as sure, (c.dom = p.dom)::int + (c.tel = p.tel)::int + (c.mail <> '' and c.mail = p.mail)::int + (c.name = p.name)::int + (c.place = p.place)::int as n from c, p),
r as (select *, row_number() over (partition by siret order by sure desc, n desc, osm_id) as k from v where sure or n >= 2)
select siret, osm_id, case when sure then 'certain' else 'presumed' end as level, n as n_signals from r where k = 1""")
def points_match(spark, d):
    """Companies and points that share numbers, domains, telephones, mails, names with towns, and addresses, in raw forms."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    tel = lambda n: F.lpad((n % 90).cast("string"), 8, "0")
    none = F.lit("")
    companies = load(spark, d, "customer").select(
        k.alias("id"), F.when(k % 10 == 0, F.concat(F.lit(" "), k * 3)).otherwise("").alias("siret"), none.alias("siren"), F.concat(F.lit("https://www.Dom"), k % 70, F.lit(".fr/x")).alias("website"), F.concat(F.lit("+33 6"), tel(k)).alias("societe_tel"), F.when(k % 2 == 0, F.concat(F.lit("M"), k % 40, F.lit("@x.fr "))).otherwise("").alias("societe_email"),
        F.concat("c_mktsegment", F.lit(" SARL")).alias("raison_sociale"), F.concat(F.lit("Ville-"), "c_nationkey").alias("ville"), F.col("c_nationkey").cast("string").alias("code_postal"), F.lit("R.").alias("type_voie"), F.lit("DU BAC").alias("libelle_voie"), (k % 30).cast("string").alias("numero_voie"),
    )
    nom = F.when(s % 3 == 0, "Building").when(s % 3 == 1, "Furniture").otherwise("Machinery")
    points = load(spark, d, "supplier").select(
        s.alias("osm_id"), F.when(s % 5 == 0, (s * 15).cast("string")).otherwise("").alias("siret"), none.alias("siren"), F.concat(F.lit("dom"), s % 70, F.lit(".fr")).alias("website"), F.concat(F.lit("06."), tel(s)).alias("phone"), F.when(s % 3 > 0, F.concat(F.lit("m"), s % 40, F.lit("@X.fr"))).otherwise("").alias("email"),
        nom.alias("nom"), F.concat(F.lit("VILLE "), "s_nationkey").alias("city"), F.col("s_nationkey").cast("string").alias("postcode"), F.lit("Rue du Bac").alias("street"), F.concat(s % 30, F.lit(" bis")).alias("housenumber"),
    )
    # a company's own id stands for it here, as most have no number
    told = match_points(companies.withColumn("siren", F.col("siret")).withColumn("siret", F.concat(F.lit("c"), "id")), points.withColumn("siren", F.col("siret")).withColumn("siret", none))
    return told.select(F.substring("siret", 2, 20).cast("bigint").alias("siret"), "osm_id", "level", "n_signals")
