"""Accounts, quotas, lifecycle, documents and money queries, on customers and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import cents, first_filled, percent
from ..operators.purge import Rule, purge
from ..operators.rows import page
from ..registry import query
from ..session import load

def _now():
    return F.expr("timestamp '2001-07-01 00:00:00'")

USERS_SQL = """users as (select c_custkey as user_id,
 case when c_custkey % 9 = 0 then null when c_custkey % 9 < 4 then 'active' when c_custkey % 9 < 6 then 'expired' else 'converted' end as trial_status,
 case when c_custkey % 5 = 0 then 'canceled' when c_custkey % 5 = 1 then 'past_due' when c_custkey % 5 = 2 then 'active' end as subscription_status,
 c_custkey % 13 = 0 as bypass,
 case when c_custkey % 6 = 0 then null else timestamp '2001-07-01' + ((c_custkey * 37 % 80) - 45) * interval 1 day end as trial_ends_at,
 case when c_custkey % 4 = 0 then null else timestamp '2001-07-01' + ((c_custkey * 53 % 90) - 60) * interval 1 day end as current_period_end,
 case when c_custkey % 3 = 0 then null else timestamp '2001-07-01' - (c_custkey * 7 % 30) * interval 1 day end as past_due_since,
 case when c_custkey % 8 < 5 then null else timestamp '2001-07-01' - (c_custkey * 11 % 20) * interval 1 day end as warned_at from customer)"""


def users(spark, d: str) -> DataFrame:
    """Account states made from customers: the driver tables have no such columns and no missing values."""
    k = F.col("c_custkey")
    shift = lambda days: F.expr("timestamp '2001-07-01 00:00:00'") + F.make_dt_interval(days.cast("int"))
    return load(spark, d, "customer").select(
        k.alias("user_id"),
        F.when(k % 9 == 0, None).when(k % 9 < 4, "active").when(k % 9 < 6, "expired").otherwise("converted").alias("trial_status"),
        F.when(k % 5 == 0, "canceled").when(k % 5 == 1, "past_due").when(k % 5 == 2, "active").alias("subscription_status"),
        (k % 13 == 0).alias("bypass"),
        F.when(k % 6 != 0, shift(k * 37 % 80 - 45)).alias("trial_ends_at"),
        F.when(k % 4 != 0, shift(k * 53 % 90 - 60)).alias("current_period_end"),
        F.when(k % 3 != 0, shift(-(k * 7 % 30))).alias("past_due_since"),
        F.when(k % 8 >= 5, shift(-(k * 11 % 20))).alias("warned_at"),
    )


def _after(ts: str, days: int):
    return F.col(ts) + F.make_dt_interval(F.lit(days))


@query("with " + USERS_SQL + """
select user_id, case when bypass then 'active'
 when subscription_status = 'canceled' then case when current_period_end is null or timestamp '2001-07-01' < current_period_end + interval 7 day then 'grace_active' else 'grace_expired' end
 when subscription_status = 'past_due' and past_due_since is not null and timestamp '2001-07-01' >= past_due_since + interval 14 day then 'past_due_locked'
 when trial_status = 'converted' then 'active' when trial_status = 'expired' then 'trial_expired'
 when trial_status = 'active' and trial_ends_at < timestamp '2001-07-01' then 'trial_expired' else 'trial_active' end as state from users""")
def app_state(spark, d):
    """Free accounts, then grace after a cancellation, unpaid locks, subscribers, and trials; doubt never locks out."""
    grace = F.when(F.col("current_period_end").isNull() | (_now() < _after("current_period_end", 7)), "grace_active").otherwise("grace_expired")
    state = (
        F.when(F.col("bypass"), "active")
        .when(F.col("subscription_status") == "canceled", grace)
        .when((F.col("subscription_status") == "past_due") & (_now() >= _after("past_due_since", 14)), "past_due_locked")
        .when(F.col("trial_status") == "converted", "active")
        .when(F.col("trial_status") == "expired", "trial_expired")
        .when((F.col("trial_status") == "active") & (F.col("trial_ends_at") < _now()), "trial_expired")
        .otherwise("trial_active")
    )
    return users(spark, d).select("user_id", state.alias("state"))


_DUE = {
    "trial_j2": ("trial_status = 'active'", "trial_ends_at", -2),
    "trial_j0": ("trial_status = 'active'", "trial_ends_at", 0),
    "grace_j1": ("subscription_status = 'canceled'", "current_period_end", 6),
    "purge_warning": ("subscription_status is null and trial_status in ('active', 'expired') and warned_at is null and not bypass", "trial_ends_at", 23),
    "purge": ("subscription_status = 'canceled'", "current_period_end", 37),
}


@query("with " + USERS_SQL + " " + " union all ".join(f"select '{n}' as step, count(*) as due from users where {w} and {c} + interval '{k}' day > timestamp '2001-07-01' and {c} + interval '{k}' day <= timestamp '2001-07-08'" for n, (w, c, k) in _DUE.items()) + """
 union all select 'purge_trial', count(*) from users where subscription_status is null and coalesce(trial_status, '') <> 'converted' and not bypass and trial_ends_at is not null and warned_at is not null
 and greatest(trial_ends_at + interval 30 day, warned_at + interval 7 day) > timestamp '2001-07-01' and greatest(trial_ends_at + interval 30 day, warned_at + interval 7 day) <= timestamp '2001-07-08'""")
def lifecycle_windows(spark, d):
    """Accounts due within seven days at each lifecycle step, in one pass; the last step waits for the later of two dates."""
    week = lambda at: (at > _now()) & (at <= _now() + F.expr("interval 7 days"))
    later = F.when(F.col("trial_ends_at").isNotNull() & F.col("warned_at").isNotNull(), F.greatest(_after("trial_ends_at", 30), _after("warned_at", 7)))
    steps = {n: F.expr(w) & week(_after(c, k)) for n, (w, c, k) in _DUE.items()}
    steps["purge_trial"] = F.expr("subscription_status is null and coalesce(trial_status, '') != 'converted' and not bypass") & week(later)
    counts = users(spark, d).agg(*(F.count_if(c).alias(n) for n, c in steps.items()))
    return counts.unpivot([], list(steps), "step", "due")


@query("with " + USERS_SQL + """
select user_id, case when subscription_status = 'canceled' then 'account' else 'trial' end as kind from users
where (subscription_status = 'canceled' and current_period_end + interval 37 day < timestamp '2001-07-01')
 or (subscription_status is null and coalesce(trial_status, '') <> 'converted' and not bypass and trial_ends_at + interval 30 day < timestamp '2001-07-01' and warned_at + interval 7 day < timestamp '2001-07-01')""")
def purge_candidates(spark, d):
    canceled = F.expr("subscription_status = 'canceled'") & (_after("current_period_end", 37) < _now())
    trial = F.expr("subscription_status is null and coalesce(trial_status, '') != 'converted' and not bypass") & (_after("trial_ends_at", 30) < _now()) & (_after("warned_at", 7) < _now())
    return users(spark, d).where(canceled | trial).select("user_id", F.when(F.col("subscription_status") == "canceled", "account").otherwise("trial").alias("kind"))


@query("with " + USERS_SQL + """
select user_id, case when bypass then 'croisiere' when trial_status = 'converted' then case user_id % 4 when 0 then 'demarrage' when 1 then 'activite' else 'croisiere' end else 'essai' end as plan from users""")
def effective_plan(spark, d):
    chosen = F.when(F.col("user_id") % 4 == 0, "demarrage").when(F.col("user_id") % 4 == 1, "activite").otherwise("croisiere")
    return users(spark, d).select("user_id", F.when(F.col("bypass"), "croisiere").when(F.col("trial_status") == "converted", chosen).otherwise("essai").alias("plan"))


@query("""
with u as (select count(*) as accounts, count(*) filter (c_custkey % 9 >= 6) as converted, count(*) filter (c_custkey % 9 between 1 and 3) as trials, count(*) filter (c_custkey % 13 = 0) as vip from customer where c_custkey <> 1),
o as (select count(*) as cards from orders where o_custkey <> 1)
select accounts, converted, trials, vip, cards, case when accounts > 0 then floor((converted * 200 + accounts) / (accounts * 2)) else 0 end::bigint as converted_percent from u, o""")
def kpi_cards(spark, d):
    """Account figures without the owner's account, percentages rounded and safe for no accounts."""
    k = F.col("c_custkey")
    u = load(spark, d, "customer").where(k != 1).agg(F.count("*").alias("accounts"), F.count_if(k % 9 >= 6).alias("converted"), F.count_if((k % 9).between(1, 3)).alias("trials"), F.count_if(k % 13 == 0).alias("vip"))
    o = load(spark, d, "orders").where("o_custkey != 1").agg(F.count("*").alias("cards"))
    return u.join(F.broadcast(o)).withColumn("converted_percent", percent(F.col("converted"), F.col("accounts")))


@query("""
with o as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as done, strftime(max(o_orderdate), '%Y-%m-%d') as last from orders group by 1)
select c_custkey, c_name, coalesce(n, 0) as leads, coalesce(done, 0) as done, last from customer left join o on o_custkey = c_custkey""")
def account_list(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    o = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("leads"), F.coalesce("done", F.lit(0)).alias("done"), "last")


@query("""
with a as (select o_custkey as id, max(o_orderdate) filter (o_orderstatus = 'O') as open_, max(o_orderdate) filter (o_orderstatus = 'F') as filled, max(o_orderdate) filter (o_orderstatus = 'P') as part, count(*) as n from orders group by 1)
select id, n, strftime(greatest(open_, filled, part), '%Y-%m-%d') as last_at, case greatest(open_, filled, part) when open_ then 'open' when filled then 'filled' else 'part' end as last_kind, date_diff('day', greatest(open_, filled, part)::date, date '2001-07-01')::int as days_since from a""")
def account_activity(spark, d):
    """Latest of several activity times with its label (the first named of equal ones), and the days since."""
    kinds = {"open": "O", "filled": "F", "part": "P"}
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), *(F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate"))).alias(k) for k, s in kinds.items()))
    last = F.greatest(*kinds)
    return o.select("id", "n", F.date_format(last, "yyyy-MM-dd").alias("last_at"), F.when(last == F.col("open"), "open").when(last == F.col("filled"), "filled").otherwise("part").alias("last_kind"), F.datediff(F.expr("date '2001-07-01'"), F.to_date(last)).alias("days_since"))


@query("""
with l as (select l_orderkey, floor((l_quantity * l_extendedprice + 2.220446049250313e-16) * 100 + 0.5)::bigint as cents from lineitem),
t as (select l_orderkey, count(*) as lines, sum(cents)::bigint as net from l group by 1)
select l_orderkey, lines, net, ((net * 20 + 50) // 100)::bigint as vat, (net + (net * 20 + 50) // 100)::bigint as total from t""")
def doc_totals(spark, d):
    """Invoice totals in cents: every line rounded, then summed; VAT of 20 % rounded after."""
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(cents(F.col("l_quantity") * F.col("l_extendedprice"))).alias("net"))
    vat = F.expr("(net * 20 + 50) div 100")
    return li.withColumn("vat", vat).withColumn("total", F.col("net") + F.col("vat"))


@query("""select o_orderkey, 'DEV-' || year(o_orderdate) || '-' || lpad(row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey)::varchar, 4, '0') as number from orders""")
def doc_numbering(spark, d):
    """Numbers per user and year; numbers of five digits and more keep all of them."""
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    n = F.row_number().over(w).cast("string")
    return load(spark, d, "orders").select("o_orderkey", F.concat_ws("-", F.lit("DEV"), F.year("o_orderdate"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)).alias("number"))


@query("""select o_orderkey from (select o_orderkey, o_orderstatus = 'F' and o_orderkey % 3 = 0 as keep from orders where o_orderdate < timestamp '1998-01-01') where not keep""")
def quote_purge(spark, d):
    """Quotes to delete: old ones, unless accepted and invoiced (a null counts as not)."""
    keep = F.coalesce((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), F.lit(False))
    return load(spark, d, "orders").where("o_orderdate < timestamp '1998-01-01'").where(~keep).select("o_orderkey")


@query("""select * from (select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100)""")
def page_read(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 100)


@query("""
select kind, id, strftime(sent, '%Y-%m-%d') as day from (select 'order' as kind, o_orderkey as id, o_orderdate as sent from orders union all select 'line' as kind, l_orderkey * 10 + l_linenumber as id, l_shipdate as sent from lineitem) m order by sent desc, kind, id limit 40""")
def merge_sent(spark, d):
    """Two message lists as one, newest first, capped at 40."""
    o = load(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    li = load(spark, d, "lineitem").select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"))
    return o.unionByName(li).orderBy(F.desc("at"), "kind", "id").limit(40).select("kind", "id", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("""
with f as (select o_custkey, count(*) as fetched, count(*) filter (o_orderstatus <> 'P') as kept from orders group by 1)
select o_custkey, fetched, kept, floor((1000 * kept * 2 + fetched) / (fetched * 2))::bigint as estimate from f""")
def ratio_extrapolation(spark, d):
    """A total of 1000 scaled by the share that was kept of what was fetched."""
    f = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("fetched"), F.count_if(F.col("o_orderstatus") != "P").alias("kept"))
    return f.withColumn("estimate", F.expr("(1000 * kept * 2 + fetched) div (fetched * 2)"))


@query("""
select outcome, count(*) as n from (select case when o_totalprice < 1000 then 'refus_siret' when o_custkey % 17 = 0 then 'refus_opposition' when o_orderstatus = 'P' then 'deja_present' when o_orderstatus = 'F' then 'cree' else 'mis_a_jour' end as outcome from orders) group by 1""")
def bulk_outcomes(spark, d):
    outcome = F.when(F.col("o_totalprice") < 1000, "refus_siret").when(F.col("o_custkey") % 17 == 0, "refus_opposition").when(F.col("o_orderstatus") == "P", "deja_present").when(F.col("o_orderstatus") == "F", "cree").otherwise("mis_a_jour")
    return load(spark, d, "orders").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""
with c as (select c_custkey as id, case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then '' else c_name end as name from customer),
p as (select c_custkey as id, case when c_custkey % 3 = 0 then null else 'plan-' || c_mktsegment end as name from customer)
select c.id, coalesce(nullif(c.name, ''), nullif(p.name, '')) as name, case when coalesce(c.name, '') <> '' then 'user' when coalesce(p.name, '') <> '' then 'plan' end as source from c join p on c.id = p.id""")
def field_fallback(spark, d):
    """The account's own value, else its plan's, with the source; blanks are missing."""
    k = F.col("c_custkey")
    c = load(spark, d, "customer").select(k.alias("id"), F.when(k % 7 == 0, None).when(k % 7 == 1, "").otherwise(F.col("c_name")).alias("own"))
    p = load(spark, d, "customer").select(k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("plan-"), "c_mktsegment")).alias("plan"))
    out = c.join(p, "id")
    return out.select("id", first_filled("own", "plan").alias("name"), F.when(F.coalesce("own", F.lit("")) != "", "user").when(F.coalesce("plan", F.lit("")) != "", "plan").alias("source"))


_PURGE_RULES = (
    Rule("quote", "o_custkey", "account", unless="o_orderstatus = 'F' and o_orderpriority < '3'"),
    Rule("signature", "l_orderkey", "quote"),
    Rule("campaign", "owner", "account"),
    Rule("campaign_event", "campaign_id", "campaign"),
    Rule("audit_log", "user_id", "account", action="anonymise"),
    Rule("invoice", "o_custkey", "account", action="keep"),
)


def _purged(spark, d):
    """Accounts 3, 10, 17, ... go; quotes that were accepted and invoiced stay, and with them their signatures."""
    tables = {
        "account": load(spark, d, "customer"),
        "quote": load(spark, d, "orders"),
        "signature": load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"),
        "campaign": load(spark, d, "supplier").withColumn("owner", F.col("s_suppkey") * 3),
        "campaign_event": load(spark, d, "part").withColumn("campaign_id", F.col("p_partkey") % 150),
        "audit_log": load(spark, d, "events").select("event_id", "user_id"),
        "invoice": load(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"),
    }
    gone = tables["account"].where("c_custkey % 7 = 3").select(F.col("c_custkey").alias("id"))
    return purge(tables, _PURGE_RULES, "account", gone, {"account": "c_custkey", "quote": "o_orderkey", "campaign": "s_suppkey"})


_PURGE_SQL = """g as (select c_custkey from customer where c_custkey % 7 = 3), q as (select *, o_custkey in (from g) as own, o_custkey in (from g) and not (o_orderstatus = 'F' and o_orderpriority < '3') as dies from orders),
k as (select s_suppkey, s_suppkey * 3 in (from g) as dies from supplier), s as (select l.*, o_orderkey is not null as dies from lineitem l left join (select o_orderkey from q where dies) on l_orderkey = o_orderkey)"""


@query(f"""with {_PURGE_SQL}, x as (select 'account' as table_name, 'delete' as action, count(*) as n from g union all select 'quote', case when dies then 'delete' else 'keep' end, count(*) from q where own group by 2
 union all select 'signature', 'delete', count(*) from s where dies union all select 'campaign', 'delete', count(*) from k where dies union all select 'campaign_event', 'delete', count(*) from part where p_partkey % 150 in (select s_suppkey from k where dies)
 union all select 'audit_log', 'anonymise', count(*) from events where user_id in (from g) union all select 'invoice', 'keep', count(*) from orders where o_orderstatus = 'P' and o_custkey in (from g)) select * from x where n > 0""")
def purge_counts(spark, d):
    return _purged(spark, d)[1]


@query(f"""with {_PURGE_SQL} select 'quote' as table_name, o_orderstatus as part, count(*) as n, sum(o_orderkey)::bigint as keys from q where not dies group by 2
 union all select 'signature', l_linenumber::varchar, count(*), sum(l_orderkey)::bigint from s where not dies group by 2
 union all select 'audit_log', case when user_id in (from g) then 'nobody' else 'known' end, count(*), sum(event_id)::bigint from events group by 2
 union all select 'campaign_event', '', count(*), sum(p_partkey)::bigint from part where p_partkey % 150 not in (select s_suppkey from k where dies) group by 2""")
def purge_left(spark, d):
    """What is left of quotes, their signatures, the log and the events of campaigns."""
    left, _ = _purged(spark, d)

    def told(name, part, key):
        return left[name].groupBy(F.lit(name).alias("table_name"), part.alias("part")).agg(F.count("*").alias("n"), F.sum(key).alias("keys"))

    parts = (("quote", F.col("o_orderstatus"), "o_orderkey"), ("signature", F.col("l_linenumber").cast("string"), "l_orderkey"), ("audit_log", F.when(F.col("user_id").isNull(), "nobody").otherwise("known"), "event_id"), ("campaign_event", F.lit(""), "p_partkey"))
    return reduce(DataFrame.unionByName, [told(*p) for p in parts])
