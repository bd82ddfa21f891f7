"""Functions of values, streets, phones and identifiers over texts put together from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, values
from ..operators import crm, rows
from ..registry import query
from ..session import load
from ..sources.files import stable_key
from ..streaming.audience import flush_batches, read_events, work_folder


def _pick(k, *texts):
    """The text of number k modulo their count."""
    return F.element_at(F.array(*(t if not isinstance(t, str | type(None)) else F.lit(t) for t in texts)), (k % len(texts) + 1).cast("int"))


@query("select event_id, strftime(ts + interval 1 hour, '%Y-%m-%d') as day, strftime((ts + interval 1 hour)::date - 90, '%Y-%m-%d') as before, strftime(date_trunc('week', (ts + interval 1 hour)::date), '%Y-%m-%d') as monday from events")
def civil_days(spark, d):
    """Days in Paris, where it is an hour later in January, the day 90 days before, and their Monday."""
    day = values.civil_day(F.col("ts"))
    text = lambda x: F.date_format(x, "yyyy-MM-dd")
    return load(spark, d, "events").select("event_id", text(day).alias("day"), text(F.date_sub(day, 90)).alias("before"), text(values.monday(day)).alias("monday"))


@query("""
with c as (select c_custkey, case c_custkey % 6 when 0 then ' ' || c_custkey || ' ' when 1 then '12.5' when 2 then '-3' when 3 then '' when 4 then null else '0' || c_custkey end as n, case c_custkey % 7 when 0 then ' TRUE' when 1 then '1' when 2 then 'Oui' when 3 then 'false' when 4 then '0 ' when 5 then 'Non' else 'maybe' end as b from customer)
select c_custkey, greatest(least(c_custkey - 700, 500), 1) as clamped, case when regexp_matches(trim(n), '^[0-9]+$') then trim(n)::bigint end as whole, case when lower(trim(b)) in ('true', '1', 'oui', 'yes') then true when lower(trim(b)) in ('false', '0', 'non', 'no') then false end as truth from c""")
def numbers_and_flags(spark, d):
    k = F.col("c_custkey")
    n = _pick(k, F.concat(F.lit(" "), k, F.lit(" ")), "12.5", "-3", "", None, F.concat(F.lit("0"), k))
    b = _pick(k, " TRUE", "1", "Oui", "false", "0 ", "Non", "maybe")
    return load(spark, d, "customer").select("c_custkey", values.clamp(k - 700, 1, 500).alias("clamped"), values.whole_number(n).alias("whole"), values.truth(b).alias("truth"))


@query("""
with c as (select c_custkey, lpad((c_custkey * 7919)::varchar, 14, '1') as s, lpad((c_custkey * 613 % 99000)::varchar, 5, '0') as m from customer),
t as (select *, case c_custkey % 4 when 0 then s when 1 then s[1:3] || ' ' || s[4:6] || '.' || s[7:9] || ' ' || s[10:] when 2 then s[1:13] end as raw, case c_custkey % 3 when 0 then ' 56.10a ' when 1 then '5610A' else '01.1' end as naf, case c_custkey % 3 when 0 then 'contacts:⟨' || c_custkey || '⟩' when 1 then 'user:`u' || c_custkey || '`' else c_custkey::varchar end as record from c)
select c_custkey, case when length(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g')) = 14 then regexp_replace(raw, '[^0-9]', '', 'g') else '' end as siret, case when length(regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g')) = 14 then left(regexp_replace(raw, '[^0-9]', '', 'g'), 9) else '' end as siren,
 case c_custkey % 3 when 0 then '5610A' when 1 then '5610A' else '011' end as naf, case c_custkey % 3 when 2 then '011' else '56.10A' end as dotted, case when regexp_matches(m, '^9[78]') then '' else left(m, 2) end as dept,
 case c_custkey % 3 when 1 then 'u' else '' end || c_custkey as record from t""")
def identifiers(spark, d):
    """Company numbers with separators, activity codes in both forms, departments of communes and record ids without their table."""
    k = F.col("c_custkey")
    s, m = F.lpad((k * 7919).cast("string"), 14, "1"), F.lpad((k * 613 % 99000).cast("string"), 5, "0")
    raw = _pick(k, s, F.concat(F.substring(s, 1, 3), F.lit(" "), F.substring(s, 4, 3), F.lit("."), F.substring(s, 7, 3), F.lit(" "), F.substring(s, 10, 5)), F.substring(s, 1, 13), None)
    naf = _pick(k, " 56.10a ", "5610A", "01.1")
    record = _pick(k, F.concat(F.lit("contacts:⟨"), k, F.lit("⟩")), F.concat(F.lit("user:`u"), k, F.lit("`")), k.cast("string"))
    return load(spark, d, "customer").select("c_custkey", values.siret(raw).alias("siret"), values.siren(raw).alias("siren"), values.naf_plain(naf).alias("naf"), values.naf_dotted(naf).alias("dotted"), values.department_of_commune(m).alias("dept"), values.bare_id(record).alias("record"))


@query("""
with c as (select c_custkey, lpad((c_custkey * 7919 % 100000000)::varchar, 8, '0') as n, lower(c_mktsegment) as s from customer),
t as (select *, case c_custkey % 5 when 0 then '+33 6 ' || n when 1 then '01.' || n when 2 then '(09)-' || n when 3 then '0800' else '' end as phone, case c_custkey % 4 when 0 then 'Contact@' || s || '.fr / ann.' || s || '@gmail.com' when 1 then 'resa-' || c_custkey || '@x.fr,info+a@x.fr' when 2 then 'no mail' end as mails from c)
select c_custkey, case c_custkey % 5 when 0 then '06' || n when 1 then '01' || n when 2 then '09' || n when 3 then '0800' else '' end as phone, case c_custkey % 5 when 0 then 'mobile' when 1 then 'fixe' when 2 then 'fixe' when 3 then 'douteux' end as class,
 case c_custkey % 5 when 0 then '|+33 6 ' || n when 1 then '01.' || n || '|' when 2 then '(09)-' || n || '|' when 3 then '0800|' else '|' end as phones,
 case c_custkey % 4 when 0 then 'contact@' || s || '.fr|ann.' || s || '@gmail.com' when 1 then 'info+a@x.fr|resa-' || c_custkey || '@x.fr' else '|' end as mails, c_custkey % 4 = 1 as professional from t""")
def phones_and_mails(spark, d):
    """Phones in national form with their class, cells of several phones and mails parted by whose they are, business mails."""
    k, s = F.col("c_custkey"), F.lower("c_mktsegment")
    n = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")
    phone = _pick(k, F.concat(F.lit("+33 6 "), n), F.concat(F.lit("01."), n), F.concat(F.lit("(09)-"), n), "0800", "")
    mails = _pick(k, F.concat(F.lit("Contact@"), s, F.lit(".fr / ann."), s, F.lit("@gmail.com")), F.concat(F.lit("resa-"), k, F.lit("@x.fr,info+a@x.fr")), "no mail", None)
    both = lambda x: F.concat(F.array_join(x.company, ","), F.lit("|"), F.array_join(x.person, ","))
    split = names.split_mails(mails)
    return load(spark, d, "customer").select("c_custkey", names.phone(phone).alias("phone"), names.phone_class(phone).alias("class"), both(names.split_phones(phone)).alias("phones"), both(split).alias("mails"), names.professional_mail(F.get(split.person, F.lit(0))).alias("professional"))


@query("""
with c as (select c_custkey, c_custkey % 99 as n, c_mktsegment as s, lpad((c_custkey % 90000)::varchar, 5, '0') as p from customer)
select c_custkey, case c_custkey % 4 when 2 then '' else n::varchar end as number, case c_custkey % 4 when 0 then 'rue ' || lower(s) when 1 then 'avenue general ' || lower(s) when 2 then 'quai ' || lower(s) else 'rue paradis' end as street,
 c_custkey % 4 <> 2 and c_custkey % 3 > 0 as same, lower(s) || '-sarl|' || p || '|' || case c_custkey % 4 when 0 then n || '-rue-des-' || lower(s) || '-75011-paris' when 1 then 'bat-a-' || n || '-av-du-gal-' || lower(s) when 2 then 'quai-de-la-' || lower(s) else n || '-bis-r-paradis' end as key from c""")
def addresses(spark, d):
    """Addresses of one line parted into number and street, house numbers that agree, and keys that stay the same."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    n = (k % 99).cast("string")
    line = _pick(k, F.concat(n, F.lit(" RUE DES "), s, F.lit(" 75011 PARIS")), F.concat(F.lit("BAT A "), n, F.lit(" AV DU GAL "), s), F.concat(F.lit("quai de la "), s), F.concat(n, F.lit(" bis r. Paradis")))
    # a block's letter is left of the number, so the number is the first run of digits
    parsed = names.parse_address(line)
    other = _pick(k, F.lit(None).cast("string"), F.concat(n, F.lit(" ter")), F.concat(F.lit("n° "), n, F.lit("-99")))
    return load(spark, d, "customer").select("c_custkey", parsed.number.alias("number"), parsed.street.alias("street"), names.same_number(parsed.number, other).alias("same"), stable_key(F.concat(s, F.lit(" SARL")), F.lpad((k % 90000).cast("string"), 5, "0"), line).alias("key"))


_SALT = b"salt of the day"
_PADS = [bytes(b ^ pad for b in _SALT.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""
with e as (select event_id, '10.0.0.' || user_id as ip, case when event_id % 5 > 0 then event_type end as agent from events)
select event_id, left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(ip || chr(10) || coalesce(agent, ''))))), 32) as token from e""")
def visitor_tokens(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", values.visitor_token(_SALT, F.concat(F.lit("10.0.0."), F.col("user_id")), F.when(F.col("event_id") % 5 > 0, F.col("event_type"))).alias("token"))


@query("""
with u as (select user_id, list_sort(list(distinct event_type)) as kinds from events group by 1), c as (select c_custkey, coalesce(kinds, []) as kinds, case c_custkey % 3 when 0 then 'click' when 1 then 'call' else 'view' end as x from customer left join u on user_id = c_custkey)
select c_custkey, array_to_string(list_sort(list_distinct(list_append(kinds, x))), ',') as kinds, not list_contains(kinds, x) as is_new, c_custkey % 4 > 0 and (c_custkey % 4 < 3 or c_custkey % 2 = 0) as complete from c""")
def sets_and_scopes(spark, d):
    """A kind put into the set of kinds of each user, and whether it is new; and which searches say enough of where."""
    k = F.col("c_custkey")
    kinds = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    c = load(spark, d, "customer").join(kinds, F.col("user_id") == k, "left")
    grown, new = rows.add_to_set(F.col("kinds"), _pick(k, "click", "call", "view"))
    complete = F.coalesce(*(F.when((k % 4 == i) & (k % 2 == j), F.lit(crm.scope_is_complete([None, "33", "69", "75"][i], "x" if j == 0 else None, {"75"}))) for i in range(4) for j in range(2)))
    return c.select("c_custkey", F.array_join(F.array_sort(grown), ",").alias("kinds"), new.alias("is_new"), complete.alias("complete"))


@query("""select 'events' as table_name, event_type as part, count(*) as n from events group by 2""")
def micro_batches(spark, d):
    """The events as a stream whose batches go into a folder, beside a catalogue table that isn't there and so has no rows."""
    base = work_folder(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = read_events(spark, f"{d}/events*.parquet", schema)
    sink = flush_batches(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/{i}"), f"{base}/state", "1 second")
    try:
        sink.processAllAvailable()
    finally:
        sink.stop()
    kept = spark.read.schema(stream.schema).parquet(f"{base}/out/*").groupBy("event_type").agg(F.count("*").alias("n"))
    none = crm.table_or_empty(spark, "no_such_table_of_visits", "part string, n long").withColumn("table_name", F.lit("none"))
    return kept.select(F.lit("events").alias("table_name"), F.col("event_type").alias("part"), "n").unionByName(none)
