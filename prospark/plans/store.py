"""Files taken into a store of tables, and functions of values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.imports import LINE, import_file
from ..registry import query
from ..session import load
from ..sinks.store import Store
from ..streaming.audience import work_folder


@query("""
with l as (select c_custkey as row_id, 'Cust' as prenom, c_mktsegment || c_custkey % 300 as nom, case when c_custkey % 3 = 0 then 'm' || c_custkey % 200 || '@firm.fr' end as mail, case c_custkey % 4 when 0 then '' else 'Firm ' || c_nationkey end as societe from customer),
p as (select distinct coalesce(mail, lower(nom) || '|' || lower(societe)) as key, mail, nom, societe from l), k as (select count(distinct coalesce(mail, lower(nom) || '|' || lower(societe))) as people, count(distinct lower(societe)) filter (societe <> '') as firms from l),
e as (select count(*) as lone from nation where n_nationkey % 5 = 0)
select 1 as run, 'created' as outcome, people as n from k union all select 1, 'enriched', 0 union all select 1, 'entity', lone from e union all select 1, 'companies', firms + lone from k, e
union all select 2, 'created', 0 union all select 2, 'enriched', people from k union all select 2, 'entity', 0 union all select 2, 'companies', 0
union all select 3, 'contacts', people + lone from k, e union all select 3, 'companies', firms + lone from k, e""")
def import_store(spark, d):
    """A file of customers and of firms without people, taken in twice: the second time nobody is new.  run 3: what is there."""
    k = F.col("c_custkey")
    line = {"prenom": F.lit("Cust"), "nom": F.concat("c_mktsegment", k % 300), "email": F.when(k % 3 == 0, F.concat(F.lit("m"), k % 200, F.lit("@firm.fr"))), "societe": F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Firm "), "c_nationkey"))}
    blank = F.lit(None).cast("string")
    rows = load(spark, d, "customer").select(k.alias("row_id"), *(line.get(c, blank).alias(c) for c in LINE))
    lone = load(spark, d, "nation").where("n_nationkey % 5 = 0").select((F.col("n_nationkey").cast("long") + 10**9).alias("row_id"), *((F.concat(F.lit("Lone "), "n_nationkey") if c == "societe" else blank).alias(c) for c in LINE))
    store = Store(spark, f"{work_folder(spark)}/store", 4)
    out = [(run, o, n) for run in (1, 2) for o, n in import_file(store, rows.unionByName(lone)).items()]
    told = spark.createDataFrame(out, "run int, outcome string, n long")
    for table in ("contacts", "companies"):
        told = told.unionByName(store.read(table).agg(F.count("*").alias("n")).select(F.lit(3).alias("run"), F.lit(table).alias("outcome"), "n"))
    return told
