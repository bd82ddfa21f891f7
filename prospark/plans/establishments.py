"""Companies with nested establishments, made of customers and their orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.establishments import fully_diffusible, pick_local, register_rows
from ..registry import query
from ..session import load

_FORM = "struct<siret: string, code_postal: string, commune: string, activite_principale: string, etat_administratif: string, statut_diffusion_etablissement: string>"
# Establishments: a customer's orders, in their order; the seat is the customer itself, some have none.
_SQL = """e as (select o_custkey as siren, o_orderkey as num, case when o_orderkey % 23 > 0 then 'E' || o_orderkey else ' ' end as siret, case o_orderkey % 4 when 0 then '75011' when 1 then '20' || lpad((o_orderkey % 500)::varchar, 3, '0') when 2 then '33000' else '97110' end as cp,
 case o_orderkey % 4 when 0 then '75111' when 1 then '2A004' when 2 then '33063' else '97101' end as commune, case when o_orderkey % 3 = 0 then '56.10A' end as naf, case when o_orderkey % 5 > 0 then 'A' when o_orderkey % 10 = 0 then 'F' end as state, case when o_orderkey % 19 > 0 then 'O' else 'P' end as open from orders),
s as (select c_custkey as siren, 'S' || c_custkey as siret, case c_custkey % 3 when 0 then '33100' when 1 then '75001' else '13001' end as cp, case c_custkey % 3 when 0 then '33063' when 1 then '75101' else '13201' end as commune, case when c_custkey % 2 = 0 then '47.11B' end as naf, 'A' as state, case when c_custkey % 13 > 0 then 'O' end as open from customer where c_custkey % 6 > 0),
c as (select c_custkey as siren, case when c_custkey % 11 > 0 then 'O' else 'P' end as open, '01.1' as naf, case when c_custkey % 8 > 0 then 'A' else 'C' end as state, case c_custkey % 4 when 0 then [] when 1 then ['75'] when 2 then ['2B', '44'] else ['33', '13'] end as depts from customer)"""


def _companies(spark, d: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    cp = F.when(o % 4 == 0, "75011").when(o % 4 == 1, F.concat(F.lit("20"), F.lpad((o % 500).cast("string"), 3, "0"))).when(o % 4 == 2, "33000").otherwise("97110")
    commune = F.when(o % 4 == 0, "75111").when(o % 4 == 1, "2A004").when(o % 4 == 2, "33063").otherwise("97101")
    place = F.struct(F.when(o % 23 > 0, F.concat(F.lit("E"), o)).otherwise(" "), cp, commune, F.when(o % 3 == 0, "56.10A"), F.when(o % 5 > 0, "A").when(o % 10 == 0, "F"), F.when(o % 19 > 0, "O").otherwise("P")).cast(_FORM)
    nested = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", place.alias("e")))).alias("all"))
    seat = F.struct(F.concat(F.lit("S"), k), F.when(k % 3 == 0, "33100").when(k % 3 == 1, "75001").otherwise("13001"), F.when(k % 3 == 0, "33063").when(k % 3 == 1, "75101").otherwise("13201"), F.when(k % 2 == 0, "47.11B"), F.lit("A"), F.when(k % 13 > 0, "O")).cast(_FORM)
    c = load(spark, d, "customer").join(nested, F.col("o_custkey") == k, "left")
    depts = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("75"))).when(k % 4 == 2, F.array(F.lit("2B"), F.lit("44"))).otherwise(F.array(F.lit("33"), F.lit("13")))
    return c.select(k.alias("siren"), F.when(k % 11 > 0, "O").otherwise("P").alias("statut_diffusion"), F.lit("01.1").alias("activite_principale"), F.when(k % 8 > 0, "A").otherwise("C").alias("etat_administratif"), F.col("all.e").alias("matching_etablissements"), F.when(k % 6 > 0, seat).alias("siege"), depts.alias("departments"))


@query(f"""with {_SQL}, a as (select siren, bool_and(open = 'O') as every from e group by 1)
select c.siren, c.open = 'O' and coalesce(s.open = 'O', false) and coalesce(every, true) as diffusible from c left join s using (siren) left join a using (siren)""")
def diffusible_companies(spark, d):
    c = _companies(spark, d)
    return c.select("siren", fully_diffusible(F.col("statut_diffusion"), F.col("siege"), F.col("matching_etablissements")).alias("diffusible"))


@query(f"""with {_SQL}, f as (select siren, min_by(siret, num) as siret, min_by(struct_pack(naf := naf), num) as naf from e group by 1),
l as (select e.siren, min_by(e.siret, num) as siret, min_by(struct_pack(naf := e.naf), num) as naf from e join c using (siren) where list_contains(depts, left(cp, 2)) or (left(cp, 2) = '20' and list_contains(depts, '2B')) group by 1),
p as (select c.siren, c.naf as own, len(depts) > 0 as wants, l.siren is not null as l, s.siren is not null and (len(depts) = 0 or list_contains(depts, left(s.cp, 2))) as s, l.siret as ls, l.naf.naf as ln, s.siret as ss, s.naf as sn, f.siret as fs, f.naf.naf as fn from c left join l using (siren) left join s using (siren) left join f using (siren))
select siren, case when wants and l then ls when s then ss when wants then '' else coalesce(fs, '') end as siret, replace(case when wants and l then coalesce(ln, own) when s then coalesce(sn, own) when wants then '' else coalesce(fn, own) end, '.', '') as naf, wants and not l and not s as dropped from p""")
def local_establishments(spark, d):
    """The establishment that a search in some departments (none, Paris, Corsica by 20xxx, two) shows of each company."""
    picked = pick_local(F.col("matching_etablissements"), F.col("siege"), F.col("activite_principale"), F.col("departments"))
    return _companies(spark, d).select("siren", picked.alias("p")).select("siren", "p.siret", "p.naf", "p.dropped")


@query(f"""with {_SQL}, f as (select siren, min_by(struct_pack(siret := siret, naf := naf, commune := commune, state := state), num) as x from e group by 1),
r as (select c.siren, coalesce(f.x, case when s.siren is not null then struct_pack(siret := s.siret, naf := s.naf, commune := s.commune, state := s.state) end) as x, c.naf as own, c.state as own_state from c left join f using (siren) left join s using (siren)),
q as (select siren, trim(x.siret) as siret, coalesce(x.naf, own) as naf, case when regexp_matches(x.commune, '^9[78]') then '' else coalesce(left(x.commune, 2), '') end as departement, coalesce(x.state, own_state) as state, x is null as gone from r)
select siren, siret, naf, departement, case when gone then 'no establishment' when coalesce(siret, '') = '' then 'no number' when siret in (select 'E' || o_orderkey from orders where o_orderkey % 7 = 0) then 'opted out' when departement = '' then 'no department' when state <> 'A' then 'closed' end as skipped from q""")
def register_upserts(spark, d):
    """What a register keeps of each company, and which rows it must not keep, for the first reason that holds."""
    blocked = load(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("E"), "o_orderkey").alias("siret"))
    return register_rows(_companies(spark, d), blocked).select("siren", "siret", "naf", "departement", "skipped")
