"""Companies with nested establishments: disclosure of all of them, the local one of a search, rows of a register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank, department_of_commune, first_filled, served


def fully_diffusible(status: Column, seat: Column, establishments: Column) -> Column:
    """Whether a company, its seat and every establishment found (structs with statut_diffusion_etablissement) are disclosed.

    A missing seat or a missing establishment in the list isn't disclosed; a missing list has none to ask.
    """
    open_ = lambda e: F.coalesce(e.statut_diffusion_etablissement == "O", F.lit(False))
    every = F.coalesce(F.forall(establishments, open_), F.lit(True))
    return F.coalesce(status == "O", F.lit(False)) & open_(seat) & every


def pick_local(establishments: Column, seat: Column, naf: Column, departments: Column) -> Column:
    """struct<establishment,siret,naf,dropped>: the establishment of a company that a search in departments shows.

    The first one in a wanted department, else the seat if it is in one.  Where departments are wanted and none is there, the
    company is dropped; where none are wanted it is the seat, else the first of the list.  naf has no dots.
    """
    some = F.size(departments) > 0
    local = F.get(F.filter(establishments, lambda e: served(e.code_postal, departments)), F.lit(0))
    near = F.coalesce(F.when(some, local), F.when(seat.isNotNull() & served(seat.code_postal, departments), seat))
    chosen = F.when(some, near).otherwise(F.coalesce(near, F.get(establishments, F.lit(0))))
    code = F.regexp_replace(F.coalesce(first_filled(chosen.activite_principale, naf), F.lit("")), r"\.", "")
    dropped = some & near.isNull()
    return F.struct(chosen.alias("establishment"), F.coalesce(chosen.siret, F.lit("")).alias("siret"), F.when(dropped, "").otherwise(code).alias("naf"), dropped.alias("dropped"))


def register_rows(companies: DataFrame, blocked: DataFrame) -> DataFrame:
    """companies (siren, activite_principale, etat_administratif, matching_etablissements, siege, ...) as rows of a register.

    The row is of the first establishment found, else of the seat.  skipped says why a row must not be kept: no establishment,
    no number, opted out (its siret is in blocked(siret)), no department (overseas, or an unknown commune), closed.
    """
    own = companies.withColumn("_e", F.coalesce(F.get("matching_etablissements", F.lit(0)), F.col("siege")))
    e = F.col("_e")
    own = own.withColumns({"siret": F.trim(e.siret), "_dept": department_of_commune(e.commune), "_state": first_filled(e.etat_administratif, F.col("etat_administratif"))})
    listed = blocked.select(F.trim("siret").alias("_blocked")).distinct()
    own = own.join(listed, F.col("siret") == F.col("_blocked"), "left")
    skipped = F.when(e.isNull(), "no establishment").when(blank("siret"), "no number").when(F.col("_blocked").isNotNull(), "opted out").when(blank("_dept"), "no department").when(F.coalesce(F.col("_state") != "A", F.lit(True)), "closed")
    return own.select("siren", "siret", first_filled(e.activite_principale, F.col("activite_principale")).alias("naf"), F.trim(e.commune).alias("commune"), F.col("_dept").alias("departement"), F.col("_state").alias("etat_administratif"), e.code_postal.alias("code_postal"), skipped.alias("skipped"))
