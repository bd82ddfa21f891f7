"""Plans, their limits and what is used of them; figures of all accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import blank, month_start, percent

# Leads a month by plan.
LIMITS = {"essai": 30, "demarrage": 30, "activite": 60, "croisiere": 120}


def effective_plan(bypass: Column, trial: Column, plan: Column) -> Column:
    """The plan that counts: the largest for guests, the own one once a trial was converted (the smallest if none), else the trial."""
    own = F.when(blank(plan), "demarrage").otherwise(plan)
    return F.when(F.coalesce(bypass, F.lit(False)), "croisiere").when(F.coalesce(trial == "converted", F.lit(False)), own).otherwise("essai")


def quotas(users: DataFrame, used: DataFrame, now: Column, limits: dict[str, int] = LIMITS) -> DataFrame:
    """users (user_id, bypass, trial_status, plan, owner) with used (user_id, used, last_reset): plan, limit, used, remaining, reset.

    Paid counters begin anew with the month of `now`: reset tells where the stored one is older and must be written as 0.  A
    trial's counter is never reset.  The owner has no limit (null); unknown plans have the smallest one; no counter is 0.
    """
    plan = effective_plan(F.col("bypass"), F.col("trial_status"), F.col("plan"))
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    rows = users.join(used.select("user_id", F.col("used").alias("_used"), F.col("last_reset").alias("_last"), F.lit(True).alias("_kept")), "user_id", "left")
    rows = rows.withColumn("effective", plan)
    old = F.coalesce("_kept", F.lit(False)) & (F.col("effective") != "essai") & F.coalesce(F.to_date("_last") < month_start(now), F.lit(True))
    limit = F.when(~F.coalesce("owner", F.lit(False)), F.coalesce(F.try_element_at(table, F.col("effective")), F.lit(limits["demarrage"])))
    rows = rows.withColumns({"reset": old, "lead_limit": limit, "used": F.when(old, 0).otherwise(F.coalesce("_used", F.lit(0)))})
    left = F.when(F.col("lead_limit").isNotNull(), F.greatest(F.col("lead_limit") - F.col("used"), F.lit(0)))
    return rows.select("user_id", F.col("effective").alias("plan"), "lead_limit", F.col("used").cast("bigint").alias("used"), left.cast("bigint").alias("remaining"), "reset", F.coalesce(F.col("used") >= F.col("lead_limit"), F.lit(False)).alias("exhausted"))


def account_cards(users: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: accounts, trials, converted, subscribers and their percentage, guests, cards and leads, without the owner.

    users has user_id, owner, subscription_status, trial_status, bypass and used; cards has user_id.
    """
    counts = cards.groupBy("user_id").agg(F.count("*").alias("_cards"))
    rows = users.where(~F.coalesce("owner", F.lit(False))).join(counts, "user_id", "left")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    out = rows.agg(
        F.count("*").alias("accounts"), is_("trial_status", "active").alias("trials"), is_("trial_status", "converted").alias("converted"), is_("subscription_status", "active").alias("subscribers"),
        F.count_if("bypass").alias("guests"), F.coalesce(F.sum("_cards"), F.lit(0)).alias("cards"), F.coalesce(F.sum("used"), F.lit(0)).alias("leads"),
    )
    return out.withColumn("subscribers_pct", percent(F.col("subscribers"), F.col("accounts")))


def weekly_signups(users: DataFrame, created: str, today: Column, weeks: int = 12) -> DataFrame:
    """Signups of the last `weeks` weeks by their Mondays; weeks without any are 0, the running one is partial."""
    spark = users.sparkSession
    last = F.date_trunc("week", today).cast("date")
    series = spark.range(weeks).select(F.date_sub(last, (F.col("id") * 7).cast("int")).alias("week"), (F.col("id") == 0).alias("partial"))
    sums = users.groupBy(F.to_date(F.date_trunc("week", F.col(created))).alias("week")).agg(F.count("*").alias("n"))
    return series.join(sums, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("signups"), "partial")
