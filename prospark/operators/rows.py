"""Operators on rows: latest, newest, sessions, merges, upserts, diffs, deletions and set unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; order must be total, or ties are arbitrary.  Spark filters early per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, given: str | None = None, tie: str | None = None) -> DataFrame:
    """Adds session, the number of a row's group within its keys: rows at most gap_seconds apart are one group.

    Rows with a `given` group id are grouped by it, whatever their times; rows without a time are groups of their own, told by
    `tie` if given, else by all their columns (a random number would change when a task runs again).
    """
    seconds = F.col(ts).cast("double")
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    free = F.lit(True) if given is None else blank(given)
    timed = df.where(free & F.col(ts).isNotNull())
    timed = timed.withColumn("_new", F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1))
    out = timed.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("string")).drop("_new")
    rest = df.where(free & F.col(ts).isNull()).withColumn("session", F.concat(F.lit("untimed-"), F.col(tie).cast("string") if tie else F.sha2(F.to_json(F.struct(*df.columns)), 256)))
    out = out.unionByName(rest)
    return out if given is None else out.unionByName(df.where(~free).withColumn("session", F.concat(F.lit("given-"), F.col(given))))


def merge_fill(old: DataFrame, new: DataFrame, key: str, fill: list[str], always: list[str] = []) -> DataFrame:  # noqa: B006
    """Upsert: `fill` columns keep a filled old value, `always` columns take the new one where there is a new row.

    action is created, updated or kept.  One full join; each side must have one row a key.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, comes = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    columns += [F.when(blank(F.col(f"o.{c}").cast("string")), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fill]
    columns += [F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in always]
    return joined.select(*columns, F.when(~there, "created").when(comes, "updated").otherwise("kept").alias("action"))


def first_filled_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key: of each column the first value by `order` that isn't blank, else null; and `rows`, how many there were.

    The order must be total, or the smallest of tied values counts.  It is a plain aggregate: tasks sum up before the shuffle.
    """
    first = lambda c: F.min(F.when(~blank(F.col(c).cast("string")), F.struct(*order, F.col(c).alias("_v"))))["_v"].alias(c)
    return df.groupBy(*keys).agg(*map(first, columns), F.count("*").alias("rows"))


def changed_fields(old: str, new: str, names: list[str]) -> Column:
    """Names whose values differ between two structs; blanks are equal, values compare as text."""
    text = lambda side, c: F.coalesce(F.trim(F.col(f"{side}.{c}").cast("string")), F.lit(""))
    return F.array_compact(F.array(*(F.when(text(old, c) != text(new, c), F.lit(c)) for c in names)))


def without(df: DataFrame, blocked: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows whose column is in none of the blocked key columns, one anti-join a pair; null keys block nothing."""
    return reduce(lambda d, p: d.join(blocked.where(F.col(p[1]).isNotNull()).select(F.col(p[1]).alias("_k")).distinct(), F.col(p[0]) == F.col("_k"), "left_anti"), pairs, df)


def without_hashed(df: DataFrame, blocklist: DataFrame, hash_column: str, values: list[Column]) -> DataFrame:
    """Opt-out: drops rows of which any value's SHA-256 is listed.  A missing list must raise before this, not pass all."""
    for i, v in enumerate(values):
        df = df.withColumn(f"_h{i}", F.sha2(v, 256))
        df = df.join(blocklist.select(F.col(hash_column).alias("_b")).distinct(), F.col(f"_h{i}") == F.col("_b"), "left_anti").drop(f"_h{i}")
    return df


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cascade: each table without the rows of gone keys, and (table, n_deleted, n_kept)."""
    keys = gone.select(F.col(key).alias("_k")).distinct()
    kept = {t: df.join(keys, F.col(c) == F.col("_k"), "left_anti") for t, (df, c) in tables.items()}
    parts = []
    for t, (df, c) in tables.items():
        flagged = df.join(keys.withColumn("_gone", F.lit(1)), F.col(c) == F.col("_k"), "left")
        parts.append(flagged.agg(F.lit(t).alias("table_name"), F.count("_gone").alias("n_deleted"), F.count_if(F.col("_gone").isNull()).alias("n_kept")))
    return kept, reduce(DataFrame.unionByName, parts)


def add_to_set(existing: Column, x: Column) -> tuple[Column, Column]:
    """The set with x, and whether x is new."""
    old = F.coalesce(existing, F.array().cast("array<string>"))
    return F.array_union(old, F.array(x)), ~F.array_contains(old, x)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order; limit is clamped to 1..100, offset to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(100, limit)))
