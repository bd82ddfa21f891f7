"""CRM operators as functions of tables and a given moment: predicates, listings, imports, opt-outs, claims and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import company_key
from ..functions.values import blank, cents, first_filled
from .rows import first_filled_by


def table_or_empty(spark: SparkSession, name: str, schema: str | StructType) -> DataFrame:
    """A catalogue table, or no rows of its schema where it doesn't exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def fresh(refreshed: Column, now: Column, days: int = 30) -> Column:
    """Whether a row was refreshed within the last days; rows never refreshed aren't."""
    return F.coalesce(refreshed > now - F.make_dt_interval(days=F.lit(days)), F.lit(False))


def scope(department: str | None, naf: str | None, active: bool = False, towns: list[str] | None = None, postcode: str | None = None, now: Column | None = None) -> Column:
    """All conditions of a search on columns dept, naf, state, town, postcode and refreshed_at; without dept or naf no row fits."""
    if not department or not naf:
        return F.lit(False)
    parts = [F.col("dept") == department, F.regexp_replace("naf", r"\.", "") == naf.replace(".", "")]
    parts += [F.col("state") == "A"] if active else []
    parts += [F.col("town").isin(towns)] if towns else []
    parts += [F.col("postcode") == postcode] if postcode else []
    parts += [fresh(F.col("refreshed_at"), now)] if now is not None else []
    return reduce(lambda a, b: a & b, parts)


def scope_is_complete(department: str | None, town: str | None, divided: set[str]) -> bool:
    """A department that is divided into districts needs a town."""
    return bool(department) and (department not in divided or bool(town))


def to_crawl(site: Column, phone: Column, mail: Column, checked: Column, now: Column, days: int = 30) -> Column:
    """Has a site, lacks a phone or a mail, and was never checked or not for some days."""
    return ~blank(site) & (blank(phone) | blank(mail)) & (checked.isNull() | (checked < now - F.make_dt_interval(days=F.lit(days))))


def due(moment: Column, begin: Column, end: Column, sent: Column) -> Column:
    """Within [begin, end) and not yet told."""
    return (moment >= begin) & (moment < end) & sent.isNull()


def visible(status: Column) -> Column:
    """Rows that aren't softly deleted; a missing status isn't a deletion."""
    return F.coalesce(status, F.lit("")) != "deleted"


def without_secrets(df: DataFrame, secret: str = r"(?i)(password|secret|token|salt|hash)") -> DataFrame:
    import re

    return df.drop(*(c for c in df.columns if re.search(secret, c)))


def entitled(df: DataFrame, free: list[str], paid: list[str], bought: Column, blocked: Column) -> DataFrame:
    """Free columns always, paid ones where bought; a blocked row shows nothing but its hidden flag."""
    show = [F.when(~blocked, F.col(c)).alias(c) for c in free] + [F.when(~blocked & bought, F.col(c)).alias(c) for c in paid]
    return df.select(*show, blocked.alias("hidden"))


def allowed_hosts(urls: DataFrame, url: str, blocked: list[str], order: list[str]) -> DataFrame:
    """The first http(s) url of each origin, without hosts that are blocked themselves or end with a blocked one."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    bad = reduce(lambda a, b: a | b, [(host == b) | host.endswith("." + b) for b in blocked], F.lit(False))
    rows = urls.withColumn("origin", host).where((F.col("origin") != "") & ~bad)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("origin").orderBy(*order))).where("_n = 1").drop("_n")


def listing(df: DataFrame, owner: str, user: Column, order: list[Column], key: tuple[str, Column] | None = None) -> DataFrame:
    """A user's rows, of one key value if given, in a total order."""
    rows = df.where(F.col(owner) == user)
    return (rows.where(F.col(key[0]) == key[1]) if key else rows).orderBy(*order)


def paged(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of each key's rows with the key's number of rows, e.g. a user's history."""
    limit, offset = max(1, min(100, limit)), max(0, offset)
    w = Window.partitionBy(*keys)
    rows = df.withColumn("total", F.count("*").over(w)).withColumn("position", F.row_number().over(w.orderBy(*order)))
    return rows.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def preview(df: DataFrame, order: list[Column], shown: int = 5, marked: int = 500) -> DataFrame:
    """The first rows in full and the next ones as markers: adds position and kind (shown or marker)."""
    top = df.orderBy(*order).limit(marked)
    rows = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most `marked` rows
    return rows.withColumn("kind", F.when(F.col("position") <= shown, "shown").otherwise("marker"))


def import_people(stored: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Imported rows as people, met with stored ones: row_id (a person's first row), rows, id, outcome and filled fields.

    stored has id, email, name, company and fields; rows has row_id instead of id.  Rows of one mail are one person, rows
    without a mail those of one name and company; their fields are filled in the order of row_id.  A person with a mail meets
    the stored one of this mail and nobody else; one without meets that of the same name and company, both as keys.  Of
    several stored ones the smallest id counts.  Filled fields stay; outcome is by mail, by name or created.
    """
    names = stored.select("id", company_key(F.col("name")).alias("_name"), company_key(F.col("company")).alias("_company"))
    by_mail = _people(stored).where("_mail != ''").groupBy("_mail").agg(F.min("id").alias("mail_id"))
    by_name = names.where("_name != ''").groupBy("_name", "_company").agg(F.min("id").alias("name_id"))
    keys = ["_mail", "_name", "_company"]
    people = first_filled_by(_people(rows).withColumn("_first", F.col("row_id")), keys, ["row_id"], ["_first", *fields])
    met = people.join(by_mail, "_mail", "left").join(by_name, ["_name", "_company"], "left").withColumnRenamed("_first", "row_id")
    old = stored.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_old_{f}") for f in fields))
    new = met.withColumn("found", F.coalesce("mail_id", "name_id")).join(old, F.col("found") == F.col("_id"), "left")
    outcome = F.when(F.col("mail_id").isNotNull(), "by mail").when(F.col("name_id").isNotNull(), "by name").otherwise("created")
    return new.select("row_id", "rows", F.col("found").alias("id"), outcome.alias("outcome"), *(first_filled(f"_old_{f}", f).alias(f) for f in fields))


def _people(df: DataFrame) -> DataFrame:
    """df with the keys of its people: _mail, and _name and _company, which are blank where a mail tells the person."""
    mail = F.when(~blank("email"), F.lower(F.trim(F.col("email")))).otherwise("")
    return df.withColumns({"_mail": mail, "_name": F.when(mail == "", company_key(F.col("name"))).otherwise(""), "_company": F.when(mail == "", company_key(F.col("company"))).otherwise("")})


def propagate(target: DataFrame, source: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Copies filled source columns to the target's columns of other names, on equal keys; blanks change nothing."""
    new = source.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(s).alias(f"_new_{t}") for s, t in columns.items()))
    joined = target.join(new, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]), "left")
    changed = reduce(lambda a, b: a | b, [~blank(f"_new_{t}") & (F.col(f"_new_{t}") != F.coalesce(F.col(t), F.lit(""))) for t in columns.values()])
    return joined.select(*(first_filled(f"_new_{c}", c).alias(c) if c in columns.values() else F.col(c) for c in target.columns), F.coalesce(changed, F.lit(False)).alias("changed"))


def single_owner(df: DataFrame, value: str, owner: str) -> DataFrame:
    """Each value's owner, where it has just one: ambiguous values tell nothing."""
    rows = df.where(~blank(value)).groupBy(value).agg(F.min(owner).alias(owner), F.max(owner).alias("_other"))
    return rows.where(F.col(owner) == F.col("_other")).drop("_other")


def verify_optouts(requests: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Requests (token_hash, status, expires_at) a presented token belongs to: verified, used, expired or unknown."""
    asked = tokens.withColumn("_hash", F.sha2(F.col("token"), 256))
    r = requests.select("token_hash", F.col("status").alias("_status"), F.col("expires_at").alias("_expires"))
    found = asked.join(r, F.col("_hash") == F.col("token_hash"), "left")
    answer = F.when(F.col("token_hash").isNull(), "unknown").when(F.col("_status") != "pending", "used").when(F.col("_expires") <= now, "expired").otherwise("verified")
    return found.select(*tokens.columns, answer.alias("answer"))


def request_optouts(requests: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """asked (subject) with a pending request of the last hour reused, else a new one that expires in 24 hours; hashes only."""
    new = asked.select(F.sha2(F.lower(F.trim("subject")), 256).alias("subject_hash")).distinct()
    recent = requests.where((F.col("status") == "pending") & (F.col("created_at") > now - F.expr("interval 1 hour"))).groupBy("subject_hash").agg(F.max("created_at").alias("_at"))
    out = new.join(recent, "subject_hash", "left")
    created = F.coalesce("_at", now)
    return out.select("subject_hash", F.col("_at").isNotNull().alias("reused"), created.alias("created_at"), (created + F.expr("interval 24 hours")).alias("expires_at"))


def fill_rates(df: DataFrame, keys: list[Column], filled: list[str]) -> DataFrame:
    """Rows and filled columns per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_if(~blank(c)).alias(f"n_{c}") for c in filled))


def completed(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """A marker for each loaded key: how many rows it has and when it was last loaded."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(at).alias("completed_at"))


def raised(old: Column, new: Column, ladder: list[str]) -> Column:
    """The higher of two statuses on a ladder; a status never goes down, unknown ones are lowest."""
    rank = lambda c: F.coalesce(*(F.when(c == s, i) for i, s in enumerate(ladder)), F.lit(-1))
    return F.when(rank(new) > rank(old), new).otherwise(old)


def distinct_list(values: Column, fallback: Column) -> Column:
    """Trimmed, filled values in their order, each once; the fallback where there is none."""
    kept = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when(F.size(kept) > 0, kept).when(~blank(fallback), F.array(F.trim(fallback))).otherwise(F.array().cast("array<string>"))


def claim(df: DataFrame, column: str, free: Column, value: Column) -> DataFrame:
    """Sets a column where it is free, and says which rows were claimed."""
    return df.withColumns({column: F.when(free, value).otherwise(F.col(column)), "claimed": free})


def flip(df: DataFrame, column: str, when: Column, to: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a state changed where a condition holds, and how many were."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumn(column, F.when(hit, to).otherwise(F.col(column))), df.agg(F.count_if(hit).alias("n_changed"))


def unfold(df: DataFrame, key: str, array: str, kept: list[str]) -> DataFrame:
    """Rows out of a nested array: one per element, with its number; empty arrays give none."""
    rows = df.select(key, F.posexplode(array).alias("number", "_e"))
    return rows.select(key, "number", *(F.col(f"_e.{c}").alias(c) for c in kept))


def managers(people: Column) -> Column:
    """Natural persons of array<struct<kind,given,family>>: first given name, each lower-cased full name once, first kept."""
    natural = F.filter(people, lambda p: F.coalesce(p.kind, F.lit("")) == "natural")
    named = F.transform(natural, lambda p: F.struct(F.regexp_extract(F.trim(p.given), r"^(\S*)", 1).alias("given"), F.trim(p.family).alias("family")))
    key = lambda p: F.lower(F.concat_ws(" ", p.given, p.family))
    return F.filter(named, lambda p, i: F.array_position(F.transform(named, key), key(p)) == i + 1)


def person(df: DataFrame) -> DataFrame:
    """People with blanks for missing names, lists that begin with the main mail or phone, and consent as a truth value."""
    listed = lambda one, many: distinct_list(F.concat(F.array(F.coalesce(F.col(one), F.lit(""))), F.coalesce(F.col(many), F.array().cast("array<string>"))), F.lit(""))
    return df.withColumns({"name": F.coalesce(F.trim("name"), F.lit("")), "emails": listed("email", "emails"), "phones": listed("phone", "phones"), "consent": F.coalesce(F.col("consent").cast("string").isin("true", "1", "yes", "oui"), F.lit(False))})


def backfill(df: DataFrame, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """Fills a blank column in one pass, and counts what is still blank after it."""
    out = df.withColumn(column, first_filled(F.col(column), value))
    return out, out.agg(F.count("*").alias("rows"), F.count_if(blank(column)).alias("remaining"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def french_date(day: Column) -> Column:
    """Day, month name and year, e.g. 3 mars 2024; the first of a month is 1er."""
    months = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
    name = F.element_at(F.array(*map(F.lit, months)), F.month(day))
    return F.concat_ws(" ", F.when(F.dayofmonth(day) == 1, "1er").otherwise(F.dayofmonth(day).cast("string")), name, F.year(day).cast("string"))


def name_of_slug(url: Column) -> Column:
    """A person's name out of a profile address: words of its last part without closing identifiers, each with a capital."""
    slug = F.regexp_replace(F.regexp_extract(F.lower(url), r"/in/([^/?#]+)", 1), r"(-[0-9a-f]*[0-9][0-9a-f]*)+$", "")
    return F.initcap(F.trim(F.regexp_replace(slug, "-+", " ")))


def split_town(cell: Column) -> Column:
    """struct<postcode,town> of '75001 Paris'-like cells, blanks where there is no postcode."""
    found = F.regexp_extract(F.trim(cell), r"^([0-9]{5})\s+(.+)$", 1)
    return F.struct(found.alias("postcode"), F.when(found != "", F.regexp_extract(F.trim(cell), r"^([0-9]{5})\s+(.+)$", 2)).otherwise(F.trim(cell)).alias("town"))


def export_user(tables: dict[str, tuple[DataFrame, str]], user: str) -> DataFrame:
    """Every table's rows as JSON documents (user, table_name, document): written by user, they are each user's export."""
    parts = [df.select(F.col(key).alias(user), F.lit(name).alias("table_name"), F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("document")) for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def from_quote(quotes: DataFrame, lines: DataFrame, year: Column, prefix: str, vat: int, clients: list[str]) -> DataFrame:
    """Invoices made of quotes: renumbered per user, lines in whole cents summed anew, VAT, and the first filled client name.

    quotes: quote_id, user_id and client columns; lines: quote_id, quantity and price.
    """
    sums = lines.groupBy("quote_id").agg(F.sum(cents(F.col("quantity") * F.col("price"))).alias("net"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("quote_id"))
    out = quotes.join(sums, "quote_id", "left").withColumn("net", F.coalesce("net", F.lit(0)))
    tax = F.floor((F.col("net") * vat + 50) / 100).cast("bigint")
    return out.select("quote_id", "user_id", F.concat_ws("-", F.lit(prefix), year.cast("string"), F.lpad(number.cast("string"), 4, "0")).alias("number"), first_filled(*clients).alias("client"), "net", tax.alias("vat"), (F.col("net") + tax).alias("total"))

