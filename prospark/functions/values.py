"""Missing values, money, dates and identifiers as column functions."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c) -> Column:
    """Null, empty and white-space strings are one kind of missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c), F.lit("")) == ""


def first_filled(*columns) -> Column:
    """The first column that isn't blank, else null."""
    return F.coalesce(*(F.when(~blank(c), c) for c in (F.col(x) if isinstance(x, str) else x for x in columns)))


def cents(x: Column) -> Column:
    """Money as whole cents, halves up, with the epsilon that decides 1.005 and 1.255: floor((x + 2^-52) * 100 + 0.5)."""
    return F.floor((x + F.lit(2.220446049250313e-16)) * 100 + 0.5).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves up; 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2))).otherwise(0).cast("bigint")


def civil_day(ts: Column, zone: str = "Europe/Paris") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def whole_number(text: Column) -> Column:
    """The number of a text of digits only, else null."""
    return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("bigint"))


def truth(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "oui", "yes"), True).when(t.isin("false", "0", "non", "no"), False)


def bare_id(x: Column) -> Column:
    """Record id without its table prefix and its brackets."""
    return F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z_]+:", ""), "[⟨⟩`]", "")


def siret(x: Column) -> Column:
    """14 digits, else empty."""
    d = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    return F.when(F.length(d) == 14, d).otherwise("")


def siren(x: Column) -> Column:
    return F.substring(siret(x), 1, 9)


def naf_plain(x: Column) -> Column:
    return F.upper(F.replace(F.trim(x), F.lit("."), F.lit("")))


def naf_dotted(x: Column) -> Column:
    p = naf_plain(x)
    return F.when(F.length(p) == 5, F.concat(F.substring(p, 1, 2), F.lit("."), F.substring(p, 3, 3))).otherwise(p)


def department(postcode: Column) -> Column:
    """Department of a five-digit postcode: overseas ones have three digits, Corsica splits at 20200; else empty."""
    p = F.trim(F.coalesce(postcode, F.lit("")))
    corsica = F.when(p < "20200", "2A").otherwise("2B")
    return F.when(~p.rlike("^[0-9]{5}$"), "").when(p.rlike("^9[78]"), F.substring(p, 1, 3)).when(p.startswith("20"), corsica).otherwise(F.substring(p, 1, 2))


def department_of_commune(insee: Column) -> Column:
    p = F.trim(F.coalesce(insee, F.lit("")))
    return F.when(p.rlike("^9[78]"), "").otherwise(F.substring(p, 1, 2))


def served(postcode: Column, departments: Column) -> Column:
    """The first two characters are a wanted department; 20xxx matches both of Corsica; an empty list wants all."""
    two = F.substring(F.coalesce(postcode, F.lit("")), 1, 2)
    corsica = (two == "20") & F.arrays_overlap(departments, F.array(F.lit("2A"), F.lit("2B")))
    return (F.size(departments) == 0) | F.array_contains(departments, two) | corsica


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def visitor_token(salt: bytes, ip: Column, agent: Column) -> Column:
    """A day's anonymous token: 32 signs of the keyed digest (HMAC-SHA256) of address and agent, the day's salt being the key."""
    key = (salt if len(salt) <= 64 else hashlib.sha256(salt).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("\n", F.coalesce(ip, F.lit("")), F.coalesce(agent, F.lit(""))), "UTF-8")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256), 1, 32)
