"""Readers of register and contact files: CSV of several habits, XLSX, vCard, RSS, robots rules; and format sniffing."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import fold
from . import quoted

VCARD = "path string, prenom string, nom string, poste string, societe string, email string, tel string, linkedin string, site string"


def separator(line: str) -> str:
    """Of ; comma and tab the most frequent outside quotes; the earlier of equal ones, and ; where there is none."""
    bare = re.sub('"[^"]*"', "", line)
    return max(";,\t", key=lambda c: (bare.count(c), -";,\t".index(c)))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, required: list[str] = [], multiline: bool = True, dash: bool = True) -> DataFrame:  # noqa: B006
    """CSV with its separator told from the first line, quotes doubled inside quotes, line breaks in cells, blank rows out.

    Headers become accent-free lower case with underscores; a missing required column raises.  With `dash` a dash alone is
    empty.  Files are read in as many tasks as they have splits; without `multiline` a quotation ends with its line.
    """
    first = spark.read.text(path).limit(1).collect()
    sep = sep or separator(first[0][0].lstrip("\ufeff") if first else "")
    clean = lambda c: re.sub("[^a-z0-9]+", "_", _bare(c)).strip("_")
    names = [clean(c) for c in quoted.header(spark, path, sep, multiline)]
    if lost := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    df = quoted.with_header(quoted.read_records(spark, path, sep, multiline), names)
    empty = ("", "-") if dash else ("",)
    df = df.select(*(F.when(F.trim(c).isin(*empty), None).otherwise(F.trim(c)).alias(c) for c in df.columns))
    return df.dropna("all")


def _bare(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def read_rss(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """Items with a title and a link, the first `most` of each file; the guid falls back to the link, texts are cut to 200."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    items = items.withColumns({"_file": F.input_file_name(), "_place": F.monotonically_increasing_id()})
    cut = lambda c: F.substring(F.trim(c), 1, 200).alias(c)
    kept = items.where("trim(coalesce(title, '')) != '' and trim(coalesce(link, '')) != ''")
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_place"))).where(F.col("_n") <= most)
    return first.select(F.coalesce(F.trim("guid"), F.trim("link")).alias("guid"), cut("title"), F.trim("link").alias("link"), "pubDate", cut("description"))


def sniff(path: Column, content: Column) -> Column:
    """xlsx, vcf or csv, by the name or the first bytes."""
    head = F.substring(content, 1, 64)
    return F.when(F.lower(path).endswith(".xlsx") | (F.hex(F.substring(head, 1, 2)) == "504B"), "xlsx").when(F.lower(path).endswith(".vcf") | F.decode(head, "UTF-8").contains("BEGIN:VCARD"), "vcf").otherwise("csv")


def _sheet(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """Rows of the first sheet: shared and inline strings, sparse cells, blank rows left out."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for number, row in enumerate(ElementTree.fromstring(z.read(sheets[0])).iter(f"{main}row") if sheets else ()):
            cells: list[str] = []
            for c in row.iter(f"{main}c"):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", "")).group():
                    at = at * 26 + ord(letter) - 64
                value = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else c.findtext(f"{main}v") or ""
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                at = at or len(cells) + 1
                cells += [""] * (at - len(cells))
                cells[at - 1] = value.strip()
            if any(cells):
                yield number, cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells) of the first sheets of workbooks, a workbook a task at a time."""

    def run(parts):
        for pdf in parts:
            rows = [(p, n, cells) for p, data in zip(pdf.path, pdf.content) for n, cells in _sheet(data)]
            yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def _cards(text: str) -> Iterator[tuple]:
    text = re.sub(r"\r\n?", "\n", text.lstrip("﻿"))
    plain = lambda v: re.sub(r"\\([,;\\])", r"\1", re.sub(r"\\[nN]", " ", v)).strip()
    for body in re.findall(r"(?ims)^BEGIN:VCARD.*?\n(.*?)^END:VCARD", re.sub(r"\n[ \t]", "", text)):
        got: dict[str, str] = {}
        for line in body.split("\n"):
            name, colon, value = line.partition(":")
            key = re.sub(r"^ITEM\d+\.", "", name.split(";")[0].upper())
            if not colon:
                continue
            if key == "URL":
                key = "LINKEDIN" if "linkedin." in value.lower() else key
            if key in ("EMAIL", "TEL", "URL"):
                got.setdefault(key, value)
            else:
                got[key] = value
        parts = [*got.get("N", "").split(";"), "", ""]
        family, given = plain(parts[0]), plain(parts[1])
        if not family and not given and (words := plain(got.get("FN", "")).split()):
            given, family = (words[0], " ".join(words[1:])) if len(words) > 1 else ("", words[0])
        yield given, family, plain(got.get("TITLE", "")), plain(got.get("ORG", "").split(";")[0]), plain(got.get("EMAIL", "")).lower(), plain(got.get("TEL", "")), plain(got.get("LINKEDIN", "")), plain(got.get("URL", ""))


def read_vcard(spark: SparkSession, path: str) -> DataFrame:
    """One row a card: folded lines joined, the first mail, phone and site kept, network pages told from sites."""

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame([(p, *card) for p, data in zip(pdf.path, pdf.content) for card in _cards(data.decode("utf-8", "replace"))], columns=[c.split()[0] for c in VCARD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VCARD)


def robots_rules(text: str, agent: str) -> list[tuple[bool, str, int]]:
    """(allow, regular expression, length) rules for an agent: those of the longest agent token it starts with, else *."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    after_rule = True
    for line in re.split(r"\r\n?|\n", text.lstrip("﻿")):
        field, colon, value = (x.strip() for x in line.split("#")[0].partition(":"))
        field = field.lower()
        if field in ("user-agent", "useragent") and value:
            if after_rule:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            after_rule = False
        elif field in ("allow", "disallow", "crawl-delay") and groups:
            after_rule = True
            if value and field != "crawl-delay":
                groups[-1][1].append((field, value))
    tokens = [a for agents, _ in groups for a in agents if a != "*" and agent.lower().startswith(a)]
    best = max(tokens, key=len, default="*")
    form = lambda v: "^" + ".*".join(map(re.escape, v.removesuffix("$").split("*"))) + "$" * v.endswith("$")
    return [(f == "allow", form(v), len(v)) for agents, rules in groups if best in agents for f, v in rules]


def robots_allowed(paths: Column, text: str, agent: str) -> Column:
    rules = robots_rules(text, agent)

    def longest(kind: bool) -> Column:
        own = [F.when(paths.rlike(p), n).otherwise(-1) for a, p, n in rules if a == kind]
        return F.greatest(*own, F.lit(-1), F.lit(-1))

    return longest(True) >= longest(False)


def robots_table(robots: DataFrame, agent: str) -> DataFrame:
    """(host, rules) of robots texts (host, text), a row a host: an array as long as the host's file has rules."""

    def run(parts):
        for pdf in parts:
            rules = [[{"allow": a, "pattern": p, "size": n} for a, p, n in robots_rules(t or "", agent)] for t in pdf.text]
            yield pd.DataFrame({"host": pdf.host, "rules": rules})

    return robots.select("host", "text").mapInPandas(run, "host string, rules array<struct<allow: boolean, pattern: string, size: int>>")


def robots_verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (host, path) with allowed: the longest rule of the host decides, an allowing one of equals; no rule allows."""
    found = paths.join(rules, "host", "left")

    def longest(kind: bool) -> Column:
        hits = F.filter("rules", lambda r: (r.allow == kind) & F.regexp_like(F.col("path"), r.pattern))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: r.size)), F.lit(-1))

    return found.withColumn("allowed", longest(True) >= longest(False)).drop("rules")


def read_points(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Points of interest: contacts from the tags that hold them, the company number from the establishment's."""
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(n))), F.lit("")) for n in names))
    siret = F.regexp_replace(F.coalesce(first("ref:FR:SIRET"), F.lit("")), "[^0-9]", "")
    return df.select(
        "osm_id", first("name").alias("nom"), first("phone", "contact:phone").alias("phone"), first("email", "contact:email").alias("email"),
        first("website", "contact:website", "url").alias("website"), siret.alias("siret"), F.coalesce(first("ref:FR:SIREN"), F.nullif(F.substring(siret, 1, 9), F.lit(""))).alias("siren"),
        first("addr:housenumber").alias("housenumber"), first("addr:street").alias("street"), first("addr:postcode").alias("postcode"), first("addr:city").alias("city"), "lat", "lng",
    )


def stable_key(name: Column, postcode: Column, address: Column) -> Column:
    slug = lambda c: F.substring(F.replace(fold(c), F.lit(" "), F.lit("-")), 1, 90)
    return F.concat_ws("|", slug(name), F.coalesce(F.trim(postcode), F.lit("")), slug(address))


def parse_csv_text(text: str) -> list[list[str]]:
    """A pasted table, for headers and previews on the driver."""
    rows = csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=separator(text.split("\n")[0]))
    return [r for r in ([c.strip() for c in row] for row in rows) if any(r)]
