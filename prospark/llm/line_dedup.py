"""Line deduplication over a corpus by a segment-partition edit join, with DataFrame functions only.

A line of at least `min_chars` code points is a duplicate when the same line occurs earlier, or, from `edit_chars` code
points on, when some line that first occurs earlier is within `edits` edits of it.  Earlier is by doc_id, then line number;
rows that share a doc_id but not their text go one after the other, by hashes of their texts.

A line of n code points is split into edits + 1 segments.  Two lines within the threshold share a whole segment of the
shorter one, so segments index the line and the longer line probes, for each length from n - edits to n, the substrings
at the places where a shared segment can lie (multi-match-aware selection).  Distinct lines are written once; their keys go
through one shuffle of hashes, texts don't.  Within a key each line first meets only the earliest line, which is linear in
the list; lines that this doesn't settle are compared with the rest of their lists, character counts first.  Keys that a
sample shows in many lines don't meet in one task: their earliest line is a combined minimum, which is broadcast.

Candidates are verified by banded bit-parallel edit distance: for each number of errors, a bit set says which diagonals of
the band are reached after each code point, all sets being parts of one 64-bit integer that an aggregate carries along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored
from .winnowing import _let

CLASSES = 16
SAMPLE = 64  # one of so many lines is looked at for hot keys
HOT_KEYS = 10_000  # a hot key has more than this part of the sampled keys, so there are fewer than so many


PLACE = ("doc_id", "digest", "pos")


def _several(docs: DataFrame) -> DataFrame:
    """doc_ids of rows with different texts."""
    whole = F.xxhash64(F.col("text").cast("string")).alias("text")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__doc"), whole)
    return stored(rows.groupBy("__doc").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("__doc"))


def _told_apart(docs: DataFrame, several: DataFrame, name: str) -> DataFrame:
    """docs with a digest: 0, or a hash of the text where rows of one doc_id have different texts."""
    if several.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    found = docs.join(several, F.col("doc_id").cast("long") == F.col("__doc"), "left")
    return found.withColumn(name, F.when(F.col("__doc").isNotNull(), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))).otherwise(0).cast("long")).drop("__doc")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, digest, pos, line) of every line that counts."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.char_length("line") >= min_chars)


def _segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start and length of segment i of a line of n code points; the last n % parts ones are one longer."""
    base, longer = F.floor(n / parts).cast("int"), n % parts
    start = base * i + F.greatest(longer - (parts - i), F.lit(0))
    return start, base + F.when(longer >= parts - i, 1).otherwise(0)


def _keys(edits: int) -> tuple[Column, int]:
    """array<key> of a line, and how many of them are its segments: the rest are the substrings it probes with.

    A segment is also the probe of lines of equal length at the same place.  Of two lines of equal length either may be the
    index, so up to two edits, where such lines differ by one insertion and one deletion, probes go one way only.
    """
    parts, n, points = edits + 1, F.col("n"), F.col("points")

    def key(length: Column, i: int, shift: int) -> Column:
        start, size = _segment(length, i, parts)
        return F.xxhash64(F.substring(points, (start + shift) * 4 + 1, size * 4), length, F.lit(i))

    out = [key(n, i, 0) for i in range(parts)]
    for less in range(edits + 1):
        for i in range(parts):
            low, high = max(-i, less - (parts - 1 - i)), min(i, less + (parts - 1 - i))
            if less == 0 and edits <= 2:
                low = 1
            out += [key(n - less, i, shift) for shift in range(low, high + 1) if less or shift]
    return F.array(*out), parts


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether texts a and b are at most `edits` edits of code points apart; null where either is null.

    Bit d + edits of part e of the state: after j code points of b, the first j + d of a are matched with at most e errors.
    A match stays on its diagonal, so does a substitution with one error more; a further code point of b goes one diagonal
    down, a left out one of a goes one up.
    """
    width = 2 * edits + 1
    if width * (edits + 1) > 63:
        raise ValueError("the states of so many edits don't fit into 64 bits")
    band = (1 << width) - 1

    def near(p: Column, t: Column) -> Column:
        bit = lambda c, j, d: F.when(F.get(p, j + d) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0))
        masks = F.transform(t, lambda c, j: sum((bit(c, j, d) for d in range(1 - edits, edits + 1)), bit(c, j, -edits)))

        def step(state: Column, mask: Column) -> Column:
            part = lambda e: F.shiftright(state, width * e).bitwiseAND(F.lit(band))
            out, below = part(0).bitwiseAND(mask), part(0).bitwiseAND(mask)
            for e in range(1, edits + 1):
                before = part(e - 1)
                here = part(e).bitwiseAND(mask).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(below, 1).bitwiseAND(F.lit(band)))
                out, below = out.bitwiseOR(F.shiftleft(here, width * e)), here
            return out

        begin = sum(((((1 << (e + 1)) - 1) << edits) & band) << (width * e) for e in range(edits + 1))
        place = F.size(p) - F.size(t) + edits
        end = F.aggregate(masks, F.lit(begin).cast("long"), lambda s, m: step(s, m.cast("long")))
        return F.when(place.between(0, 2 * edits), _let(end, lambda s: F.getbit(s, F.lit(width * edits) + place) == 1)).otherwise(F.lit(False))

    points = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return _let(points(a), lambda p: _let(points(b), lambda t: near(p, t)))


def _earliest(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows (key, probe, place) with the earliest line they meet, and how many members their list has.

    Segments meet all of their list, probes its segments.
    """
    at = F.struct(*PLACE)
    parts = [F.min(at).alias("all"), F.min(F.when(~F.col("probe"), at)).alias("segment"), F.count("*").alias("members")]
    cold = rows
    if hot is not None:
        rows = stored(rows)
        cold = rows.join(F.broadcast(hot), "key", "left_anti")
    whole = Window.partitionBy("key")
    lists = cold.select("*", *(p.over(whole).alias(n) for p, n in zip((F.min(at), F.min(F.when(~F.col("probe"), at)), F.count("*")), ("all", "segment", "members"))))
    if hot is not None:  # fewer than HOT_KEYS keys
        ends = stored(rows.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(*parts))
        lists = lists.unionByName(rows.join(F.broadcast(ends), "key"))
    return lists.withColumn("earliest", F.when(F.col("probe"), F.col("segment")).otherwise(F.col("all"))).withColumn("later", F.coalesce(F.col("earliest") < at, F.lit(False)))


def near_lines(lines: DataFrame, edit_chars: int = 40, edits: int = 2, broadcast_rows: int = 250_000, hot_members: int = 1 << 14) -> DataFrame:
    """Places (doc_id, digest, pos) of the distinct lines, given by place and line, that are within `edits` edits of an earlier one."""
    if edit_chars < 4 * (edits + 1):
        raise ValueError("edit_chars is too short for so many edits")
    keys, segments = _keys(edits)
    long_ = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= edit_chars)

    def keyed(some: DataFrame) -> DataFrame:
        rows = some.withColumn("points", F.encode("line", "UTF-32")).select(*PLACE, F.posexplode(keys).alias("i", "key"))
        return rows.select("key", *PLACE, (F.col("i") >= segments).alias("probe"))

    often = keyed(long_.where(F.pmod(F.xxhash64(*PLACE), F.lit(SAMPLE)) == 0)).groupBy("key").count()
    hot = stored(often)
    total = hot.agg(F.sum("count")).first()[0] or 0
    hot = hot.where(F.col("count") > max(hot_members // SAMPLE, total // HOT_KEYS)).select("key")
    lists = _earliest(keyed(long_), None if hot.isEmpty() else hot)
    met = stored(lists.where("later or (members > 2 and segment is not null)").select("key", "probe", *PLACE, "earliest", "later", "members"))
    near = stored(_verified(met.where("later").select(*PLACE, "earliest").distinct(), lines, edits, broadcast_rows))
    # lists with more than the earliest: only lines that aren't yet known as duplicates need the others
    rest = met.where("members > 2 and later").join(near, list(PLACE), "left_anti").select("key", "probe", *PLACE, "earliest")
    return near.unionByName(_near_in_lists(rest, met, lines, edits, broadcast_rows)).distinct()


def _near_in_lists(rest: DataFrame, met: DataFrame, lines: DataFrame, edits: int, broadcast_rows: int) -> DataFrame:
    """Places of rest with an earlier line of their lists within the threshold, verified where the lists meet.

    An edit changes the counts of characters in CLASSES classes by two in all at most, which is looked at first.  Texts go
    along with the lists that have such lines, so no pairs are written; within a list, all of them are compared.
    """
    rest = stored(rest)
    members = stored(met.join(rest.select("key").distinct(), "key", "left_semi").select("key", "probe", *PLACE))

    def count(k: int) -> Column:
        return F.size(F.filter("codes", lambda c: c == k)).alias(f"c{k}")

    codes = F.transform(F.split("line", ""), lambda c: F.ascii(c) % CLASSES)
    wanted = stored(members.select(*PLACE).distinct())
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    counted = lines.select(*PLACE, "line").join(wanted, list(PLACE)).withColumn("codes", codes)
    counts = stored(counted.select(*PLACE, "line", *(count(k) for k in range(CLASSES))))
    one = rest.join(counts, list(PLACE)).withColumn("place", F.struct(*PLACE))
    two = members.join(counts, list(PLACE)).select(F.col("key").alias("list"), F.col("probe").alias("other"), F.struct(*PLACE).alias("before"), F.col("line").alias("line_before"), *(F.col(f"c{k}").alias(f"d{k}") for k in range(CLASSES)))
    apart = sum((F.abs(F.col(f"c{k}") - F.col(f"d{k}")) for k in range(1, CLASSES)), F.abs(F.col("c0") - F.col("d0")))
    both = one.join(two, (F.col("key") == F.col("list")) & (F.col("before") < F.col("place")) & (F.col("before") != F.col("earliest")) & ~(F.col("probe") & F.col("other")) & (apart <= 2 * edits) & within(F.col("line"), F.col("line_before"), edits))
    return both.select("place.*").distinct()


def _verified(pairs: DataFrame, lines: DataFrame, edits: int, broadcast_rows: int) -> DataFrame:
    """Places of lines with a pair within the threshold.  Few candidates are sent to the lines, many meet them in a shuffle."""
    pairs = stored(pairs)
    place = F.struct(*PLACE)
    wanted = pairs.select(F.explode(F.array(place, F.col("earliest"))).alias("p")).select("p.*").distinct()
    if pairs.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    texts = stored(lines.select(*PLACE, "line").join(wanted, list(PLACE)))
    both = pairs.join(texts, list(PLACE)).join(texts.select(place.alias("earliest"), F.col("line").alias("before")), "earliest")
    return both.where(within(F.col("line"), F.col("before"), edits)).select(*PLACE).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 20, **options) -> DataFrame:
    """docs with the duplicate lines cut out of text, and n_lines and dropped (numbers of the cut lines, ascending).

    Rows of equal doc_id and text count as one document and stay alike; rows of one doc_id with other texts are documents of
    their own.  Rows with a null doc_id or null text stay as they are and make no line a duplicate.  Columns of docs named
    n_lines or dropped are replaced.  Repeated lines within a document go too.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "dropped")]
    several = _several(docs)
    plain = _told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), several, "digest")
    found = _lines(plain, min_chars).withColumn("hash", F.xxhash64("line"))
    occurrences = stored(found.select(*PLACE, "hash"))
    lines = stored(found.groupBy("hash").agg(F.min(F.struct(*PLACE, "line")).alias("first")).select("hash", "first.*"))
    near = near_lines(lines, **options).withColumn("near", F.lit(True))
    first = lines.select("hash", *PLACE).join(near, list(PLACE), "left").select("hash", F.struct(*PLACE).alias("first"), "near")
    again = F.col("near").isNotNull() | (F.struct(*PLACE) != F.col("first"))
    cut = occurrences.join(first, "hash").where(again).groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    # what is cut grows with the corpus, so it isn't broadcast
    cut = cut.select(F.col("doc_id").alias("__cut"), F.col("digest").alias("__cut_digest"), "dropped").hint("merge")
    whole = F.col("text").cast("string")
    rows = _told_apart(docs.select(*keep), several, "__digest").join(cut, (F.col("doc_id").cast("long") == F.col("__cut")) & (F.col("__digest") == F.col("__cut_digest")), "left")
    split = F.split(whole, "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n")
    return rows.select(*(F.when(F.col("dropped").isNotNull(), left).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in keep), F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """The query: per document the numbers of lines and of cut lines, which ones, and a digest of the text that is left."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
