"""Winnowing fingerprints of whole texts, with DataFrame functions only.

A text's code points (as UTF-32 bytes, so that the k-gram at position i is a constant-time slice) give rolling k-gram
hashes; of every window of w consecutive hashes the least is chosen, the rightmost of equal ones.  Any match of at least
w + k - 1 code points therefore shares a chosen hash, and the kept positions say where.

A chosen hash and its position are one long: 33 bits of hash above 31 bits of (2^31 - 1 - position), so that the minimum
of longs is the rule above, for the longest texts that there can be.  Window minima
come from log2(w) element-wise passes over arrays.  Texts of fewer than w hashes have one window, shorter texts than k one
hash, empty and null texts none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BITS = 31
_LOW = (1 << _BITS) - 1


def _let(value: Column, f) -> Column:
    """f(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _minima(points: Column, n: Column, start: Column, k: int, w: int) -> Column:
    """Minima of the windows that begin at gram `start` or later; points: UTF-32 bytes of n code points."""

    def packed(data: Column, i: Column) -> Column:
        return F.xxhash64(F.substring(data, i * 4 + 1, F.lit(4 * k))).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i.cast("long"))

    def halves(m: Column, step: int) -> Column:
        if step >= w:
            return m
        return _let(F.transform(F.slice(m, 1, F.size(m) - step), lambda x, i: F.least(x, F.get(m, i + step))), lambda x: halves(x, 2 * step))

    last = F.greatest(n - k, F.lit(0))  # a text shorter than k has one gram, all of it
    # the bytes are made once a row: within the inner function they would be made for every gram
    grams = F.when((n > 0) & (last >= start), _let(points, lambda data: F.transform(F.sequence(start, last), lambda i: packed(data, i)))).otherwise(_longs())

    def windows(m: Column) -> Column:
        whole = F.when((start == 0) & (F.size(m) > 0), F.array(F.array_min(m))).otherwise(_longs())
        return F.when(F.size(m) >= w, halves(m, 1)).otherwise(whole)

    return _let(grams, windows)


def _check(k: int, w: int) -> None:
    if k < 1 or w < 1 or w & (w - 1):
        raise ValueError("k must be positive and w a power of two")


def chosen(text: Column, k: int = 8, w: int = 8) -> Column:
    """array<long> of the chosen (hash, position) pairs of a text, in text order."""
    _check(k, w)
    return F.array_distinct(_let(F.coalesce(text, F.lit("")), lambda t: _minima(F.encode(t, "UTF-32"), F.char_length(t), F.lit(0), k, w)))


def hash_of(pair: Column) -> Column:
    return F.shiftright(pair, _BITS)


def position_of(pair: Column) -> Column:
    return F.lit(_LOW) - pair.bitwiseAND(F.lit(_LOW))


def _hashes(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, hash_of))


def _likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def digest(pairs: Column) -> Column:
    """Short text of a fingerprint: 128 bits of its whole list of hashes and positions."""
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(pairs)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), pairs)), 16, "0")))


def fingerprints(docs: DataFrame, k: int = 8, w: int = 8) -> DataFrame:
    """(doc_id, n_chars, hashes, positions) of every row, aligned arrays in text order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), chosen(text, k, w).alias("_pairs"))
    return rows.select("doc_id", "n_chars", F.transform("_pairs", hash_of).alias("hashes"), F.transform("_pairs", position_of).alias("positions"))


def _ranges(docs: DataFrame) -> list[int]:
    """First keys of about two ranges of rows a shuffle partition; the least key is the first."""
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = docs.agg(F.min("_key").alias("least"), F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n).alias("more")).first()
    return [] if got.least is None else sorted({got.least, *got.more})


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows by ranges of doc_id in one shuffle, each range ending with a copy of the row that follows it.

    Returns the rows with _real (not a copy) and the window in which lead() is the next row in ascending doc_id; after the
    last row comes the first.  Null doc_ids come first, rows of equal doc_id go by text.
    """
    keyed = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    first = _ranges(keyed)
    step = max(1, math.isqrt(len(first)))
    if first:
        all_, coarse = F.lit(first), F.lit(first[::step])
        block = F.size(F.filter(coarse, lambda b: b <= F.col("_key"))) - 1
        own = block * step + F.size(F.filter(F.slice(all_, block * step + 1, F.lit(step)), lambda b: b <= F.col("_key"))) - 1
        keyed = keyed.withColumn("_range", own).withColumn("_starts", F.get(all_, F.col("_range")) == F.col("_key"))
    else:
        keyed = keyed.withColumn("_range", F.lit(0)).withColumn("_starts", F.lit(False))
    real = F.struct(F.col("_range").alias("at"), F.lit(True).alias("real"), F.lit(False).alias("wrap"))
    copy = F.struct(F.pmod(F.col("_range") - 1, F.lit(max(1, len(first)))).alias("at"), F.lit(False).alias("real"), (F.col("_range") == 0).alias("wrap"))
    rows = keyed.withColumn("_place", F.explode(F.when(F.col("_starts"), F.array(real, copy)).otherwise(F.array(real))))
    rows = rows.select("doc_id", "text", "_key", F.col("_place.at").alias("_at"), F.col("_place.real").alias("_real"), F.col("_place.wrap").alias("_wrap"))
    return rows, Window.partitionBy("_at").orderBy("_wrap", "_key", "text", F.desc("_real"))


def compare_edited(docs: DataFrame, k: int = 8, w: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row;
    null texts are empty, columns other than doc_id and text are ignored, an empty table gives no rows.
    """
    _check(k, w)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, order = with_next(docs)
    rows = rows.withColumn("_next", F.lead("text").over(order))
    n = F.char_length("text")
    cut = n - F.floor(n / 4).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_cut", cut)
    edited = F.concat(F.substring("text", F.lit(1), F.col("_cut")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), F.col("_n") - F.col("_cut")))
    rows = rows.withColumn("_edited", edited)
    rows = rows.withColumn("_minima", _minima(F.encode("text", "UTF-32"), F.col("_n"), F.lit(0), k, w))
    # windows within the kept part are those of the text itself
    kept = F.greatest(F.col("_cut") - (k + w - 2), F.lit(0))
    again = _let(F.encode("_edited", "UTF-32"), lambda p: _let(F.char_length("_edited"), lambda m: _minima(p, m, kept, k, w)))
    rows = rows.withColumn("_pairs", F.array_distinct("_minima")).withColumn("_edited_pairs", F.when(F.col("_real"), F.array_distinct(F.concat(F.slice("_minima", F.lit(1), kept), again))))
    rows = rows.select("_at", "_wrap", "_key", "text", "_real", "doc_id", "_n", F.sha2("_edited", 256).alias("edited_sha256"), digest(F.col("_pairs")).alias("fingerprint"), digest(F.col("_edited_pairs")).alias("edited_fingerprint"), _hashes(F.col("_pairs")).alias("_h"), _hashes(F.col("_edited_pairs")).alias("_e"))
    rows = rows.withColumn("_next_h", F.lead("_h").over(order)).where("_real")
    return rows.select("doc_id", F.col("_n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", _likeness(F.col("_h"), F.col("_e")).alias("near_edited"), _likeness(F.col("_h"), F.col("_next_h")).alias("near_next"))
