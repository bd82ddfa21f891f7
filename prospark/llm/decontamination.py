"""Benchmark decontamination by template canonicalisation: finds quoted and re-parameterised benchmark items.

A text becomes a stream of template tokens: words without outer punctuation and case, where numbers (digits or spelled),
units after numbers, and names (capitalised words inside a sentence, not all capitals, neighbours merged) are typed placeholders whose
values are kept as slots.  Windows of `window` template tokens are hashed; windows of documents are joined by hash with
those of the benchmark.  A fixed-size bitmap of the benchmark's windows keeps all but a few other windows out of the
join, whatever the sizes.  A document and an item match when enough different windows of the item occur in the document
and the slots agree: along one alignment, equal values of the item stand for equal values of the document.

Names are told by their capitals, so a copy in another case has other template tokens.  Texts therefore also give windows
of their plain words (lower-cased runs of letters and digits, no placeholders), and enough of these are a match, too.
What is both re-parameterised and in another case is found only where windows hold no names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._words import Block, blocks, hashes, mix

# Spelled numbers and units that stand for placeholders.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
)
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres centimeter centimeters mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years mph kmh percent degree degrees dollar dollars euro euros cent cents usd eur gbp"
)
WORDS = 3  # of a template window, whatever its placeholders; windows of fewer tokens are all words
BITS = 1 << 25
BLOCK = 1 << 20  # bytes of whole texts that a task looks at together
_NUM, _UNIT, _NAME = 1, 2, 3
_TEMPLATE, _PLAIN, _INSIDE, _COUNTED = range(4)
_MARKS = mix(np.arange(4).astype(np.uint64), 31)


def _word_hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    block = Block(data, np.asarray([0, len(data)]), 0).words()
    return np.sort(block.hash())


_NUMBERS, _UNITS = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def template(block: Block, form: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of a block's texts: token hash, kind (0: a word), value hash, and the text each is of.

    form: how the first word of a text is read: at the start of a sentence, inside one, or after a number.
    """
    block.words()
    raw = block.raw
    if not len(block.starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = block.buf.copy()
    after = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[after] += 0x20
    digit = (raw >= 0x30) & (raw <= 0x39)
    good = digit | ((low >= 0x61) & (low <= 0x7A)) | (raw >= 0x80)
    place = np.arange(len(raw))
    ahead = np.minimum.accumulate(np.where(good, place, len(raw))[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(good, place, -1))
    start, end = ahead[block.starts], behind[block.ends - 1] + 1
    text = np.repeat(np.arange(block.n), np.diff(block.bounds))
    has = start < end
    # a sentence ends with . ! ? or : at the end of a word, or with a line
    stop = np.isin(raw[block.ends - 1], (0x2E, 0x21, 0x3F, 0x3A))
    lines = np.concatenate(([0], np.cumsum(raw == 0x0A)))
    opens = np.ones(len(start), bool)
    opens[1:] = stop[:-1] | (text[1:] != text[:-1]) | (lines[block.starts[1:]] != lines[block.ends[:-1]])
    start, end, text, opens = start[has], end[has], text[has], opens[has]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = np.ones(len(start), bool)  # the first word of a text
    head[1:] = text[1:] != text[:-1]
    if form == _INSIDE:
        opens &= ~head
    value = hashes(low, start, end)
    upper = ((raw[start] >= 0x41) & (raw[start] <= 0x5A)) | ((raw[start] == 0xC3) & (raw[np.minimum(start + 1, len(raw) - 1)] >= 0x80) & (raw[np.minimum(start + 1, len(raw) - 1)] <= 0x9E))
    small = (raw >= 0x61) & (raw <= 0x7A)
    small[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x9F)
    small = np.concatenate(([0], np.cumsum(small)))
    kind = np.zeros(len(start), np.int8)
    kind[upper & ~opens & (small[end] > small[start])] = _NAME  # a word all in capitals isn't told to be a name
    kind[digit[start] | _in(value, _NUMBERS)] = _NUM
    unit = _in(value, _UNITS)
    counted = np.zeros(len(start), bool)
    counted[1:] = (kind[:-1] == _NUM) & ~head[1:]
    unit &= counted | head if form == _COUNTED else counted
    kind[unit] = _UNIT
    again = np.zeros(len(start), bool)  # a further part of a name
    again[1:] = (kind[1:] == _NAME) & (kind[:-1] == _NAME) & (text[1:] == text[:-1])
    token = np.where(kind > 0, _MARKS[kind], value)
    keep = ~again
    return token[keep], kind[keep], value[keep], text[keep]


def plain(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plain words of a block of lower-cased texts, as template() gives its tokens."""
    raw = block.raw
    good = ((raw >= 0x30) & (raw <= 0x39)) | ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    mark = np.flatnonzero((raw[:-1] == 0xC2) & ~np.isin(raw[1:], (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE)))
    good[mark] = good[mark + 1] = False  # Latin-1 signs
    mark = np.flatnonzero(((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)) | ((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80) & (raw[2:] <= 0x83)))
    good[mark] = good[mark + 1] = good[mark + 2] = False  # dashes, quotes and ideographic stops
    edge = np.zeros(len(raw) + 1, bool)
    edge[block.offsets] = True
    before, after = good & edge[:-1], good & edge[1:]
    before[1:] |= good[1:] & ~good[:-1]
    after[:-1] |= good[:-1] & ~good[1:]
    start, end = np.flatnonzero(before), np.flatnonzero(after) + 1
    value = hashes(raw, start, end)
    return value, np.zeros(len(start), np.int8), value, np.searchsorted(block.offsets, start, "right") - 1


def _windows(token: np.ndarray, kind: np.ndarray, text: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every window of `size` tokens of one text that holds WORDS words, or nothing else."""
    n = max(0, len(token) - size + 1)
    factor = mix(np.arange(size).astype(np.uint64), 32 + size) | np.uint64(1)
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            value += token[j : j + n] * factor[j]
    slots = np.concatenate(([0], np.cumsum(kind > 0)))
    ok = (text[:n] == text[size - 1 :][:n]) & (size - (slots[size:][:n] - slots[:n]) >= min(size, WORDS))
    return np.flatnonzero(ok), mix(value, 33 + salt)[ok]


def _forms(block: Block, column: pa.Array, item: bool):
    """(form, tokens) of a block of the column: its template tokens and its plain words; for items, also other first tokens.

    Inside a sentence a capitalised first word is a name, which goes on in names after it, and after a number a unit.
    """
    for form in (_TEMPLATE, _INSIDE, _COUNTED) if item else (_TEMPLATE,):
        yield form, template(block, form)
    low = pc.utf8_lower(column.slice(block.first, block.n).cast(pa.large_string()))
    yield _PLAIN, plain(next(blocks(low, 1 << 40)))


def _rows(ids: pa.Array, column: pa.Array, sizes: list[int], own_size: bool, most: int, keep):
    """(id, form, position, hash, slots, of, need, size) batches; own_size: a text of fewer than `most` tokens gives one window, itself.

    of: the text's windows; need: those that touch neither its first nor its last token, which may differ in a copy, or one.
    """
    for block in blocks(column, BLOCK):
        for form, (token, kind, value, text) in _forms(block, column, own_size):
            count = np.bincount(text, minlength=block.n) if len(text) else np.zeros(block.n, np.int64)
            begin = np.concatenate(([0], np.cumsum(count)))
            for size in sizes:
                first, found = _windows(token, kind, text, size, int(form == _PLAIN))
                if own_size and size < most:
                    ok = count[text[first]] == size
                    first, found = first[ok], found[ok]
                owner = text[first]
                of = np.bincount(owner, minlength=block.n)
                need = np.bincount(owner[(first > begin[owner]) & (first + size < begin[owner + 1])], minlength=block.n)
                ok = keep(found)
                first, found = first[ok], found[ok]
                if not len(first):
                    continue
                spot = first[:, None] + np.arange(size)
                slot = kind[spot] > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(slot.sum(1)))), pa.int32()), pa.array(value[spot[slot]].view(np.int64)))
                owner = text[first]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + block.first)), pa.array(np.full(len(first), form)), pa.array((first - begin[owner]).astype(np.int64)), pa.array(found.view(np.int64)), lists, pa.array(of[owner]), pa.array(np.maximum(need[owner], 1)), pa.array(np.full(len(first), size))], ["id", "form", "position", "hash", "slots", "of", "need", "size"])


_SCHEMA = "id long, form long, position long, hash long, slots array<long>, of long, need long, size long"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 6) -> DataFrame:
    """One row per contaminated (doc_id, item_id): matched windows, those of the item, slot values, and where it starts.

    A window of the template counts if it holds three words, or words only.  A pair counts when at least min(least, windows of the item that
    touch neither its first nor its last token; one at least) different windows of the item match along alignments whose
    slots agree, or of its plain words, which are all that items of placeholders have; what is told is of the template
    where that matches.  Items of fewer than `window` tokens are one window: a word or two are
    found wherever they stand.  Items of placeholders with fewer words are found by their plain words.  Null
    texts and null ids match nothing, repeated rows of a document count once, other columns are ignored.
    """

    def items(batches):
        for batch in batches:
            yield from _rows(batch.column(0), batch.column(1), list(range(1, window + 1)), True, window, lambda h: np.ones(len(h), bool))

    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(items, _SCHEMA)
    asked = stored(asked)
    sizes = sorted(r.size for r in asked.select("size").distinct().collect())  # of 1 to `window`, those that items have
    bit = F.pmod(F.col("hash"), F.lit(BITS))
    bitmap = np.zeros(BITS // 8, np.uint8)
    for r in asked.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("bucket")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect():
        bitmap[r.bucket * 4096 : r.bucket * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def texts(batches):
        def keep(h: np.ndarray) -> np.ndarray:
            b = (h % np.uint64(BITS)).astype(np.int64)  # BITS is a power of two: the same as pmod of the signed value
            return (sent.value[b >> 3] >> (b & 7)) & 1 == 1

        for batch in batches:
            yield from _rows(batch.column(0), batch.column(1), sizes, False, window, keep)

    found = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string"))).mapInArrow(texts, _SCHEMA)
    both = found.select(F.col("id").alias("doc_id"), "hash", F.col("position").alias("at"), F.col("slots").alias("doc_slots")).join(asked.select(F.col("id").alias("item_id"), "form", "hash", "position", "slots", "of", "need"), "hash")
    both = stored(both.withColumn("shift", F.col("at") - F.col("position")))  # read twice, texts once
    # along one alignment, a value of the item may stand for one value of the document only
    line = ["doc_id", "item_id", "form", "shift"]
    pairs = both.where(F.size("slots") > 0).select(*line, F.explode(F.arrays_zip("slots", "doc_slots")).alias("p")).groupBy(*line, F.col("p.slots").alias("v")).agg((F.min("p.doc_slots") == F.max("p.doc_slots")).alias("one"))
    slots = pairs.groupBy(*line).agg(F.bool_and("one").alias("agree"), F.count("*").alias("values"))
    lines = both.groupBy(*line).agg(F.collect_set("position").alias("positions"), F.max("of").alias("of"), F.max("need").alias("need"), F.min("at").alias("at"))
    good = lines.join(slots, line, "left").where(F.coalesce("agree", F.lit(True)))
    told = good.groupBy("doc_id", "item_id", "form").agg(F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("long").alias("n_windows"), F.max("of").alias("item_windows"), F.max("need").alias("need"), F.coalesce(F.max("values"), F.lit(0)).cast("long").alias("n_slot_values"), F.min("at").alias("first_token"))
    enough = told.where(F.col("n_windows") >= F.least(F.lit(least), "need"))
    return enough.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", "n_windows", "item_windows", "n_slot_values", "first_token")).alias("m")).select("doc_id", "item_id", "m.n_windows", "m.item_windows", "m.n_slot_values", "m.first_token")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that match an item; all columns stay, rows of a null doc_id stay."""
    hit = matches(docs, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, F.col("doc_id").cast("long") == F.col("_hit"), "left_anti")
