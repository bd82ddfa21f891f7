"""Personal data and secrets in whole texts by candidate gradient boosting, with DataFrame functions only.

Base patterns with their checks give spans that always count.  High-recall generators propose further, overlapping spans
(mail-like, masked mail, numbers, dotted quads, bank accounts, long tokens).  What fails its check digits, part limits or
grammar is no candidate.  Each candidate has a bit mask of format and context predicates.  Boosted trees learn from all
candidates, labelled by evidence that the predicates don't hold: a country code or a word for telephones before a number (the
number is judged without its code), a check passed, an assignment to a name like key or token.  So a candidate without such evidence is judged by how often its
form and surroundings have it.  Masks are bounded (2^len(PREDICATES)), so what the trees are fitted on is one small table of
counts per mask, taken over the whole corpus by Spark; the fitted trees go back into the plan as an SQL expression.
Thresholds are calibrated per kind on the half of the documents that the trees are not fitted on; a kind with fewer than 20
candidates there has nothing to calibrate with and keeps 0.9.  Overlaps go to the
likelier candidate; base spans win.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from .winnowing import _let

KINDS = ("email", "ip", "card", "phone", "iban", "secret")

# A match can only begin where a run begins, or right where the match before ended: (\G|no such byte before) finds the
# same leftmost matches as the plain pattern, without trying every place of a long run.  Possessive loops neither go back
# (nothing after them could match what they took) nor recurse, so very long runs are safe.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a chain of digits is matched from its first one to its last, so chains of other lengths than the check's can be left out
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "mail": (r"(?:\G|(?<![^\s@,;:<>()\[\]\"']))[^\s@,;:<>()\[\]\"']++@[^\s@,;:<>()\[\]\"']++", "email"),
    "masked": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]+\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,}", "email"),
    "number": (r"(?:\G|(?<![0-9]))\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", "number"),
    "quad": (r"(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++){3}+", "ip"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", "iban"),
    "token": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+", "secret"),
}
PREDICATES = (
    *GENERATORS, "separators", "bracket", "groups of four", "digits<8", "digits<10", "digits<13", "digits=16", "digits>19",
    "after a word", "before a word", "cue before", "long", "hexadecimal", "both cases",
)
CUES = r"(?i)(mail|card|visa|pay|account|iban|ip|host|server|contact)[^\n]{0,20}$"
PHONES = r"(?i)\b(tel|t\u00e9l|phone|telefon|call|mobile|fax)[^\n0-9]{0,12}$"
NAMES = r"(?i)(token|key|secret|passw(or)?d|pwd|auth|credentials?)[\"']?\s*(:|=|=>|is)\s*[\"']?$"


_STEP = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    odd = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _let(F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(odd, F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: _let(F.regexp_replace(p, "^0+(?=.)", ""), lambda v: (F.length(v) <= 3) & (F.coalesce(v.try_cast("int"), F.lit(999)) <= 255)))


def _iban(x: Column) -> Column:
    """The account number, its first four signs moved to the end and letters counted from 10, is 1 modulo 97."""
    plain = F.regexp_replace(x, " ", "")
    signs = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    code = F.transform(signs, lambda c: _let(F.ascii(c), lambda a: F.when(a < 58, a - 48).otherwise(a - 55)))
    return F.aggregate(code, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: _let(_digits(m), lambda d: F.length(d).between(14, 19) & _luhn(d)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match,left,right>> of the matches of a pattern, in code points; left and right are context."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def spans(found: Column) -> Column:
        def located(between: Column, sizes: Column, sums: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                left, right, whole = F.get(between, i), F.get(between, i + 1), (i / _STEP).cast("int")
                start = total(F.slice(sums, F.lit(1), whole)) + total(F.slice(sizes, whole * _STEP + 1, i % _STEP)) + F.char_length(left)
                return _let(start, lambda s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match"), F.substring(left, F.greatest(F.char_length(left) - 29, F.lit(1)), F.lit(30)).alias("left"), F.substring(right, 1, 2).alias("right")))

            return F.transform(found, span)

        def one(between: Column) -> Column:
            # sizes of matches with what is before them, and their sums by steps, so that many matches cost few additions each
            sizes = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(F.get(between, i)))
            return _let(sizes, lambda z: _let(F.transform(F.sequence(F.lit(0), (F.size(z) / _STEP).cast("int")), lambda b: total(F.slice(z, b * _STEP + 1, F.lit(_STEP)))), lambda sums: located(between, z, sums)))

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), one)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,left:string,right:string>>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _mask(name: str, c: Column) -> Column:
    form = F.regexp_replace(c.match, r"^\+[0-9]{1,3}(?![0-9])[\x20.-]?", "")  # without a country code, which is what tells
    digits = F.length(_digits(form))
    bits = [F.lit(name == g) for g in GENERATORS] + [
        form.rlike(r"[0-9][\x20().-]+[0-9]"), form.rlike(r"\([0-9]"), form.rlike(r"^[0-9]{4}[\x20-][0-9]{4}"), digits < 8, digits < 10, digits < 13, digits == 16, digits > 19,
        c.left.rlike(r"\w$"), c.right.rlike(r"^\w"), c.left.rlike(CUES), F.char_length(c.match) > 24, c.match.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), c.match.rlike("[a-z]") & c.match.rlike("[A-Z]"),
    ]
    total = F.lit(0)
    for i, b in enumerate(bits):
        total = total + F.when(b, 1 << i).otherwise(0)
    return total


def _kind(name: str, c: Column) -> Column:
    if GENERATORS[name][1] != "number":
        return F.lit(GENERATORS[name][1])
    return F.when(F.length(_digits(c.match)) >= 14, "card").otherwise("phone")


def _possible(name: str, c: Column) -> Column:
    """What fails its grammar, its part limits or its check digits is no candidate: no tree can let it through."""
    match name:
        case "mail":
            return c.match.rlike("^" + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}" + "$")
        case "quad":
            return _octets(c.match)
        case "iban":
            return _iban(c.match)
        case "number":
            return _let(_digits(c.match), lambda d: (F.length(d) < 14) | ((F.length(d) <= 19) & _luhn(d)))
    return F.lit(True)


def _valid(name: str, c: Column) -> Column:
    """Evidence for a possible candidate; what has passed a check has it, open cases need it from around them."""
    if name == "token":
        return c.left.rlike(NAMES)
    if name != "number":
        return F.lit(True)
    digits = _digits(c.match)
    told = (c.match.startswith("+") & (F.length(digits) >= 10)) | (c.left.rlike(PHONES) & (F.length(digits) >= 8))
    return F.when(F.length(digits) >= 14, True).otherwise(told)


def spans_and_candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, base and candidates of every row.  Texts without a digit, an @ or an (at) are passed over at once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(r"[0-9@]|[\(\[]at[\)\]]|\sat\s\S+\sdot\s"), text).alias("text"), *keep)

    def base(kind: str, order: int) -> Column:
        found = F.filter(_matches(F.col("text"), BASE[kind]), lambda c: CHECKS[kind](c.match))
        return F.transform(found, lambda c: F.struct(c.start.alias("start"), F.lit(order).alias("order"), c.end.alias("end")))

    def proposed(name: str) -> Column:
        def full(c: Column) -> Column:
            kind = _kind(name, c)
            order = F.coalesce(*(F.when(kind == k, i) for i, k in enumerate(KINDS)))
            return F.struct(c.start.alias("start"), order.alias("order"), c.end.alias("end"), _mask(name, c).alias("mask"), _valid(name, c).alias("valid"))

        return F.transform(F.filter(_matches(F.col("text"), GENERATORS[name][0]), lambda c: _possible(name, c)), full)

    some = lambda column, kind: F.when(F.col("text").isNotNull(), column).otherwise(F.array().cast(kind))
    spans = F.concat(*(base(k, i) for i, k in enumerate(KINDS[:4])))
    candidates = F.concat(*(proposed(g) for g in GENERATORS))
    return docs.select(
        "doc_id",
        *keep,
        some(F.array_sort(spans), "array<struct<start:int,order:int,end:int>>").alias("base"),
        some(candidates, "array<struct<start:int,order:int,end:int,mask:int,valid:boolean>>").alias("candidates"),
    )


class Trees:
    """Newton boosting of trees of two levels over bits, on masks with counts of valid and invalid candidates."""

    def __init__(self, mask: np.ndarray, valid: np.ndarray, invalid: np.ndarray, rounds: int = 30, rate: float = 0.3):
        bits = (mask[:, None] >> np.arange(len(PREDICATES))) & 1
        total = valid + invalid
        self.bias = float(np.log((valid.sum() + 0.5) / (invalid.sum() + 0.5)))
        self.trees: list[tuple] = []
        score = np.full(len(mask), self.bias)
        for _ in range(rounds if len(mask) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = valid - total * p, total * p * (1 - p)

            def leaf(rows):
                return float(g[rows].sum() / (h[rows].sum() + 1.0))

            def gain(rows):
                return g[rows].sum() ** 2 / (h[rows].sum() + 1.0)

            def split(rows):
                each = [gain(rows & (bits[:, b] > 0)) + gain(rows & (bits[:, b] == 0)) for b in range(bits.shape[1])]
                return int(np.argmax(each))

            all_ = np.ones(len(mask), bool)
            root = split(all_)
            tree = [root]
            for side in (1, 0):
                rows = all_ & (bits[:, root] == side)
                b = split(rows)
                on, off = rate * leaf(rows & (bits[:, b] > 0)), rate * leaf(rows & (bits[:, b] == 0))
                tree.append((b, on, off))
                score = score + np.where(rows, np.where(bits[:, b] > 0, on, off), 0)
            self.trees.append(tuple(tree))

    def probability(self, mask: np.ndarray) -> np.ndarray:
        score = np.full(len(mask), self.bias)
        for root, one, zero in self.trees:
            for side, (b, on, off) in ((1, one), (0, zero)):
                score = score + np.where((mask >> root) & 1 == side, np.where((mask >> b) & 1 == 1, on, off), 0)
        return 1 / (1 + np.exp(-score))

    def column(self, mask: Column) -> Column:
        bit = lambda b: mask.bitwiseAND(F.lit(1 << b)) != 0
        score = F.lit(self.bias)
        for root, one, zero in self.trees:
            part = [F.when(bit(b), F.lit(on)).otherwise(F.lit(off)) for b, on, off in (one, zero)]
            score = score + F.when(bit(root), part[0]).otherwise(part[1])
        return 1 / (1 + F.exp(-score))


def fit(rows: DataFrame, precision: float = 0.8) -> tuple[Trees, list[float]]:
    """Trees and a threshold per kind: the least probability from which up the other half's valid share is `precision`."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    c = rows.select(half, F.explode("candidates").alias("c")).select("half", "c.mask", "c.order", "c.valid")
    counts = c.groupBy("half", "mask", "order").agg(F.count_if("valid").alias("yes"), F.count_if(~F.col("valid")).alias("no")).collect()
    table = np.asarray(sorted((r.half, r.mask, r.order, r.yes, r.no) for r in counts), np.int64).reshape(-1, 5)
    fitted, other = table[table[:, 0] == 0], table[table[:, 0] == 1]
    trees = Trees(fitted[:, 1], fitted[:, 3].astype(float), fitted[:, 4].astype(float))
    thresholds = []
    for kind in range(len(KINDS)):
        own = other[other[:, 2] == kind]
        p = trees.probability(own[:, 1])
        rank = np.argsort(-p, kind="stable")
        yes, no = np.cumsum(own[rank, 3]), np.cumsum(own[rank, 4])
        last = np.append(p[rank][1:] != p[rank][:-1], True) if len(p) else np.zeros(0, bool)
        good = np.flatnonzero(last & (yes >= precision * (yes + no)) & (yes + no >= 20))
        thresholds.append(float(p[rank][good[-1]]) - 1e-9 if len(good) else 0.9)
    return trees, thresholds


def _judged(rows: DataFrame) -> Column:
    """All spans of a row: the base ones, and candidates that are likely enough and meet no likelier one."""
    trees, thresholds = fit(rows)
    enough = lambda c: F.element_at(F.lit(thresholds), c.order + 1)
    scored = F.transform("candidates", lambda c: F.struct((-trees.column(c.mask)).alias("p"), c.start.alias("start"), c.order.alias("order"), c.end.alias("end")))
    likely = F.array_sort(F.filter(scored, lambda c: -c.p >= enough(c)))
    kind = "array<struct<start:int,order:int,end:int>>"
    clear = lambda spans, c: ~F.exists(spans, lambda s: (s.start < c.end) & (c.start < s.end))
    plain = lambda c: F.struct(c.start.alias("start"), c.order.alias("order"), c.end.alias("end"))
    return F.aggregate(likely, F.col("base").cast(kind), lambda spans, c: F.when(clear(spans, c), F.concat(spans, F.array(plain(c)))).otherwise(spans))


def find(docs: DataFrame) -> DataFrame:
    """Per row: counts of base spans by kind, the digest of the base spans, how many spans in all, and all as kind:start:end.

    Null and empty texts have no spans; null doc_ids and repeated rows are kept; other columns are ignored; an empty table
    gives no rows.
    """
    rows = stored(spans_and_candidates(docs))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.lit(list(KINDS)), s.order + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s.order == i)).cast("long").alias(f"n_{KINDS[i]}")
    out = rows.select("doc_id", *(count(i) for i in range(4)), "base", _judged(rows).alias("all"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(text(F.col("base")), 256).alias("base_sha256"), F.size("all").cast("long").alias("n_spans"), text(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by <kind>.  Of spans that overlap, the rest of the later ones goes, too.

    Every row is searched and cut by itself, so repeated rows and null doc_ids are treated like others; null texts stay
    null, an empty table gives no rows, and all other columns stay as they are.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = stored(spans_and_candidates(docs.select("doc_id", "text", rest), "row"))
    text = F.col("row.text").cast("string")

    def cut(a: Column, s: Column) -> Column:
        between = F.substring(text, a.at + 1, F.greatest(s.start - a.at, F.lit(0)))
        mark = F.when(s.start >= a.at, F.concat(F.lit("<"), F.element_at(F.lit(list(KINDS)), s.order + 1), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.concat(a.text, between, mark).alias("text"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    clean = F.aggregate(F.array_sort("all"), begin, cut, lambda a: F.concat(a.text, F.substring(text, a.at + 1, F.char_length(text))))
    rows = rows.withColumn("all", _judged(rows))
    return rows.select(*(F.when(F.size("all") > 0, clean).otherwise(text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
