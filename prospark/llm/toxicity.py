"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

The lexicon is learned: words and word stems that are much more frequent in toxic than in clean training texts.  Whole
words also match misspelled: a sign or digit in the place of a letter costs one, any other edit and a swap of two neighbours
two, and words of 3 letters may cost one, from 5 two, from 9 four.  Edits are of characters, the first one included.  The automata of all words are run together as sets of (trie node, edits) pairs; sets met
before are states of a table, so all distinct words of a block step through it side by side, a character at a time.
A hit is told by its surroundings: inside quotation marks or near a word of saying it is a quotation, near a second person
it is directed.  A logistic regression on counts, weights and densities of hits by context gives the score.

Labels are used on a bounded sample only: up to `toxic` and `clean` training rows, by the smallest hashes of doc_id; one
half teaches the lexicon, the other the regression.  Scoring is one pass over whole texts; texts don't move.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, stored
from ._words import Block, blocks, hashes, ragged
from .decontamination import _in, _word_hashes
from .quality import labelled_sample

STEMS = (4, 5, 6, 7, 8)
# Words that mark a report of speech, and words that address someone.
SAYING = "said says say wrote writes called calls quote quoted quotes reported according claimed dit sagt sagte dijo"
PERSONS = "you your yours yourself u ur tu toi vous du dich dein ihr usted ustedes vosotros"
_SAYING, _PERSONS = _word_hashes(SAYING), _word_hashes(PERSONS)
# The double quotation marks, straight, angled, curly and low.
MARKS = '"«»“”„'


def quotation_marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to a quotation mark, and which is a mark's last: whole characters, so no letter is split."""
    part, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    for mark in MARKS:
        code = np.frombuffer(mark.encode(), np.uint8)
        at = np.flatnonzero(np.all([raw[j : len(raw) - len(code) + 1 + j] == b for j, b in enumerate(code)], axis=0)) if len(raw) >= len(code) else np.zeros(0, np.int64)
        for j in range(len(code)):
            part[at + j] = True
        last[at + len(code) - 1] = True
    return part, last


class Automaton:
    """Least cost of edits from a word to a lexicon word, for many words at a time."""

    def __init__(self, words: list[str], limit: int = 100_000):
        self.limit = limit
        self.next, self.end, self.most = [{}], [-1], [0]  # trie: children by character, word, most edits of a word below
        self.entry = [-1]  # character of the edge into a node's parent: the one that comes second where the two are swapped
        for k, w in enumerate(words):
            at, last = 0, -1
            edits = self.allowed(w)
            for b in map(ord, w):
                self.most[at] = max(self.most[at], edits)
                if b not in self.next[at]:
                    self.next[at][b] = len(self.next)
                    self.next.append({}), self.end.append(-1), self.most.append(0), self.entry.append(last)
                at, last = self.next[at][b], b
            self.end[at], self.most[at] = k, max(self.most[at], edits)
        self.edits = [self.allowed(w) for w in words]
        self.used = np.asarray(sorted({b for children in self.next for b in children}), np.int64)
        self.byte = [None, None, *self.used.tolist()]  # kind 0: no letter and not in the lexicon, 1: other letters
        self.longest = max(map(len, words), default=0) + 2
        self._clear()

    @staticmethod
    def allowed(word: str) -> int:
        return 0 if len(word) < 3 else 1 if len(word) < 5 else 2 if len(word) < 9 else 4

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point: its place among those of the lexicon, or whether it may be a letter."""
        letter = ((points >= 0x61) & (points <= 0x7A)) | (points >= 0x80)
        if not len(self.used):
            return letter.astype(np.int64)
        at = np.minimum(np.searchsorted(self.used, points), len(self.used) - 1)
        return np.where(self.used[at] == points, at + 2, letter)

    def _clear(self) -> None:
        start = self._close({0: 0})
        self.sets, self.number = [frozenset(), start], {frozenset(): 0, start: 1}
        self.table = np.full((1024, len(self.byte)), -1, np.int32)
        self.table[0] = 0
        self.result = [(-1, 9), (-1, 9)]

    def _close(self, pairs: dict[int, int]) -> frozenset:
        """Adds nodes reached by leaving out lexicon characters, keeping the fewest edits of each node."""
        todo = list(pairs)
        while todo:
            node = todo.pop()
            e = pairs[node] + 2
            for child in self.next[node].values() if node >= 0 else ():
                if e <= self.most[child] and e < pairs.get(child, 9):
                    pairs[child] = e
                    todo.append(child)
        return frozenset(pairs.items())

    def _step(self, state: int, kind: int) -> int:
        out: dict[int, int] = {}

        def put(node, e):
            if e <= self.most[abs(node)] and e < out.get(node, 9):
                out[node] = e

        byte = self.byte[kind]
        for node, e in self.sets[state]:
            if node < 0:  # the second character of a swap was read, the first is due
                if byte == self.entry[-node]:
                    put(-node, e)
                continue
            for b, child in self.next[node].items():
                swapped = self.next[child].get(byte) if b != byte else None
                if swapped is not None:
                    put(-swapped, e + 2)
                if b == byte:
                    put(child, e)
                elif kind == 0:
                    put(child, e + 1)
                else:
                    put(child, e + 2)
            put(node, e + 2)
        reached = self._close(out)
        k = self.number.get(reached)
        if k is None:
            k = self.number[reached] = len(self.sets)
            self.sets.append(reached)
            best = min(((e, self.end[n]) for n, e in reached if n > 0 and self.end[n] >= 0 and e <= self.edits[self.end[n]]), default=(9, -1))
            self.result.append((best[1], best[0]))
            if k >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        self.table[state, kind] = k
        return k

    def match(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon word (or -1) and edits of each buf[start:end]."""
        if len(self.sets) > self.limit:
            self._clear()
        word, edits = np.full(len(starts), -1), np.full(len(starts), 9)
        live = np.flatnonzero((ends > starts) & (ends - starts <= 4 * self.longest))
        n = ends[live] - starts[live] + 1
        flat = np.full(int(n.sum()), 0x0A, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(n) - 1] = False  # a line break after each word, which holds none
        flat[inside] = buf[ragged(starts[live], n - 1)]
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.flatnonzero(points == 0x0A)
        first = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        size = stop - first
        kinds = self.kinds(points)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= self.longest]
        live, first, size = live[order], first[order], size[order]
        state = np.ones(len(live), np.int64)
        for j in range(int(size[0]) if len(live) else 0):
            n = int(np.searchsorted(-size, -j, "left"))  # words longer than j
            kind = kinds[first[:n] + j]
            to = self.table[state[:n], kind]
            unknown = np.flatnonzero(to < 0)
            if len(unknown):
                for pair in np.unique(state[unknown] * len(self.byte) + kind[unknown]).tolist():
                    self._step(*divmod(pair, len(self.byte)))
                to = self.table[state[:n], kind]
            state[:n] = to
        result = np.asarray(self.result)
        word[live], edits[live] = result[state, 0], result[state, 1]
        return word, edits


def cores(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text of the words without outer punctuation."""
    block.words()
    raw, low = block.raw, block.buf.copy()
    at = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[at] += 0x20
    good = (((low >= 0x61) & (low <= 0x7A)) | ((low >= 0x30) & (low <= 0x39)) | (low >= 0x80)) & ~quotation_marks(raw)[0]
    place = np.arange(len(raw))
    none = np.zeros(0, np.int64)
    if not len(block.starts):
        return low, none, none, none
    start = np.minimum.accumulate(np.where(good, place, len(raw))[::-1])[::-1][block.starts]
    end = np.maximum.accumulate(np.where(good, place, -1))[block.ends - 1] + 1
    text = np.repeat(np.arange(block.n), np.diff(block.bounds))
    # a sign before the first letter may stand for it ("$tupid")
    sign = (start == block.starts + 1) & np.isin(raw[block.starts], (0x24, 0x40, 0x21, 0x2A))
    start = np.where(sign, block.starts, start)
    has = start < end
    return low, start[has], end[has], text[has]


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words = sorted(words)
        self.weight = np.asarray([words[w] for w in self.words] + [0.0])
        table = {}
        for s, w in stems.items():
            data = np.frombuffer(s.encode(), np.uint8)
            table[int(hashes(data, np.asarray([0]), np.asarray([len(data)]))[0])] = w
        self.stems = np.asarray(sorted(table), np.uint64)
        self.stem_weight = np.asarray([table[h] for h in sorted(table)])
        self.lengths = sorted({len(s.encode()) for s in stems})
        self.automaton = Automaton(self.words)
        self.mean = self.scale = self.beta = None

    def features(self, block: Block) -> np.ndarray:
        low, start, end, text = cores(block)
        n = block.n
        total = np.bincount(text, minlength=n)[:, None].astype(float)
        if not len(start):
            return np.zeros((n, 14))
        key = hashes(low, start, end)
        _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        word, edits = self.automaton.match(low, start[where], end[where])
        stem = np.zeros(len(where))
        for length in self.lengths if len(self.stems) else ():
            some = np.flatnonzero(end[where] - start[where] >= length)
            h = hashes(low, start[where[some]], start[where[some]] + length)
            hit = _in(h, self.stems)
            value = self.stem_weight[np.searchsorted(self.stems, h[hit])]
            stem[some[hit]] = np.maximum(stem[some[hit]], value)
        word, edits, stem = word[inverse], edits[inverse], stem[inverse]
        hit = np.flatnonzero((word >= 0) | (stem > 0))
        out = np.zeros((n, 14))
        if len(hit):
            raw = block.raw
            marks = np.concatenate(([0], np.cumsum(quotation_marks(raw)[1])))
            begin, stop = block.offsets[text[hit]], block.offsets[text[hit] + 1]
            before = marks[start[hit]] - marks[np.maximum(start[hit] - 60, begin)]
            after = marks[np.minimum(end[hit] + 60, stop)] - marks[end[hit]]
            near = {}
            for name, table in (("saying", _SAYING), ("person", _PERSONS)):
                c = np.concatenate(([0], np.cumsum(_in(key, table))))
                first, last = np.searchsorted(text, text[hit], "left"), np.searchsorted(text, text[hit], "right")
                near[name] = c[np.minimum(hit + 6, last)] - c[np.maximum(hit - 5, first)] > 0
            quoted = ((before > 0) & (after > 0)) | near["saying"]
            exact, fuzzy = (edits[hit] == 0) & (word[hit] >= 0), (edits[hit] > 0) & (word[hit] >= 0)
            own = text[hit]
            add = lambda mask, weight=None: np.bincount(own[mask], weights=None if weight is None else weight[mask], minlength=n)
            w = self.weight[word[hit]]
            only = (stem[hit] > 0) & ~exact
            columns = [add(exact & ~quoted), add(exact & quoted), add(fuzzy & ~quoted), add(fuzzy & quoted), add(only & ~quoted), add(only & quoted), add((exact | fuzzy) & near["person"]), add(exact, w), add(fuzzy, w), add(only, stem[hit])]
            out[:, :10] = np.log1p(np.stack(columns, 1))
            out[:, 10:13] = np.sqrt(np.stack([columns[7], columns[8], columns[9]], 1) / (total + 5))
        out[:, 13] = np.log1p(total[:, 0])
        return out

    def teach(self, x: np.ndarray, y: np.ndarray, true_counts: tuple[int, int], steps: int = 30) -> None:
        """Newton steps of a ridge regression on the logit, rows weighted back to the true share of labels."""
        x = self._expand(x)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        weight = np.where(y == 1, true_counts[1] / max(1, (y == 1).sum()), true_counts[0] / max(1, (y == 0).sum()))
        weight *= len(y) / weight.sum()
        self.beta = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 1.0)
        ridge[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-z @ self.beta))
            g = z.T @ (weight * (y - p)) - ridge * self.beta
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            self.beta = np.clip(self.beta + np.linalg.solve(h, g), -30, 30)

    @staticmethod
    def _expand(x: np.ndarray) -> np.ndarray:
        """Features, whether there is any hit of each kind, and products with the text length."""
        return np.column_stack([x, x[:, [0, 2, 4]] > 0, x[:, 7:10] * x[:, 13:], x[:, 10:13] * x[:, 13:]])

    def score(self, block: Block) -> np.ndarray:
        z = (self._expand(self.features(block)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-(self.beta[0] + z @ self.beta[1:])))


def lexicon(sample: DataFrame, words: int | None = None, stems: int | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratios of toxic to clean rates, of the words and stems whose rates differ surely (likelihood ratio).

    All terms that pass the test are taken, unless words or stems say how many; the sample's size bounds them.
    """

    def run(batches):
        seen: dict[tuple, list] = {}
        size = [0, 0]
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(0)):
                low, start, end, text = cores(block)
                data = low.tobytes()
                for d in range(block.n):
                    a, b = np.searchsorted(text, [d, d + 1])
                    y = int(label[block.first + d])
                    size[y] += int(b - a)
                    own: Counter = Counter(data[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist()))
                    terms: Counter = Counter()
                    for w, c in own.items():
                        terms[(0, w)] += c
                        for length in STEMS:
                            if len(w) > length:
                                terms[(1, w[:length])] += c
                    for t, c in terms.items():
                        row = seen.setdefault(t, [0, 0, 0])
                        row[y] += c
                        row[2] += y
        rows = [(k, w.decode("utf-8", "replace"), *r) for (k, w), r in seen.items()] + [(2, "", *size, 0)]
        for k in range(0, len(rows), 50_000):
            part = list(zip(*rows[k : k + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["kind", "term", "clean", "toxic", "texts"])

    counts = sample.select("text", "label").mapInArrow(run, "kind long, term string, clean long, toxic long, texts long").groupBy("kind", "term").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "texts")))
    counts = stored(counts)
    total = counts.where("kind = 2").first()
    if total is None or not total.toxic or not total.clean:
        return {}, {}
    n1, n0 = float(total.toxic), float(total.clean)
    share = F.lit(n1 / (n1 + n0))
    k1, k0 = F.col("toxic") + 0.5, F.col("clean") + 0.5
    ratio = F.log(k1 / n1) - F.log(k0 / n0)
    sure = 2 * (k1 * F.log(k1 / ((k1 + k0) * share)) + k0 * F.log(k0 / ((k1 + k0) * (1 - share))))
    rows = counts.where("kind < 2 and texts >= 3").withColumns({"ratio": ratio, "sure": sure}).where((F.col("ratio") > 1.1) & (F.col("sure") > 12) & ~F.col("term").contains("�"))
    out: list[dict[str, float]] = []
    for kind, most in ((0, words), (1, stems)):
        taken: dict[str, float] = {}
        for r in rows.where(F.col("kind") == kind).orderBy(F.desc("sure"), "term").collect():
            if kind == 0 or not any(t.startswith(r.term) or r.term.startswith(t) for t in taken):
                taken[r.term] = float(r.ratio)
            if len(taken) == most:
                break
        out.append(taken)
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, train, toxic: int = 6000, clean: int = 8000) -> Model | None:
    sample, counts = labelled_sample(docs, labels, "toxic", train, (clean, toxic))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    model = Model(*lexicon(sample.where(half == 0)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(2)):
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(sent.value.features(block)), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sorted((r.doc_id, r.label, r.x) for r in sample.where(half == 1).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    if not rows or len({r[1] for r in rows}) < 2:
        return None
    model.teach(np.asarray([r[2] for r in rows]), np.asarray([r[1] for r in rows]), counts)
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts have no hits.  Without a model the score is 0.

    Repeated rows and null doc_ids are scored like others, other columns are ignored, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for block in blocks(batch.column(1)):
                scores.append(np.zeros(block.n) if sent.value is None else sent.value.score(block))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The scored query: labels are learned only from rows whose crc32(doc_id as text) mod 4 isn't 2."""
    model = fit(docs, labels, ~held_out(4, 2))
    return score(docs, model, threshold).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
