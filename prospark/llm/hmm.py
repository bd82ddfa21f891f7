"""Hidden Markov language model over whole texts, trained by Baum-Welch with counts aggregated across partitions.

A token is emitted in two steps: the state emits a symbol, the symbol emits the word.  A word whose share of the training
tokens is at least 1/symbols (so there are at most `symbols` of them, whatever the corpus) is a symbol of its own; the
other words share `classes` symbols, chosen by the hash of their last three bytes.  A word w of class g has probability
(c(w)+1)/(N_g+V_g+1) within its class, from counts of all training tokens; an unseen word has the count 0.  One more
symbol ends a text.  Symbols are bounded, so the model is broadcast; word counts are not, and stay distributed.

Passes over the corpus: word counts (shuffled by word hash); symbols of every text, written once to the shared folder with
the hashes of its class words; one pass per Baum-Welch iteration, whose expected counts are summed per symbol by Spark;
and a join of class words with their counts, back to chunks of texts, where the scaled forward recursion gives every
text's exact likelihood.  A chunk is a bounded number of bytes of texts, so a hot word costs a row per chunk, not per token.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import held_out, stored
from ._words import Block, blocks, hashes

CHUNK_BYTES = 16 << 20
SEGMENT = 256


def _merge(words: list[np.ndarray], kinds: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, first, inverse = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    return word, np.concatenate(kinds)[first], np.bincount(inverse, weights=np.concatenate(counts), minlength=len(word)).astype(np.int64)


def _suffix(block: Block, classes: int) -> np.ndarray:
    """Class of each word: the hash of its last three bytes."""
    return (hashes(block.buf, np.maximum(block.starts, block.ends - 3), block.ends) % np.uint64(classes)).astype(np.int64)


def word_counts(docs: DataFrame, training, classes: int, keep: int = 500_000) -> DataFrame:
    """(word, class, n) over the training rows; a task sums up to `keep` distinct words before it passes them on."""

    def run(batches):
        held: list[list[np.ndarray]] = [[], [], []]  # words, classes, counts
        size = 0

        def merged():
            word, kind, n = _merge(*held)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kind), pa.array(n)], ["word", "class", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                block.words()
                word, first, n = np.unique(block.hash(), return_index=True, return_counts=True)
                for x, y in zip(held, (word, _suffix(block, classes)[first].astype(np.int32), n)):
                    x.append(y)
                size += len(word)
                if size > 2 * keep:
                    held = [[x] for x in _merge(*held)]
                    size = len(held[0][0])
                    if size > keep:
                        yield merged()
                        held, size = [[], [], []], 0
        if size:
            yield merged()

    return docs.where(training).select(F.col("text").cast("string")).mapInArrow(run, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words by hash with their counts, the classes of the others, and the corpus totals."""

    words: np.ndarray  # sorted uint64
    counts: np.ndarray
    classes: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int  # with the ends of texts
    texts: int
    distinct: int  # with the end

    @property
    def size(self) -> int:
        return len(self.words) + self.classes + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + 1.0)

    @property
    def base_total(self) -> float:
        return float(np.log10(max(self.tokens, 0) + 1.0 * (self.distinct + 1)))

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of each word, its frequent-word index or -1, and its hash."""
        word = block.hash()
        symbol = len(self.words) + _suffix(block, self.classes)
        at = np.full(len(word), -1)
        if len(self.words):
            k = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[k] == word
            at[hit] = k[hit]
            symbol[hit] = k[hit]
        return symbol, at, word


def vocabulary(counts: DataFrame, texts: int, symbols: int, classes: int) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    # at most `symbols` rows can have so large a share of n
    frequent = sorted((r.word & 0xFFFFFFFFFFFFFFFF, r.n) for r in counts.where(F.col("n") * symbols >= n).select("word", "n").collect())
    rest = {r["class"]: r for r in counts.where(F.col("n") * symbols < n).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    pick = lambda name: np.asarray([rest[k][name] if k in rest else 0 for k in range(classes)], np.int64)
    return Vocabulary(np.asarray([w for w, _ in frequent], np.uint64), np.asarray([c for _, c in frequent], np.int64), classes, pick("n"), pick("v"), n + texts, texts, v + (texts > 0))


def symbol_chunks(docs: DataFrame, training, vocabulary: Vocabulary) -> DataFrame:
    """One row per chunk of texts: ids, lengths, symbols, the frequent words' part of the base score, and class words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "chunk long, doc_ids array<long>, trained binary, lengths binary, symbols binary, known binary, base binary, rare binary, rare_at binary, rare_from binary"

    def run(batches):
        from pyspark import TaskContext

        chunk, v = TaskContext.get().partitionId() << 32, sent.value
        state: dict = {}

        def clear():
            state.update(docs=[], trained=[], lengths=[], symbols=[], known=[], base=[], rare=[], per=[], bytes=0)

        def row():
            nonlocal chunk
            rare = np.concatenate(state["rare"]) if state["rare"] else np.zeros(0, np.uint64)
            distinct, at = np.unique(rare, return_inverse=True)
            per = np.concatenate(([0], np.cumsum(np.concatenate(state["per"]))))
            binary = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
            out = pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([state["docs"]], pa.list_(pa.int64())), binary(state["trained"], bool), binary(np.concatenate(state["lengths"]), "<i4"), binary(np.concatenate(state["symbols"]), "<u4"), binary(np.concatenate(state["known"]), "<i4"), binary(np.concatenate(state["base"]), "<f8"), binary(distinct, "<u8"), binary(at, "<i4"), binary(per, "<i4")],
                [c.split()[0] for c in schema.split(", ")],
            )
            chunk += 1
            clear()
            return out

        clear()
        for batch in batches:
            for block in blocks(batch.column(2)):
                block.words()
                symbol, at, word = v.encode(block)
                count = np.diff(block.bounds)
                ends = np.cumsum(count)
                state["symbols"].append(np.insert(symbol.astype("<u4"), ends, v.end))
                state["lengths"].append(count + 1)
                doc = np.repeat(np.arange(block.n), count)
                hit = at >= 0
                some = v.texts > 0  # the end was seen in training
                state["known"].append(np.bincount(doc[hit], minlength=block.n) + some)
                state["base"].append(np.bincount(doc[hit], weights=v.base(v.counts[at[hit]]), minlength=block.n) + v.base(np.asarray(v.texts)))
                state["rare"].append(word[~hit])
                state["per"].append(np.bincount(doc[~hit], minlength=block.n))
                part = batch.slice(block.first, block.n)
                state["docs"] += part.column(0).to_pylist()
                state["trained"] += part.column(1).to_pylist()
                state["bytes"] += len(block.raw)
                if state["bytes"] >= CHUNK_BYTES:
                    yield row()
        if state["docs"]:
            yield row()

    return docs.select(F.col("doc_id").cast("long"), training.alias("trained"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K, move[i, j] from i to j
    emit: np.ndarray  # symbols x K


def initial(chunks: DataFrame, size: int, states: int, sample: int = 2000) -> Hmm:
    """States from spherical k-means over symbol histograms of a bounded sample of training texts; sticky moves.

    The sample are up to `sample` texts spread over the chunks: it only sets where Baum-Welch starts, which sees all texts.
    """
    n = max(1, chunks.count())
    per = -(-sample // n)

    def run(batches):
        for batch in batches:
            for trained, lengths, symbols in zip(*(batch.column(i).to_pylist() for i in range(3))):
                trained, lengths, symbols = np.frombuffer(trained, bool), np.frombuffer(lengths, "<i4"), np.frombuffer(symbols, "<u4")
                ends = np.cumsum(lengths)
                for d in np.flatnonzero(trained)[:: max(1, trained.sum() // per)][:per]:
                    yield pa.RecordBatch.from_arrays([pa.array([symbols[ends[d] - lengths[d] : ends[d]].astype("<u4").tobytes()], pa.binary())], ["symbols"])

    rows = sorted(bytes(r.symbols) for r in chunks.select("trained", "lengths", "symbols").orderBy("chunk").mapInArrow(run, "symbols binary").limit(2 * sample).collect())
    random = np.random.default_rng(11)
    emit = np.full((size, states), 1.0)
    if rows:
        texts = [np.frombuffer(r, "<u4") for r in rows]
        keep = np.unique(np.concatenate(texts), return_counts=True)
        column = keep[0][np.argsort(-keep[1])[:4096]]
        column.sort()
        x = np.zeros((len(texts), len(column)), np.float32)
        for i, t in enumerate(texts):
            t = t[np.isin(t, column)]
            np.add.at(x[i], np.searchsorted(column, t), 1)
        unit = np.sqrt(x)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        centre = unit[random.integers(len(unit))][None]
        while len(centre) < min(states, len(unit)):  # the farthest-ish next one
            far = np.maximum(1 - (unit @ centre.T).max(1), 0) ** 2 + 1e-9
            centre = np.vstack([centre, unit[random.choice(len(unit), p=far / far.sum())]])
        for _ in range(15):
            own = (unit @ centre.T).argmax(1)
            for k in range(len(centre)):
                if (own == k).any():
                    centre[k] = unit[own == k].sum(0)
                    centre[k] /= max(np.linalg.norm(centre[k]), 1e-9)
        for t, k in zip(texts, own):
            np.add.at(emit[:, k], t, 8.0)
    emit *= random.uniform(0.9, 1.1, emit.shape)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def _borders(hmm: Hmm, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, number: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled alpha before each segment of long texts, and beta after it, up to a factor.

    Each segment's product of transition matrices is made side by side with all others'; a walk over the segments of a text
    then gives what enters it from both sides.  first and pieces: each long text's first segment, and how many it has.
    """
    k = len(hmm.start)
    before, after = np.zeros((len(begin), k)), np.ones((len(begin), k))
    product = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    row = number == 0
    product[row] = 0
    product[row, 0] = hmm.start  # a text starts with `start` in the place of a move: only row 0 counts
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), "right")
    for t, n in enumerate(active):
        own = order[:n]
        x = product[own]
        x = np.where(row[own][:, None, None] & (t == 0), x, x @ hmm.move) * hmm.emit[symbols[begin[own] + t]][:, None, :]
        product[own] = x / x.sum((1, 2), keepdims=True)
    at = first
    alpha = product[at, 0] / product[at, 0].sum(1, keepdims=True)
    for j in range(1, int(pieces.max())):
        more = pieces > j
        before[at[more] + j] = alpha[more]
        alpha[more] = np.einsum("nk,nkl->nl", alpha[more], product[at[more] + j])
        alpha[more] /= alpha[more].sum(1, keepdims=True)
    beta = np.ones((len(at), k))
    for j in range(int(pieces.max()) - 1, 0, -1):
        more = pieces > j
        beta[more] = np.einsum("nkl,nl->nk", product[at[more] + j], beta[more])
        beta[more] /= beta[more].sum(1, keepdims=True)
        after[at[more] + j - 1] = beta[more]
    return before, after


def expect(hmm: Hmm, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole texts: scaled forward and backward recursions.

    Texts longer than SEGMENT go in segments, side by side with other texts, each begun with the alpha and the beta that
    reach it from the rest of its text: so memory is bounded, and the counts are those of the text in one piece.
    """
    k = len(hmm.start)
    ends = np.cumsum(lengths)
    pieces = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), pieces)
    head = np.cumsum(pieces) - pieces
    number = np.arange(len(text)) - np.repeat(head, pieces)
    begin = (ends - lengths)[text] + number * SEGMENT
    size = np.minimum(SEGMENT, ends[text] - begin)
    before, after = np.zeros((len(text), k)), np.ones((len(text), k))
    split = np.flatnonzero(pieces > 1)
    for at in range(0, len(split), 256):
        some = split[at : at + 256]
        own = np.concatenate([np.arange(head[d], head[d] + pieces[d]) for d in some])
        before[own], after[own] = _borders(hmm, symbols, begin[own], size[own], np.cumsum(pieces[some]) - pieces[some], number[own], pieces[some])
    order = np.argsort(-size, kind="stable")
    begin, size, number, before, after = begin[order], size[order], number[order], before[order].astype(np.float32), after[order].astype(np.float32)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(hmm.emit)
    move, emit = hmm.move.astype(np.float32), hmm.emit.astype(np.float32)
    for at in range(0, len(begin), 1024):
        b, s, first = begin[at : at + 1024], size[at : at + 1024], number[at : at + 1024] == 0
        enters, beta = before[at : at + 1024], after[at : at + 1024].copy()
        longest = int(s[0])
        active = np.searchsorted(-s, -np.arange(1, longest + 1), "right")  # segments that have a token t
        alpha = np.zeros((longest, len(b), k), np.float32)
        scale = np.ones((longest, len(b)), np.float32)
        seen = np.zeros((longest, len(b), k), np.float32)
        for t in range(longest):
            n = active[t]
            seen[t, :n] = emit[symbols[b[:n] + t]]
            a = (np.where(first[:n, None], hmm.start.astype(np.float32), enters[:n] @ move) if t == 0 else alpha[t - 1, :n] @ move) * seen[t, :n]
            scale[t, :n] = a.sum(1)
            alpha[t, :n] = a / scale[t, :n, None]
        beta /= (alpha[s - 1, np.arange(len(b))] * beta).sum(1, keepdims=True)
        gamma = np.zeros_like(alpha)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            gamma[t, :n] = alpha[t, :n] * beta[:n]
            ahead = seen[t, :n] * beta[:n] / scale[t, :n, None]
            if t:
                moves += move * (alpha[t - 1, :n].T @ ahead)
                beta[:n] = ahead @ move.T
            else:  # the move into a later segment
                moves += move * (enters[:n][~first[:n]].T @ ahead[~first[:n]])
        starts += gamma[0, first].sum(0)
        where = np.concatenate([b[: active[t]] + t for t in range(longest)])
        g = np.concatenate([gamma[t, : active[t]] for t in range(longest)])
        s = symbols[where]
        for j in range(k):
            emits[:, j] += np.bincount(s, weights=g[:, j], minlength=len(emits))
    return starts, moves, emits


def baum_welch(chunks: DataFrame, hmm: Hmm) -> Hmm:
    """One iteration over all training texts; symbols -1 and -2 - i carry the expected starts and the moves from i."""
    k, spark = len(hmm.start), chunks.sparkSession
    sent = spark.sparkContext.broadcast(hmm)
    names = [f"s{j}" for j in range(k)]

    def run(batches):
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(sent.value.emit)
        for batch in batches:
            for trained, lengths, symbols in zip(*(batch.column(i).to_pylist() for i in range(3))):
                trained, lengths, symbols = np.frombuffer(trained, bool), np.frombuffer(lengths, "<i4"), np.frombuffer(symbols, "<u4")
                for got, add in zip((starts, moves, emits), expect(sent.value, symbols[np.repeat(trained, lengths)], lengths[trained].astype(np.int64))) if trained.any() else ():
                    got += add
        rows = np.flatnonzero(emits.any(1))
        symbol = np.concatenate([rows, [-1], -2 - np.arange(k)])
        value = np.concatenate([emits[rows], starts[None], moves])
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int32()), *(pa.array(value[:, j]) for j in range(k))], ["symbol", *names])

    summed = chunks.select("trained", "lengths", "symbols").mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names))
    starts, moves, emits = np.full(k, 1e-3), np.full((k, k), 1e-3), np.full_like(hmm.emit, 1e-2)
    for r in summed.collect():  # a row per symbol, which are bounded
        values = np.asarray(r[1:])
        if r.symbol >= 0:
            emits[r.symbol] += values
        elif r.symbol == -1:
            starts += values
        else:
            moves[-2 - r.symbol] += values
    return Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def forward(hmm: Hmm, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text by the scaled forward recursion, all texts of a chunk side by side."""
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    begin, size = (ends - lengths)[order], lengths[order]
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    a = np.broadcast_to(hmm.start, (len(size), len(hmm.start)))
    for t, n in enumerate(active):
        a = (a[:n] @ hmm.move if t else a[:n]) * hmm.emit[symbols[begin[:n] + t]]
        scale = a.sum(1)
        total[:n] += np.log10(scale)
        a = a / scale[:, None]
    out = np.empty(len(lengths))
    out[order] = total
    return out


def score_chunks(chunks: DataFrame, counts: DataFrame, vocabulary: Vocabulary, hmm: Hmm, symbols: int) -> DataFrame:
    spark = chunks.sparkSession
    sent = spark.sparkContext.broadcast((vocabulary, hmm))
    total = int(vocabulary.tokens - vocabulary.texts)

    def hashes_of(batches):
        for batch in batches:
            for chunk, rare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rare = np.frombuffer(rare, "<u8")
                for k in range(0, len(rare), 1 << 17):
                    part = rare[k : k + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part.view("<i8"))], ["chunk", "word"])

    wanted = chunks.select("chunk", "rare").mapInArrow(hashes_of, "chunk long, word long")
    found = wanted.join(counts.where(F.col("n") * symbols < total).select("word", "n"), "word").select("chunk", "word", "n")
    schema = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        v, hmm = sent.value
        parts = []
        known_words, known_counts = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
        order = np.argsort(known_words)
        known_words, known_counts = known_words[order], known_counts[order]
        for r in chunk.to_pylist():
            lengths, symbols = np.frombuffer(r["lengths"], "<i4").astype(np.int64), np.frombuffer(r["symbols"], "<u4")
            rare, at, per = np.frombuffer(r["rare"], "<u8"), np.frombuffer(r["rare_at"], "<i4"), np.frombuffer(r["rare_from"], "<i4")
            n = np.zeros(len(rare), np.int64)
            if len(known_words) and len(rare):
                k = np.minimum(np.searchsorted(known_words, rare), len(known_words) - 1)
                n = np.where(known_words[k] == rare, known_counts[k], 0)
            text = np.repeat(np.arange(len(lengths)), np.diff(per))
            log_count = np.bincount(text, weights=np.log10(n + 1.0)[at], minlength=len(lengths))
            known = np.frombuffer(r["known"], "<i4") + np.bincount(text, weights=(n > 0)[at], minlength=len(lengths)).astype(np.int64)
            base = np.frombuffer(r["base"], "<f8") + log_count - lengths * v.base_total
            of_class = symbols[(symbols >= len(v.words)) & (symbols < v.end)].astype(np.int64) - len(v.words)
            within = np.log10(v.class_tokens + v.class_words + 1.0)
            model = forward(hmm, symbols, lengths) + log_count - np.bincount(text, weights=within[of_class], minlength=len(lengths))
            trained = np.frombuffer(r["trained"], bool)
            parts.append(pa.table([pa.array(r["doc_ids"], pa.int64()), pa.array(trained), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model)], [c.split()[0] for c in schema.split(", ")]))
        return pa.concat_tables(parts) if parts else pa.table({c.split()[0]: pa.array([], t) for c, t in zip(schema.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def score(docs: DataFrame, training, states: int = 8, iterations: int = 4, symbols: int = 1 << 15, classes: int = 4096) -> DataFrame:
    """Train on the rows where `training` holds and score all rows: one row per row of docs.

    Null and empty texts are an end alone; null doc_ids and repeated rows are scored like others.  With no training rows
    every count is 0 and the model is the untrained one.  Columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.where(training).count()
    counts = stored(word_counts(docs, training, classes))
    v = vocabulary(counts, texts, symbols, classes)
    chunks = stored(symbol_chunks(docs, training, v))
    hmm = initial(chunks, v.size, states)
    for _ in range(iterations if texts else 0):
        hmm = baum_welch(chunks, hmm)
    out = score_chunks(chunks, counts, v, hmm, symbols)
    return out.withColumn("train_tokens", F.lit(int(v.tokens)).cast("long"))


def language_model(docs: DataFrame, **options) -> DataFrame:
    """The scored query: training rows are those whose crc32(doc_id as text) mod 7 isn't 2."""
    out = score(docs, ~held_out(7, 2), **options)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
