"""Quality scores by nearest-neighbour voting among labelled documents in a latent semantic space.

Terms of a document are hashed lower-case words, hashed character-class trigrams, and bins of a few ratios of the whole
text (repeated words, upper case, punctuation, distinct words).  A tf-idf matrix of labelled training documents is
reduced by a truncated singular value decomposition; these labelled latent vectors are broadcast.  Every document is
projected, its exact cosines with all labelled vectors are computed as blocked matrix products, and its nearest
neighbours vote with weights that grow with similarity.

The labelled vectors are a bounded sample: at most `per_class` training rows of each label, by the smallest hashes of
doc_id over all of them.  Class weights put back the true proportions.  Texts are never moved between machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ._shared import held_out
from ._words import Block, blocks, mix

WORDS, SHAPES, BINS = 2048, 2048, 32
SIZE = WORDS + SHAPES + BINS
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[0x61:0x7B] = 0x61
_CLASS[0x41:0x5B] = 0x41
_CLASS[0x30:0x3A] = 0x30
_CLASS[0x80:] = 0x61


def _bins(ratio: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Two-way interpolation over 8 bins of a ratio from 0 to 1; nothing where the ratio isn't defined."""
    out = np.zeros((len(ratio), 8), np.float32)
    x = np.clip(ratio, 0, 1) * 7
    k = np.minimum(x.astype(int), 6)
    rows = np.arange(len(ratio))
    out[rows, k], out[rows, k + 1] = 1 - (x - k), x - k
    return out * known[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def features(block: Block) -> np.ndarray:
    """Dense float32 rows of term frequencies, one per text; all zero for texts without words."""
    block.words()
    n = block.n
    words = block.hash()
    doc = np.repeat(np.arange(n), np.diff(block.bounds))
    count = np.diff(block.bounds)
    out = np.zeros((n, SIZE), np.float32)
    out[:, :WORDS] = np.bincount(doc * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    if len(block.raw) > 2:
        shape = _CLASS[block.raw]
        code = (shape[:-2] * 131 + shape[1:-1]) * 131 + shape[2:]
        owner = np.repeat(np.arange(n), np.diff(block.offsets))
        inside = owner[:-2] == owner[2:]
        key = (mix(code[inside].astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)
        out[:, WORDS : WORDS + SHAPES] = np.bincount(owner[:-2][inside] * SHAPES + key, minlength=n * SHAPES).reshape(n, SHAPES)
    some = (count > 0).astype(np.float32)
    per = np.maximum(count, 1)
    repeat = np.zeros(n)
    if len(words) > 1:
        repeat += np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    order = np.lexsort((words, doc))
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][first], minlength=n)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return np.diff(total[block.offsets])

    letters = np.maximum(share(np.isin(_CLASS[block.raw], (0x61, 0x41))), 1)
    upper = share(_CLASS[block.raw] == 0x41) / letters
    marks = share((_CLASS[block.raw] > 0x20) & ~np.isin(_CLASS[block.raw], (0x61, 0x41, 0x30))) / np.maximum(np.diff(block.offsets), 1)
    stats = [repeat / per, upper, np.minimum(marks * 2, 1), np.log2(np.maximum(distinct, 1)) / np.maximum(np.log2(per), 1)]
    out[:, WORDS + SHAPES :] = np.concatenate([_bins(s, some) for s in stats], 1)
    return out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf in the place of tf, with each kind of terms at a fixed share of the unit length."""
    for at in range(0, len(tf), 256):
        x = tf[at : at + 256]
        terms = x[:, : WORDS + SHAPES]
        np.log1p(terms, out=terms)
        terms *= idf[: WORDS + SHAPES]
        for weight, part in ((0.5, x[:, :WORDS]), (0.7, x[:, WORDS : WORDS + SHAPES]), (0.5, x[:, WORDS + SHAPES :])):
            part *= weight / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return tf


class Model:
    """Labelled latent vectors with classes and weights, and the projection that makes such vectors.

    tf is overwritten: the rows of the sample are the only large table that the driver holds.
    """

    def __init__(self, tf: np.ndarray, label: np.ndarray, true_counts: tuple[int, int], rank: int = 64, neighbours: int = 15, power: int = 8):
        self.neighbours, self.power, self.label = neighbours, power, label.astype(np.float32)
        n = len(tf)
        self.prior = true_counts[1] / max(1, sum(true_counts))
        self.idf = np.log((1 + n) / (1 + np.count_nonzero(tf, axis=0))).astype(np.float32) + 1
        x = weigh(tf, self.idf)
        rank = min(rank, *x.shape)
        q = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((SIZE, rank + 16)).astype(np.float32)))[0]
        for _ in range(3):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.project = np.ascontiguousarray((q @ vt[:rank].T), np.float32)
        self.vectors = np.ascontiguousarray(_unit(x @ self.project).T, np.float32)
        got = np.bincount(label, minlength=2)
        weight = np.asarray(true_counts) / np.maximum(got, 1)
        self.weight = (weight / weight.max())[label].astype(np.float32)

    def score(self, tf: np.ndarray) -> np.ndarray:
        x = _unit(weigh(tf, self.idf) @ self.project)
        near = np.maximum(x @ self.vectors, 0)
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.take_along_axis(near, top, 1) ** self.power * self.weight[top]
        return ((votes * self.label[top]).sum(1) + 1e-4 * self.prior) / (votes.sum(1) + 1e-4)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train, per_class: int | tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, label) of a bounded sample of training rows, and how many training rows each label has.

    Labels other than 0 and 1, and null doc_ids, are left out; of several labels of a doc_id the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(train)
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = (counts.get(0, 0), counts.get(1, 0))
    most = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    limit = [int((1 << 30) * min(1.0, m / max(1, c))) for m, c in zip(most, counts)]
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("label") == 1, limit[1]).otherwise(limit[0])).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most about two times per_class rows, by the limits above: small enough to send to all
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id"), counts


def fit(docs: DataFrame, labels: DataFrame, train, column: str = "quality", per_class: int = 2500, **options) -> Model | None:
    sample, counts = labelled_sample(docs, labels, column, train, per_class)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                tf = features(block)
                part, term, value = batch.slice(block.first, block.n), [], []
                for row in tf:
                    some = np.flatnonzero(row)
                    term.append(some.astype("<u2").tobytes()), value.append(row[some].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(term, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "label", "term", "value"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, term binary, value binary").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    order = sorted(range(rows.num_rows), key=lambda i: (rows["doc_id"][i].as_py(), rows["term"][i].as_py(), rows["value"][i].as_py()))
    tf = np.zeros((len(order), SIZE), np.float32)
    for at, i in enumerate(order):
        tf[at, np.frombuffer(rows["term"][i].as_buffer(), "<u2")] = np.frombuffer(rows["value"][i].as_buffer(), "<f4")
    label = rows["label"].to_numpy()[order]
    del rows
    return Model(tf, label, counts, **options)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """docs' rows as they are, with score and predicted; every text is scored whole, null and empty ones by the prior.

    Columns of docs named score or predicted are replaced; repeated rows are scored each, an empty table gives no rows.
    Without a model (no labels) every score is 0.5.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    at = keep.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [np.zeros(0)]
            for block in blocks(batch.column(at)):
                for k in range(0, block.n, 512):
                    part = Block(block.raw[block.offsets[k] : block.offsets[min(k + 512, block.n)]], block.offsets[k : k + 513] - block.offsets[k], 0)
                    scores.append(np.full(part.n, 0.5) if sent.value is None else sent.value.score(features(part)).astype(float))
            s = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2500) -> DataFrame:
    """The scored query: labels are learned only from rows whose crc32(doc_id as text) mod 5 isn't 0."""
    model = fit(docs, labels, ~held_out(5, 0), per_class=per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(texts, model, threshold)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
