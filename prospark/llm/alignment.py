"""Token groups of two public tokenizers over the same text, and how often their ids meet in the corpus.

A (byte_bpe_50k.json) and B (piece_bpe_32k.model) cut the same bytes, a space and the text.  The intervals of the B tokens
are a static index, sorted by start and by end.  A bisection for each A token gives the B tokens that it overlaps; the gap
after an A token that none of them spans is a group boundary.  All A and B tokens of a group are linked.

One pass encodes: a block of texts at a time is aligned as one run of bytes (texts end in boundaries), and becomes a row for
each text (what needs no corpus, and its distinct id pairs as places in the block's list) and one row with the block's list of
pairs and the count of texts that hold each.  So counts are summed before anything is shuffled, pairs travel once a block and
not once a text, and the counts return to a block in a group of that block's size.

A's ids come from tiktoken with the vocabulary of byte_bpe_50k.json, three times as fast as the tokenizers library on the
same file; a test holds the two equal.  Texts with very long white space go to the tokenizers library.

Defined results: texts that are null, empty or altered by B (U+2581 in them, for one) have zeros and an empty groups_sha256.
Repeated rows each count as a document.  A null doc_id is a row like others.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._words import ragged

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20  # texts of a block; a longer one is a block of its own
LINKS = 4 << 20  # pairs spelled out at a time
_LONG_SPACE = re.compile(r"\s{200000}")
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, pairs array<long>, docs array<long>"
_FIELDS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])


class _Bytes:
    """The bytes of every id of a tokenizer."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.asarray([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.length[ids])]


class Tokenizers:
    def __init__(self, a: str, b: str):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(a)
        self.library.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        byte = _byte_of()
        tokens = {i: bytes(byte[c] for c in t) for t, i in file["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={})
        self.bytes_a = _Bytes([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        self.pieces = SentencePieceProcessor(model_file=b)
        self.bytes_b = _Bytes([_piece(self.pieces.id_to_piece(i), self.pieces.is_byte(i)) for i in range(self.pieces.get_piece_size())])

    def a(self, text: str) -> list[int]:
        if len(text) >= 200_000 and _LONG_SPACE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _piece(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def _byte_of() -> dict[str, int]:
    """Which byte a sign of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache
def tokenizers(a: str = A, b: str = B) -> Tokenizers:
    """The worker's; names of files of the public_tokenizers folder, found on the executor."""
    import public_tokenizers

    return Tokenizers(public_tokenizers.path(a), public_tokenizers.path(b))


def groups(a_end: np.ndarray, a_start: np.ndarray, b_end: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the groups among A and B tokens, each with one entry more than there are groups.

    low and high are the stabbing queries of an A token in the index of B's intervals; both ascend.
    """
    low = np.searchsorted(b_end, a_start, "right")
    high = np.searchsorted(b_start, a_end, "left")
    last = np.ones(len(a_end), bool)
    last[:-1] = high[:-1] == low[1:]
    last = np.flatnonzero(last)
    zero = np.zeros(1, np.int64)
    return np.concatenate([zero, last + 1]), np.concatenate([zero, high[last]])


def _spelled(doc: np.ndarray, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, A id, B id) as doc << 32 | a << 16 | b, ascending, and how many links each stands for."""
    na, nb = np.diff(a_at), np.diff(b_at)
    links = na * nb
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []

    def keep(key: np.ndarray, n: np.ndarray | None = None) -> None:
        if n is None:
            key, n = np.unique(key, return_counts=True)
        keys.append(key)
        times.append(n.astype(np.int64))

    large = links > LINKS
    for g in np.flatnonzero(large):  # distinct ids of a side with their counts, a slice of A's at a time
        own_a, count_a = np.unique(a[a_at[g] : a_at[g + 1]], return_counts=True)
        own_b, count_b = np.unique(b[b_at[g] : b_at[g + 1]], return_counts=True)
        for k in range(0, len(own_a), max(1, LINKS // len(own_b))):
            part = slice(k, k + max(1, LINKS // len(own_b)))
            head = (doc[g] << 32) | (own_a[part] << 16)
            keep((head[:, None] | own_b[None, :]).ravel(), (count_a[part][:, None] * count_b[None, :]).ravel())
    small = np.flatnonzero(~large)
    total = np.cumsum(links[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right")))
        g = small[at:to]
        n = links[g]
        of = np.repeat(g, n)
        k = np.arange(len(of), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        wide = nb[of]
        keep((doc[of] << 32) | (a[a_at[of] + k // wide] << 16) | b[b_at[of] + k % wide])
        at = to
    if len(keys) == 1:
        return keys[0], times[0]
    key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, times))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


_DIGITS = np.zeros((1 << 16, 6), np.uint8)
_WIDTH = np.zeros(1 << 16, np.int64)


def _digits() -> tuple[np.ndarray, np.ndarray]:
    if not _WIDTH[0]:
        number = np.arange(1 << 16)
        _WIDTH[:] = np.searchsorted([10, 100, 1000, 10000], number, "right") + 1
        for k in range(5):
            at = number[_WIDTH > k]
            _DIGITS[at, k] = 48 + at // 10 ** (_WIDTH[at] - 1 - k) % 10
    return _DIGITS, _WIDTH


def _written(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, first: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as `a1,a2|b1;a3|b2,b3`; first: the documents' first groups, and the end."""
    digits, width = _digits()
    ids = np.empty(len(a) + len(b), np.int64)
    sign = np.full(len(ids), 44, np.uint8)  # a comma
    na, nb = np.diff(a_at), np.diff(b_at)
    of_a, of_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ids[np.arange(len(a)) + b_at[of_a]] = a
    ids[np.arange(len(b)) + a_at[of_b + 1]] = b
    sign[a_at[1:] + b_at[:-1] - 1] = 124  # a bar
    stop = a_at[1:] + b_at[1:] - 1
    sign[stop] = 59  # a semicolon
    table = digits[ids]
    n = width[ids]
    table[np.arange(len(ids)), n] = sign
    flat = table[np.arange(6) <= n[:, None]].tobytes()
    ends = np.cumsum(n + 1)
    limits = np.concatenate([[0], ends[stop[first[1:] - 1]]]).tolist()
    return [hashlib.sha256(memoryview(flat)[x : y - 1]).hexdigest() for x, y in zip(limits, limits[1:])]


def _block(number: int, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
    t = tokenizers()
    whole = [" " + x if x else "" for x in texts]
    ids_a = [np.asarray(t.a(x) if x else [], np.int64) for x in whole]
    ids_b = [np.asarray(x, np.int64) for x in t.pieces.encode([x or "" for x in texts], num_threads=1)]
    raw = [np.frombuffer(x.encode(), np.uint8) for x in whole]
    good = []
    for k, (x, y, z) in enumerate(zip(ids_a, ids_b, raw)):
        if len(z) and t.bytes_a.length[x].sum() == t.bytes_b.length[y].sum() == len(z) and np.array_equal(t.bytes_b.joined(y), z) and np.array_equal(t.bytes_a.joined(x), z):
            good.append(k)
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    sha, places, times = [""] * n, [b""] * n, [b""] * n
    pairs, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if good:
        count_a, count_b = np.asarray([len(ids_a[k]) for k in good]), np.asarray([len(ids_b[k]) for k in good])
        a, b = np.concatenate([ids_a[k] for k in good]), np.concatenate([ids_b[k] for k in good])
        del ids_a, ids_b, raw
        length_a, length_b = t.bytes_a.length[a], t.bytes_b.length[b]
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        a_at, b_at = groups(end_a, end_a - length_a, end_b, end_b - length_b)
        del length_a, length_b, end_a, end_b
        first = np.searchsorted(a_at, np.concatenate([[0], np.cumsum(count_a)]))  # a text's first group
        of = np.repeat(np.arange(len(good)), np.diff(first))
        out["n_a"][good], out["n_b"][good], out["n_groups"][good] = count_a, count_b, np.diff(first)
        out["n_links"][good] = np.add.reduceat(np.diff(a_at) * np.diff(b_at), first[:-1])
        for k, x in zip(good, _written(a, b, a_at, b_at, first)):
            sha[k] = x
        key, n_links = _spelled(of, a, b, a_at, b_at)
        pairs, place, docs = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
        limits = np.searchsorted(key, np.arange(len(good) + 1) << 32).tolist()
        place, n_links = place.astype("<u4"), n_links.astype("<u8" if n_links.max() >> 32 else "<u4")
        for k, x, y in zip(good, limits, limits[1:]):
            places[k], times[k] = place[x:y].tobytes(), n_links[x:y].tobytes()
    columns = [pa.array(x) for x in (np.full(n, number), *out.values())]
    none = pa.nulls(n, pa.list_(pa.int64()))
    one = [pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))]
    rows = pa.RecordBatch.from_arrays([columns[0], pa.array(doc_ids, pa.int64()), *columns[1:], pa.array(sha), pa.array(places), pa.array(times), none, none], schema=_FIELDS)
    of_block = pa.RecordBatch.from_arrays([pa.array([number]), *(pa.nulls(1, f.type) for f in list(_FIELDS)[1:9]), *one], schema=_FIELDS)
    return pa.Table.from_batches([rows, of_block]).combine_chunks().to_batches()[0]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    doc_ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = x.as_py()
            if size and size + len(x or "") > BLOCK_BYTES:
                yield _block(number, doc_ids, texts)
                number, doc_ids, texts, size = number + 1, [], [], 0
            doc_ids.append(d)
            texts.append(x)
            size += len(x or "") + 64
    if texts:
        yield _block(number, doc_ids, texts)


def _counted(texts: pa.Table, found: pa.Table) -> pa.Table:
    """One block's texts with the corpus-wide counts of its pairs."""
    order = np.argsort(found.column("pair").to_numpy())
    count = found.column("count").to_numpy()[order]
    best = found.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for place, times in zip(texts.column("places"), texts.column("times")):
        place, times = place.as_buffer(), times.as_buffer()
        at = np.frombuffer(place, "<u4") if place.size else np.zeros(0, np.int64)
        n = np.frombuffer(times, "<u4" if times.size == place.size else "<u8").astype(np.int64) if place.size else at
        n_best.append(int(n[best[at]].sum()))
        count_sum.append(int((n * count[at]).sum()))
    kept = [texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), texts.column("groups_sha256")], names=_RESULT)


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text)."""
    blocks = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_aligned, _SCHEMA))
    pairs = blocks.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = stored(pairs.groupBy("pair").agg(F.sum("docs").alias("count")))
    top = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("top"))  # a row for each id of A at most
    counts = counts.join(F.broadcast(top), F.shiftright("pair", 16) == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    found = pairs.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    texts = blocks.where("pairs is null").drop("pairs", "docs")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_counted, schema)


def alignment(text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of A and of B."""
    t = tokenizers()
    a, b = (np.asarray(x, np.int64) for x in (t.a(" " + text) if text else [], t.pieces.encode(text or "")))
    if not text or t.bytes_a.joined(a).tobytes() != (" " + text).encode() or t.bytes_b.joined(b).tobytes() != (" " + text).encode():
        return []
    length_a, length_b = t.bytes_a.length[a], t.bytes_b.length[b]
    a_at, b_at = groups(np.cumsum(length_a), np.cumsum(length_a) - length_a, np.cumsum(length_b), np.cumsum(length_b) - length_b)
    return [(a[w:x].tolist(), b[y:z].tolist()) for w, x, y, z in zip(a_at, a_at[1:], b_at, b_at[1:])]
