"""N-gram Jaccard self-join of whole texts: rare-first prefix filtering with length, positional and suffix filters.

A text's set holds its distinct k-word shingles (64-bit hashes of lower-cased words).  Shingles are ordered rare first, by
counts of all texts in 2^22 hash buckets: a table of 16 MB, so it is broadcast, and any order that all texts share keeps the
prefix filter exact.  Texts of equal sets are one class from the start.

1. every class representative puts its prefix, the |x| - ceil(t|x|) + 1 rarest shingles, into postings by shingle; lists
   that could be longer than `split` are dealt over several tasks;
2. short posting lists give all pairs that pass the length and positional filters; long ones give each member's pair with
   a pivot of like length, which is linear in the list, and lists of the same members choose the same pivot;
3. distinct pairs pass the suffix filter and are verified once, exactly.  The suffix filter is a sketch of fixed size: the
   parity of a set's members in each of 1024 hash ranges.  Where two sketches differ, a range holds a member of one set
   only, so their distance is a lower bound of the symmetric difference, and close to it for sets of usual sizes;
4. the links give components.  Long lists that still hold several components are compared block by block, where only
   members of different components that pass all filters, the sketch among them, become pairs.  First each block gives no
   more than a forest over its components; a last step gives every pair that is left.  So no link between different texts is
   lost, and members of one component are never paired again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import stored
from ._words import Block, blocks, mix

BUCKETS = 1 << 22
PART = 1 << 16
SKETCH = 16  # 64-bit words of a sketch
FILTER_BITS = 1 << 25
BLOCK = 1 << 20  # bytes of whole texts that a task looks at together


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a block's texts, one after the other and each ascending, and the set sizes."""
    block.words()
    words, count = block.hash(), np.diff(block.bounds)
    doc = np.repeat(np.arange(block.n), count)
    factor = mix(np.arange(1, k + 1).astype(np.uint64), 77) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        value = np.zeros(n, np.uint64)
        for j in range(k):
            value += words[j : j + n] * factor[j]
        whole = doc[:n] == doc[k - 1 :][:n]
        value, owner = mix(value[whole], 5), doc[:n][whole]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] += words[block.bounds[short[has]] + j] * factor[j]
            value, owner = np.concatenate([value, mix(extra, 6) ^ mix(count[short].astype(np.uint64), 9)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.bincount(owner, minlength=block.n)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary column whose row i is data[at[i]:at[i + 1]]."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _sketches(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of SKETCH words: bit r is the parity of a set's members in hash range r.  value: ascending sets."""
    out = np.zeros((len(size), SKETCH), np.uint64)
    if len(value):
        cell = np.repeat(np.arange(len(size)), size) * SKETCH + (value >> np.uint64(60)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        out.reshape(-1)[cell[start]] = np.bitwise_xor.reduceat(np.uint64(1) << ((value >> np.uint64(54)) & np.uint64(63)), start)
    return out


def _read_sketches(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, SKETCH), np.uint64)
    at = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[at : at + 8 * SKETCH * len(column)].copy().view(np.uint64).reshape(-1, SKETCH)


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many texts' shingles fall in each of BUCKETS hash buckets: BUCKETS numbers, whatever the corpus.

    Tasks send their counts in compressed parts; parts of one place are added up twice, by task groups and then together.
    """

    def packed(part: int, counts: np.ndarray) -> pa.RecordBatch:
        data = zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    def count(batches):
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for block in blocks(batch.column(0), BLOCK):
                np.add.at(total, (shingle_sets(block, k)[0] % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
        for part in range(BUCKETS // PART):
            own = total[part * PART : (part + 1) * PART]
            if own.any():
                yield packed(part, own)

    def add(batches):
        last, total = None, np.zeros(PART, np.int64)
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != last and last is not None:
                    yield packed(last, total)
                    total[:] = 0
                last = part
                total += np.frombuffer(zlib.decompress(data), "<u4")
        if last is not None:
            yield packed(last, total)

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "part int, data binary")
    for salt in (F.pmod(F.spark_partition_id(), F.lit(16)), F.lit(0)):
        parts = parts.withColumn("salt", salt).repartition("part", "salt").sortWithinPartitions("part", "salt").select("part", "data").mapInArrow(add, "part int, data binary")
    out = np.zeros(BUCKETS, np.uint32)
    for r in parts.collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(zlib.decompress(r.data), "<u4")
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, k: int, num: int, den: int, split: int) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, hot, slots, sketch) of every text: k1 and k2 tell sets apart.

    Shingles whose bucket counts more than `split` are the last of a prefix: they are in hot, each with its number of slots.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK):
                value, size = shingle_sets(block, k)
                owner = np.repeat(np.arange(block.n), size)
                at = np.concatenate(([0], np.cumsum(size)))
                with np.errstate(over="ignore"):
                    keys = [np.add.reduceat(np.append(mix(value, s), np.uint64(0)), np.minimum(at[:-1], len(value))) * (size > 0) for s in (21, 22)]
                order = np.lexsort((value, sent.value[(value % np.uint64(BUCKETS)).astype(np.int64)], owner))
                length = np.where(size > 0, size - (num * size + den - 1) // den + 1, 0)
                kept = order[np.arange(len(order)) - np.repeat(at[:-1], size) < np.repeat(length, size)]
                slots = sent.value[(value[kept] % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int64) // split + 1
                lists = []
                for some, column in ((slots == 1, value[kept].view(np.int64)), (slots > 1, value[kept].view(np.int64)), (slots > 1, slots)):
                    per = np.bincount(owner[kept[some]], minlength=block.n)
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(column[some])))
                sketch = _sketches(value, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in keys), *lists, _binary(sketch, np.arange(block.n + 1) * SKETCH)],
                    ["doc_id", "n", "k1", "k2", "prefix", "hot", "slots", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>, hot array<long>, slots array<long>, sketch binary")


def _passes(n1, p1, n2, p2, num: int, den: int):
    """Length and positional filters of two set sizes and positions of a shared shingle."""
    fits = den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)
    return fits & ((num + den) * np.minimum(n1 - p1, n2 - p2) >= num * (n1 + n2))


def _near(x: np.ndarray, y: np.ndarray, n1, n2, num: int, den: int) -> np.ndarray:
    """Suffix filter: sketches x and y don't differ in more places than the symmetric difference of linked sets has members."""
    return (num + den) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (den - num) * (n1 + n2)


def _groups(batches, read, keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted batches, and where groups (rows of equal first `keys` columns) start in them; no group is cut."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = read(batch)
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        start = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0))))
        held = [c[start[-1] :] for c in cols]
        if len(start) > 1:
            yield [c[: start[-1]] for c in cols], start[:-1]
    if held is not None and len(held[0]):
        yield held, np.zeros(1, np.int64)


def _within(size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _pairs(postings: DataFrame, num: int, den: int, short: int) -> DataFrame:
    """(a, b) candidates of postings (shingle, slot, rep, n, position), and the postings of long lists (b null).

    Slots are parts of one list: -1 is all of it.
    """
    names = ["a", "b", "shingle", "n", "position"]

    def emit(rep, n, p, i, j):
        ok = _passes(n[i], p[i], n[j], p[j], num, den) & (rep[i] != rep[j])
        if ok.any():
            a, b = np.minimum(rep[i], rep[j])[ok], np.maximum(rep[i], rep[j])[ok]
            null = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), null, null, null], names)

    def run(batches):
        for (h, slot, n, rep, p), start in _groups(batches, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns], 2):
            size = np.diff(np.append(start, len(h)))
            few = (size <= short) & (slot[start] < 0)
            some, sizes = start[few], size[few]
            for gap in range(1, short):  # all pairs of short lists whose members are `gap` apart
                i = np.repeat(some, np.maximum(sizes - gap, 0)) + _within(np.maximum(sizes - gap, 0))
                yield from emit(rep, n, p, i, i + gap)
            some, sizes = start[~few], size[~few]
            if not len(some):
                continue
            i = np.repeat(some, sizes) + _within(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.nulls(len(i), pa.int64()), pa.array(h[i]), pa.array(n[i]), pa.array(p[i])], names)
            rank = mix(rep.view(np.uint64), 41)
            for s, z in zip(some, sizes):
                first = s
                while first < s + z:  # members of like length; one pivot for all lists they share
                    to = s + int(np.searchsorted(n[s : s + z], den * n[first] // num, "right"))
                    pivot = first + int(np.argmin(rank[first:to]))
                    yield from emit(rep, n, p, np.full(to - first, pivot), np.arange(first, to))
                    first = to

    ordered = postings.select("shingle", "slot", "n", "rep", F.col("position").cast("long").alias("position")).repartition("shingle", "slot").sortWithinPartitions("shingle", "slot", "n", "rep")
    return ordered.mapInArrow(run, "a long, b long, shingle long, n long, position long")


def _set_members(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, members) of the rows whose doc_id is wanted, and of few others.

    A bitmap of fixed size tells most texts that aren't wanted; joins with what this gives are exact.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.select(bit.alias("bit")).select(F.floor(F.col("bit") / 32768).alias("bucket"), (F.col("bit") % 32768).alias("at"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect():
        bitmap[r.bucket * 4096 : r.bucket * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches):
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((sent.value[bit >> 3] >> (bit & 7)) & 1 == 1))
            for block in blocks(batch.column(1), BLOCK):
                value, size = shingle_sets(block, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), _binary(value, np.concatenate(([0], np.cumsum(size))))], ["doc_id", "members"])

    return docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit")).mapInArrow(sets, "doc_id long, members binary")


def _verify(pairs: DataFrame, classes: DataFrame, members, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of different texts whose sets have den * overlap >= num * union; each is looked at once.

    members gives the sets, once it is told the ids of texts that are in a pair.
    """

    def suffix(batches):
        for batch in batches:
            n = batch.column(4).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)
            ok = _near(_read_sketches(batch.column(2)), _read_sketches(batch.column(3)), n, 0, num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    pairs = pairs.join(classes.select(F.col("rep").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("n1")), "a").join(classes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("n2")), "b")
    pairs = stored(pairs.select("a", "b", "x", "y", "n1", "n2").mapInArrow(suffix, "a long, b long"))
    sets = members(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def linked(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
    both = one.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
    return both.select("a", "b", "ma", "mb").mapInArrow(linked, "a long, b long")


class _Forest:
    """Union-find over the components that meet in one block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _block_pairs(lists: DataFrame, num: int, den: int, forest: int) -> DataFrame:
    """(a, b) of lists (shingle, blocks, rep, n, position, component, sketch): members of different components near by sketch.

    Lists are cut into blocks, and every block meets every other.  With forest 1 a meeting gives at most one pair less than
    it has components, the nearest first; with 2 such pairs in another order; with 0 all of them.
    """
    slot = lists.withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    ordered = slot.select("shingle", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "rep", "n", "position", "component", "sketch").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "n", "rep")

    def read(batch):
        return [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:8]), _read_sketches(batch.column(8))]

    def meet(i, j, slot, rep, n, p, c, sketch):
        left, right = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
        joined, c = _Forest(), c.copy()
        step = max(1, (1 << 16) // max(1, len(right)))
        for at in range(0, len(left), step):
            x = left[at : at + step]
            ok = (c[x][:, None] != c[right]) & _passes(n[x][:, None], p[x][:, None], n[right], p[right], num, den)
            if i == j:
                ok &= x[:, None] < right
            a, b = np.nonzero(ok)
            a, b = x[a], right[b]
            near = _near(sketch[a], sketch[b], n[a], n[b], num, den)
            a, b = a[near], b[near]
            if forest and len(a):
                by = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) if forest == 1 else mix(rep[a].view(np.uint64), 43) ^ mix(rep[b].view(np.uint64), 44)
                order = np.argsort(by, kind="stable")
                keep = [k for k, x1, x2 in zip(order.tolist(), c[a[order]].tolist(), c[b[order]].tolist()) if joined.join(x1, x2)]
                a, b = a[keep], b[keep]
                known, inverse = np.unique(c, return_inverse=True)
                c = np.asarray([joined.root(v) for v in known.tolist()], np.int64)[inverse]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])

    def run(batches):
        for cols, start in _groups(batches, read, 3):
            for s, e in zip(start, np.append(start[1:], len(cols[0]))):
                yield from meet(cols[1][s], cols[2][s], *(c[s:e] for c in cols[3:]))

    return ordered.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (75, 100), short: int = 16, split: int = 1 << 16, block: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: linked texts have Jaccard similarity of at least threshold.

    Texts with fewer than k words are one shingle; texts without words have n_shingles 0 and are components of their own.
    Rows of a null doc_id link with nothing and have a null component_id; rows of equal doc_id must have equal text, else
    the links of either count.  Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    num, den = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(prefixes(docs, bucket_counts(docs, k), k, num, den, split))
    first = [F.first(c).alias(c) for c in ("prefix", "hot", "slots", "sketch")]
    classes = stored(sets.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), *first))
    plain = classes.select("rep", "n", F.posexplode("prefix").alias("position", "shingle")).withColumn("slot", F.lit(-1).cast("long"))
    hot = classes.where("size(hot) > 0").select("rep", "n", "k1", F.size("prefix").alias("before"), F.posexplode(F.arrays_zip("hot", "slots")).alias("i", "x"))
    hot = hot.select("rep", "n", (F.col("before") + F.col("i")).alias("position"), F.col("x.hot").alias("shingle"), F.pmod("k1", F.col("x.slots")).alias("slot"))
    found = stored(_pairs(plain.unionByName(hot), num, den, short))
    links = stored(_verify(found.where("b is not null").select("a", "b").distinct(), classes, lambda ids: _set_members(docs, ids, k), num, den))
    linked = components(links)
    lists, members = found.where("b is null").select(F.col("a").alias("rep"), "shingle", "n", "position"), None
    for forest in (1, 2, 0):
        # lists whose members are all of one component are settled
        own = lists.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        size = F.greatest(F.lit(block), F.least(F.lit(16 * block), F.floor(F.count("*") / 64)))
        open_ = own.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / size).cast("long").alias("blocks")).where("lo < hi").select("shingle", "blocks")
        own = stored(own.join(open_, "shingle"))
        if own.isEmpty():
            break
        lists = own.select("rep", "shingle", "n", "position")
        if members is None:
            members = stored(_set_members(docs, lists.select(F.col("rep").alias("doc_id")), k))
        pairs = stored(_block_pairs(own.join(classes.select("rep", "sketch"), "rep"), num, den, forest).distinct())
        more = stored(_verify(pairs, classes, lambda ids: members, num, den))
        n_pairs, n_more = pairs.count(), more.count()
        if n_more:
            linked = components(linked.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        if n_more == n_pairs:  # a forest without a false pair has joined all that is to be joined
            break
    labels = classes.select("n", "k1", "k2", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("label"))
    some = sets.where("n > 0").select("doc_id", "n", "k1", "k2").join(labels, ["n", "k1", "k2"], "left")
    none = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("label"))
    out = some.select("doc_id", "n", "label").unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
