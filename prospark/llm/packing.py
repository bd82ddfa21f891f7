"""Hierarchical multi-length packing of whole documents into training sequences.

Every document is encoded, ended with an end id, and routed to context-size tiers (powers of two).  Whole windows of the
longest tier are cut off first; the rest of a document goes to the smallest tier that holds it.  Tiers are packed from the
longest down: a window starts with the longest waiting piece of its tier, its gap is filled with the longest waiting piece
that fits (from the same or a shorter tier), and when none fits, the shortest one is cut to close the gap exactly.
Windows are dealt to step groups of equal token counts, of one tier each while they last.

Each partition packs its own rows in one pass, without a shuffle: memory holds `buffer_tokens` of waiting pieces, not the
partition.  What is left at a partition's end is cut into windows of powers of two, so no window needs padding.
A retried task sees the same split and makes the same sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import TOKENIZER, encoder

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs (doc, ids) one after the other; windows() gives lists of (doc, start, ids, doc_tokens), one list a window."""

    def __init__(self, tiers=TIERS, buffer_tokens: int = 1 << 20):
        self.tiers, self.buffer_tokens = sorted(tiers), buffer_tokens
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.pieces: list = []  # (length, number, doc, start, ids, doc_tokens), sorted when packed
        self.waiting = self.number = 0

    def _hold(self, doc, start, ids, total) -> tuple:
        self.number += 1
        return (len(ids), self.number, doc, start, ids, total)

    def add(self, doc, ids: np.ndarray):
        longest, total = self.tiers[-1], len(ids)
        whole = total - total % longest
        for at in range(0, whole, longest):
            yield longest, [(doc, at, ids[at : at + longest], total)]
        if whole < total:
            self.pieces.append(self._hold(doc, whole, ids[whole:], total))
            self.waiting += total - whole
            if self.waiting >= self.buffer_tokens:
                yield from self._pack()

    def _pack(self):
        pieces = sorted(self.pieces, key=lambda p: p[:2])
        self.pieces, self.waiting = [], 0
        while pieces:
            first = pieces.pop()
            tier = next(t for t in self.tiers if t >= first[0])
            window, gap = [first], tier - first[0]
            while gap and pieces:
                k = bisect_right(pieces, gap, key=lambda p: p[0])
                if k:
                    piece = pieces.pop(k - 1)
                else:
                    _, _, doc, start, ids, total = pieces.pop(0)
                    piece = self._hold(doc, start, ids[:gap], total)
                    insort(pieces, self._hold(doc, start + gap, ids[gap:], total), key=lambda p: p[:2])
                window.append(piece)
                gap -= piece[0]
            if gap:  # nothing is left to fill it: wait for more documents
                self.pieces, self.waiting = window, tier - gap
            else:
                yield tier, [p[2:] for p in window]

    def finish(self):
        yield from self._pack()
        rest = [p[2:] for p in self.pieces]
        left = self.waiting
        self.pieces, self.waiting = [], 0
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            window = []
            while gap:
                doc, start, ids, total = rest.pop(0)
                window.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.insert(0, (doc, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            yield size, window
            left -= size


class StepGroups:
    """Deals windows to groups of exactly `tokens` tokens, of one size each; the last of all sizes are dealt together."""

    def __init__(self, tokens: int):
        self.tokens, self.open, self.group = tokens, {}, 0

    def add(self, size: int, window):
        waiting = self.open.setdefault(size, [])
        waiting.append(window)
        if len(waiting) * size >= self.tokens:
            self.group += 1
            yield from ((self.group - 1, size, w) for w in self.open.pop(size))

    def finish(self):
        filled = 0
        for size in sorted(self.open, reverse=True):  # powers of two, so each group fills exactly but the last
            for w in self.open[size]:
                if filled + size > self.tokens:
                    self.group, filled = self.group + 1, 0
                yield self.group, size, w
                filled += size


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, tiers=TIERS, end_id: int = END_ID, step_tokens: int = 8 * 4096, buffer_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in its document, and its sequence, place there and step group.

    Null and empty texts are documents of the end id alone; null doc_ids stay null; repeated rows are packed each.  An
    empty table gives no rows.  Columns other than doc_id and text are ignored.  with_ids adds the ids of the piece.
    """
    tiers = tuple(sorted(tiers))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer, steps, names = Packer(tiers, buffer_tokens), StepGroups(step_tokens), [c.split()[0] for c in SCHEMA.split(", ")]
        rows: list[tuple] = []
        sequence = base

        def place(windows):
            nonlocal sequence
            for group, size, window in windows:
                at = 0
                for doc, start, ids, total in window:
                    row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, size, base + group)
                    rows.append(row + (ids,) if with_ids else row)
                    at += len(ids)
                sequence += 1

        def flush():
            columns = list(zip(*rows)) if rows else [()] * (len(names) + with_ids)
            types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            out = [pa.array(c, t) for c, t in zip(columns, types)]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in columns[-1]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):  # the ids of so many documents at a time are in memory
                part = batch.slice(k, 1024)
                ids = encoder(tokenizer).encode(part.column(1), end_id)
                for doc, one in zip(part.column(0).to_pylist(), ids):
                    for size, window in packer.add(doc, one):
                        place(steps.add(size, window))
                if len(rows) >= 4096:
                    yield flush()
        for size, window in packer.finish():
            place(steps.add(size, window))
        place(steps.finish())
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
