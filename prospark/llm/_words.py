"""Whole texts of an Arrow column as numpy arrays: bytes, word limits and 64-bit word hashes, without Python strings.

Words are the runs of bytes between the ASCII white space bytes 0x20 and 0x09-0x0D, with A-Z lower-cased, which in
UTF-8 is what `[^\\x20\\x09-\\x0D]+` matches in the text.  Nothing here grows with the corpus: a block of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 3 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A fixed bijection of uint64 that spreads all bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of each buf[start:end]: a polynomial by prefix sums modulo 2^64, then mixed with the length."""
    up, down = _power(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


class Block:
    """Some whole texts: bytes, and where each text starts (offsets has one more entry than there are texts)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.raw, self.offsets, self.first = buf, offsets, first
        self.n = len(offsets) - 1

    def words(self) -> Block:
        """Sets buf (lower-cased), starts and ends of words, and bounds: text d has the words bounds[d]:bounds[d+1]."""
        self.buf = LOWER[self.raw]
        edge = np.ones(len(self.raw) + 1, bool)
        edge[1:-1] = False
        edge[self.offsets] = True
        space = SPACE[self.raw]
        inside = ~space
        before = edge[:-1].copy()
        before[1:] |= space[:-1]
        after = edge[1:].copy()
        after[:-1] |= space[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        return self

    def hash(self) -> np.ndarray:
        return hashes(self.buf, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive whole texts of a string column (null: empty), about `size` bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(texts))
        yield Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, starts[1]... of consecutive slices, without a loop."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift
