"""Exact, fast encoding of whole texts with a public word-level BPE tokenizer.

word_bpe_49k.json drops white space and never joins across it, nor across the letter runs, single digits and other runs
it cuts words into.  So the ids of a text are the ids of its runs in order.  Runs repeat far more often than texts: each
Python worker keeps a bounded table from run hash to ids, and asks the tokenizers library only for runs it has not met.
Words with anything but printable Latin-1, with an apostrophe or with `<|` go to the library whole.
Runs are told apart by 64-bit hashes; longer ones than 64 bytes go to the library too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._words import LOWER, SPACE, Block, blocks, hashes, ragged

TOKENIZER = "word_bpe_49k.json"
_LETTER, _DIGIT, _OTHER, _BAD = 1, 2, 3, 4
_ASCII = np.full(256, _BAD, np.uint8)
_ASCII[0x21:0x7F] = _OTHER
_ASCII[0x30:0x3A] = _DIGIT
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_ASCII[0x27] = _BAD
_ASCII[SPACE] = 0
_AFTER_C2 = np.full(256, _BAD, np.uint8)
_AFTER_C2[0xA1:0xC0] = _OTHER
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_AFTER_C3 = np.full(256, _LETTER, np.uint8)
_AFTER_C3[[0x97, 0xB7]] = _OTHER
_LOWER_C3 = np.arange(256, dtype=np.uint8)
_LOWER_C3[0x80:0x9F] += 0x20
_LOWER_C3[0x97] = 0x97


class Encoder:
    """encode(column) gives what Tokenizer.encode(text, add_special_tokens=False).ids gives for each text (null: empty)."""

    def __init__(self, path: str, runs: int = 2_000_000, words: int = 50_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.limit, self.words_limit, self.words = runs, words, {}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.len, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _whole(self, word: bytes) -> np.ndarray:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.words_limit:
                self.words.clear()
            ids = self.words[word] = self._library(word.decode())
        return ids

    def _learn(self, keys: np.ndarray, runs: list[bytes]) -> None:
        """Ids of unseen runs: many together, cut after each token that ends a run; alone where that doesn't come out."""
        got: list[np.ndarray] = []
        for k in range(0, len(runs), 8192):
            part = runs[k : k + 8192]
            ids = self._library(b"\n".join(part).decode())
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                got.append(np.diff(stops, prepend=0))
                got.append(ids)
            else:
                each = [self._library(r.decode()) for r in part]
                got.append(np.asarray([len(x) for x in each]))
                got.append(np.concatenate(each))
        if len(self.keys) + len(keys) > self.limit:
            self._forget()
        length = np.concatenate(got[0::2])
        at = len(self.ids) + np.concatenate(([0], np.cumsum(length)[:-1]))
        self.ids = np.concatenate([self.ids, *got[1::2]])
        keys, at, length = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.len, length])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.len = keys[order], at[order], length[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)

    def _block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the count for each text."""
        raw = block.raw
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[block.offsets] = True
        buf, kind = LOWER[raw], _ASCII[raw]
        second = np.zeros(n, bool)
        if (raw >= 0x80).any():
            for lead, table in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
                at = np.flatnonzero(raw[:-1] == lead)
                kind[at] = kind[at + 1] = table[raw[at + 1]]
                second[at + 1] = True
                if lead == 0xC3:
                    buf[at + 1] = _LOWER_C3[raw[at + 1]]
        same = np.zeros(n, bool)  # as the byte before
        same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != _DIGIT)
        same |= second
        same &= ~edge[:-1]
        first = np.flatnonzero(~same & (kind > 0))
        last = np.ones(n, bool)
        last[:-1] = ~same[1:]
        end = np.flatnonzero(last & (kind > 0)) + 1
        # words with anything unusual are single runs
        odd = kind == _BAD
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        odd = np.flatnonzero(odd)
        strange = np.zeros(0, np.int64)
        if len(odd) or (end - first > 64).any():
            odd = np.concatenate([odd, first[end - first > 64]])
            space = kind == 0
            begin = ~space & edge[:-1]
            begin[1:] |= ~space[1:] & space[:-1]
            begin[0] |= ~space[0]
            begin = np.flatnonzero(begin)
            stop = ~space & edge[1:]
            stop[:-1] |= ~space[:-1] & space[1:]
            stop = np.flatnonzero(stop) + 1
            bad = np.unique(np.searchsorted(begin, odd, "right") - 1)
            word = np.searchsorted(begin, first, "right") - 1
            keep = ~np.isin(word, bad)
            order = np.argsort(np.concatenate([first[keep], begin[bad]]), kind="stable")
            strange = np.concatenate([np.zeros(keep.sum(), bool), np.ones(len(bad), bool)])[order]
            first, end = np.concatenate([first[keep], begin[bad]])[order], np.concatenate([end[keep], stop[bad]])[order]
            strange = np.flatnonzero(strange)
        keys, where, inverse = np.unique(hashes(buf, first, end), return_index=True, return_inverse=True)
        own = np.zeros(len(keys), bool)  # of words that always go to the library whole
        if len(strange):
            own[inverse[strange]] = True
            own[np.delete(inverse, strange)] = False
        found = self._find(keys)
        new = np.flatnonzero((found < 0) & ~own)
        if len(new):
            data = buf.tobytes()
            self._learn(keys[new], [data[a:b] for a, b in zip(first[where[new]].tolist(), end[where[new]].tolist())])
            found = self._find(keys)
            if (found[~own] < 0).any():  # the table was full and forgot runs of this very block
                new = np.flatnonzero((found < 0) & ~own)
                self._learn(keys[new], [data[a:b] for a, b in zip(first[where[new]].tolist(), end[where[new]].tolist())])
                found = self._find(keys)
        ids = self.ids
        if len(self.keys):
            start, length = self.at[found], self.len[found]
        else:  # nothing but words that go to the library whole has been met
            start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(strange):
            data = raw.tobytes()
            whole = [self._whole(data[a:b]) for a, b in zip(first[strange].tolist(), end[strange].tolist())]
            length_of = length[inverse]
            start_of = start[inverse]
            length_of[strange] = [len(x) for x in whole]
            start_of[strange] = len(ids) + np.concatenate(([0], np.cumsum(length_of[strange])[:-1]))
            ids = np.concatenate([ids, *whole]) if whole else ids
        else:
            length_of, start_of = length[inverse], start[inverse]
        total = np.concatenate(([0], np.cumsum(length_of)))
        of_text = total[np.searchsorted(first, block.offsets)]
        return ids[ragged(start_of, length_of)], np.diff(of_text)

    def encode(self, texts: pa.Array, end: int | None = None) -> list[np.ndarray]:
        """uint32 ids of each text, with the id `end` after each if given."""
        out: list[np.ndarray] = []
        for block in blocks(texts):
            ids, counts = self._block(block)
            for one in np.split(ids, np.cumsum(counts)[:-1]):
                out.append(one if end is None else np.append(one, np.uint32(end)))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder; `name` is a file of the public_tokenizers folder, found on the executor."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(public_tokenizers.path(name))
    return _encoders[name]
