"""Packing and token files against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prospark.llm import packing, token_files
from prospark.llm._shared import shared_dir
from prospark.llm._tokens import TOKENIZER, Encoder, encoder


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(library):
    r = random.Random(1)
    signs = ["abzÀéßÿ'stRE 09²½.,!<|>\t\ńń\x1c日İœÂ×", "abzÀéßÿ² 09.,$#", "ab <|endoftext|>'s "]
    texts = [None, "", "''s 'S's", "x" * 3000, *("".join(r.choice(s) for _ in range(r.randint(1, 60))) for s in signs for _ in range(700))]
    got = encoder().encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library(t) for t in texts]


def test_encoder_that_first_meets_only_whole_words(library):
    import public_tokenizers

    fresh = Encoder(public_tokenizers.path(TOKENIZER))
    for texts in (["日本語 テキスト", None, " ", "it's", "日本語"], ["then plain words 日本語"]):
        assert [x.tolist() for x in fresh.encode(pa.array(texts))] == [library(t) for t in texts]


def test_encoder_with_a_small_table(library):
    import public_tokenizers

    small = Encoder(public_tokenizers.path(TOKENIZER), runs=20, words=2)
    texts = [f"alpha{i} beta{i % 7} it's{i % 3}" for i in range(300)]
    for k in range(0, 300, 50):
        assert [x.tolist() for x in small.encode(pa.array(texts[k : k + 50]))] == [library(t) for t in texts[k : k + 50]]


def check_packing(rows, texts, library):
    """Each row's ids are in exactly one place; sequences are gapless and full, or a power of two."""
    ids = {d: np.asarray([*library(t), 2], np.uint32) for d, t in texts}
    seen: dict = {}
    sequences: dict = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    copies = {d: sum(x == d for x, _ in texts) for d, _ in texts}
    for d, x in ids.items():
        assert sum(n for _, n in seen[d]) == copies[d] * len(x)
        if copies[d] == 1:
            at = 0
            for s, n in sorted(seen[d]):
                assert s == at
                at += n
    for pieces in sequences.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0


def test_packing(spark, odd, none, documents, library):
    for df in (odd, documents):
        check_packing(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], library)
    assert packing.pack(none).count() == 0
    groups = packing.pack(documents).groupBy("step_group").sum("length").collect()
    assert all(r[1] <= 8 * 4096 for r in groups)


def test_packer_cuts_little():
    packer = packing.Packer(buffer_tokens=20_000)
    r = random.Random(2)
    windows = [w for d in range(400) for w in packer.add(d, np.zeros(r.randint(1, 6000), np.uint32))] + list(packer.finish())
    assert all(sum(len(p[2]) for p in w) == size for size, w in windows)
    assert sum(len(w) for _, w in windows) < 1300


@pytest.mark.parametrize("end", [1, 2])
def test_token_files(spark, odd, none, library, end):
    path = shared_dir(spark)
    token_files.write(odd, path, end_id=end, sample_docs=8)
    rows = token_files.read(spark, path).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0), [*library(r.text), end], r.doc_id) for r in odd.select("doc_id", "text").collect())
    at = 0
    for r, (_, ids, doc) in zip(sorted(rows, key=lambda r: r.start), want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.lookup(path, 9).tolist() == [*library("idiot"), end]
    assert token_files.lookup(path, 12345) is None
    empty = shared_dir(spark)
    token_files.write(none, empty)
    assert token_files.read(spark, empty).count() == 0


def test_damage_is_seen(spark, documents):
    path = shared_dir(spark)
    token_files.write(documents, path, sample_docs=100)
    token_files._put(path, "dictionary.bin", b"another")
    with pytest.raises(ValueError):
        token_files._open(path)
