"""Cross-tokenizer alignment against the libraries and a plain walk over the ends of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from prospark.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B)), decoders.ByteLevel()


def test_ids_of_a_are_those_of_the_library(libraries):
    r = random.Random(2)
    signs = [" ", "  ", "\t", "\n", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "​", "'s", "'LL", "1", "²", "é", "é", "日本", "ا", "😀", "<|endoftext|>", "<s>", "_", "word", "Ⅷ", "\x00"]
    texts = ["".join(r.choice(signs) if r.random() < 0.8 else chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randint(1, 30))) for _ in range(4000)]
    texts += ["x" * 5000, " " * 300_000 + "x"]
    t = alignment.tokenizers()
    assert [t.a(x) for x in texts] == [libraries[0].encode(x, add_special_tokens=False).ids for x in texts]


def walked(text, libraries) -> list[tuple[list[int], list[int]]]:
    """Groups by walking both token lists to their next common end."""
    a_lib, b_lib, _ = libraries
    if not text:
        return []
    whole = (" " + text).encode()
    chars = alignment._byte_of()
    a = [(i, len(bytes(chars[c] for c in a_lib.id_to_token(i)))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
    if b"".join(x for _, x in b) != whole or sum(n for _, n in a) != len(whole):
        return []
    out, x, y, at_a, at_b = [], [], [], 0, 0
    a, b = iter(a), iter(b)
    while at_a < len(whole) or at_b < len(whole):
        if at_a <= at_b:
            i, n = next(a)
            x.append(i)
            at_a += n
        else:
            i, n = next(b)
            y.append(i)
            at_b += len(n)
        if at_a == at_b:
            out.append((x, y))
            x, y = [], []
    return out


def brute(rows, libraries) -> list[tuple]:
    every = [(d, walked(t, libraries)) for d, t in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in every]
    count: Counter = Counter()
    for c in links:
        count.update(c.keys())
    top: dict = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for (d, g), c in zip(every, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        n = [sum(map(len, side)) for side in ([x for x, _ in g], [y for _, y in g])]
        out.append((d, *n, len(g), sum(c.values()), sum(k for p, k in c.items() if count[p] == top[p[0]]), sum(k * count[p] for p, k in c.items()), sha))
    return sorted(out, key=repr)


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(documents, libraries):
    assert plain(alignment.align(documents.repartition(5))) == brute([(r.doc_id, r.text) for r in documents.collect()], libraries)


def test_odd_rows(spark, odd, none, libraries):
    assert plain(alignment.align(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()], libraries)
    assert alignment.align(none).collect() == []
    texts = ["▁x", "a  　 b", "ｆｕｌｌ ﬁ", "<0x41>", "日本語テキスト", "é́", "<|endoftext|></s>", "\t\n \x00", "😀" * 50, " ", "_" * 500 + "=" * 500]
    rows = [(i, x) for i, x in enumerate(texts)] + [(3, "<0x41>"), (None, "x")]
    got = plain(alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert got == brute(rows, libraries)


def test_pairs_spelled_out_in_slices(documents, libraries, monkeypatch):
    """Groups beyond the limit are counted by distinct ids, with the same result."""
    texts = [r.text for r in documents.limit(40).collect()] + ["日本語" * 40]
    want = alignment._block(0, list(range(41)), texts).to_pydict()
    for limit in (1, 7, 1000):
        monkeypatch.setattr(alignment, "LINKS", limit)
        assert alignment._block(0, list(range(41)), texts).to_pydict() == want


def test_groups_of_a_text(libraries):
    for text in ("the quick brown fox", "œuvre 日本 x", "", None):
        assert alignment.alignment(text) == walked(text, libraries)
