"""Quality, toxicity and the language model: held-out accuracy, exact likelihoods, odd rows."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from prospark.llm import hmm, quality, toxicity
from prospark.llm._shared import held_out
from prospark.llm.queries import QUERIES


def auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / max(1, len(pos) * len(neg))


@pytest.mark.parametrize(("name", "label", "modulus", "remainder"), [("op10_quality", "quality", 5, 0), ("op5_toxicity", "toxic", 4, 2)])
def test_held_out_labels(spark, name, label, modulus, remainder):
    d = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, d)
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert auc([(r.score, r[label]) for r in rows if r.held_out]) > 0.85


def test_odd_rows(spark, odd, none, labels):
    for f in (quality.quality, toxicity.toxicity):
        assert f(odd, labels).count() == odd.count()
        assert f(odd, labels.limit(0)).count() == odd.count()
        assert f(none, labels).count() == 0
    model = quality.fit(odd, labels, ~held_out(5, 0))
    assert set(quality.score(odd, model).columns) == {*odd.columns, "predicted"}


def edits(a: str, b: str) -> int:
    """Two for each edit or swap of neighbours that makes b of a; one where a sign or digit of a stands for a letter."""
    row, last = list(range(0, 2 * len(b) + 1, 2)), []
    for i, x in enumerate(a, 1):
        row, last, before = [2 * i], row, last
        for j, y in enumerate(b, 1):
            swap = before[j - 2] + 2 if i > 1 and j > 1 and (x, a[i - 2]) == (b[j - 2], y) else 99
            row.append(min(last[j] + 2, row[-1] + 2, swap, last[j - 1] + (0 if x == y else 2 if x.isalpha() else 1)))
    return row[-1]


def test_automaton():
    words = ["idiot", "worthless", "scum", "pathetic", "crétin", "scheiße", "日本語です"]
    automaton = toxicity.Automaton(words)
    tries = ["idiot", "idjot", "idot", "idioot", "1diot", "1d1ot", "1d10t", "xdiot", "idjjt", "worthles", "worhtless", "wrthlss", "worxxxess", "scum", "skum", "sc*m", "5c*m", "$cum", "idito", "diiot", "didot", "wrothlses", "wrothlsse", "csum", "pathetci", "ptahteic", "pathetik", "patetic", "", "other", "cretin", "cr\u00e8tin", "scheise", "scheisse", "cheiße", "diot", "jdiot", "oorthless", "rthless", "xidiot", "日語です", "日本誤です", "ñ"]
    data = b"".join(t.encode() for t in tries)
    ends = np.cumsum([len(t.encode()) for t in tries])
    starts = ends - [len(t.encode()) for t in tries]
    word, n = automaton.match(np.frombuffer(data, np.uint8), starts, ends)
    for t, w, e in zip(tries, word, n):
        allowed = lambda x: 1 if len(x) < 5 else 2 if len(x) < 9 else 4
        near = [(edits(t, x), x) for x in words if t]
        best = min((p for p in near if p[0] <= allowed(p[1])), default=None)
        assert (w == -1) == (best is None), t
        assert best is None or e == best[0], t


def test_misspelled_and_quoted():
    model = toxicity.Model({"idiot": 3.0, "worthless": 3.0}, {})
    import pyarrow as pa

    from prospark.llm._words import blocks

    block = next(blocks(pa.array(["you are an idjot", 'he told us "you idiot" then', "fine", "", "sûr idiot goût", "he told us “you idiot” then", "«idiot» he is", "idiot” “idiot"])))
    x = model.features(block)
    assert x[0, 2] > 0 and x[0, 6] > 0 and x[1, 1] > 0 and x[1, 0] == 0 and not x[2:4, :10].any()
    assert x[4, 0] > 0 and x[4, 1] == 0, "letters that share bytes with marks don't quote"
    assert all(x[i, 1] > 0 and x[i, 0] == 0 and x[i, 2] == 0 for i in (5, 6)), "curly and angled marks quote, and aren't part of the word"
    assert x[7, 0] > 0


def test_base_score_and_counts(spark, odd, none):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    rows = odd.select("doc_id", "text").collect()
    words = [re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate(low)) for r in rows]
    held = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2 for r in rows]
    counts, texts = Counter(w for ws, h in zip(words, held) if not h for w in ws), held.count(False)
    total, distinct = sum(counts.values()) + texts, len(counts) + 1
    want = sorted((len(w) + 1, sum(counts[x] > 0 for x in w) + 1, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((texts + 1) / (total + distinct + 1)), h) for w, h in zip(words, held))
    got = sorted((r.n_tokens, r.n_known, r.base_score, r.held_out) for r in hmm.language_model(odd, states=3, iterations=2).collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert hmm.language_model(none).count() == 0


def test_forward_is_exact():
    r = np.random.default_rng(3)
    model = hmm.Hmm(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(4), 3).T)
    texts = [r.integers(0, 4, n) for n in (1, 4, 6, 2)]
    got = hmm.forward(model, np.concatenate(texts).astype("<u4"), np.asarray([len(t) for t in texts]))
    for t, g in zip(texts, got):
        p = 0.0
        for path in itertools.product(range(3), repeat=len(t)):
            q = model.start[path[0]] * model.emit[t[0], path[0]]
            for a, b, o in zip(path, path[1:], t[1:]):
                q *= model.move[a, b] * model.emit[o, b]
            p += q
        assert abs(g - math.log10(p)) < 1e-9


def test_baum_welch_raises_the_likelihood(spark, documents):
    training = ~held_out(7, 2)
    counts = hmm.word_counts(documents, training, 64)
    v = hmm.vocabulary(counts, documents.where(training).count(), 512, 64)
    chunks = hmm.symbol_chunks(documents, training, v).cache()
    model, before = hmm.initial(chunks, v.size, 4), None
    for _ in range(3):
        scores = [(r.n_tokens, r.score) for r in hmm.score_chunks(chunks, counts, v, model, 512).where("trained").collect()]
        likelihood = sum(s for _, s in scores) / sum(n for n, _ in scores)
        assert before is None or likelihood > before
        before, model = likelihood, hmm.baum_welch(chunks, model)


@pytest.mark.parametrize("segment", [7, 256])
def test_expected_counts_of_whole_texts(monkeypatch, segment):
    """Texts of many segments: starts, moves and emissions equal those of a forward-backward recursion over the whole text."""
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    r = np.random.default_rng(5)
    model = hmm.Hmm(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(5), 3).T)
    texts = [r.integers(0, 5, n) for n in (1, 6, 7, 8, 14, 15, 700, 3)]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        alpha, scale = np.zeros((len(t), 3)), np.zeros(len(t))
        for i, o in enumerate(t):
            a = (alpha[i - 1] @ model.move if i else model.start) * model.emit[o]
            scale[i] = a.sum()
            alpha[i] = a / scale[i]
        beta = np.ones(3)
        for i in range(len(t) - 1, -1, -1):
            emits[t[i]] += alpha[i] * beta
            if i:
                ahead = model.emit[t[i]] * beta / scale[i]
                moves += model.move * np.outer(alpha[i - 1], ahead)
                beta = model.move @ ahead
        starts += alpha[0] * beta
    got = hmm.expect(model, np.concatenate(texts).astype("<u4"), np.asarray([len(t) for t in texts]))
    for g, w in zip(got, (starts, moves, emits)):
        assert np.allclose(g, w, rtol=1e-4, atol=1e-4)
    assert abs(got[1].sum() - sum(len(t) - 1 for t in texts)) < 1e-2


def test_model_is_a_distribution(spark, documents):
    """Sequences of symbols of one length have probability one in all, and so have a class's words with an unseen one."""
    r = np.random.default_rng(9)
    model = hmm.Hmm(r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(4), 3).T)
    for n in (1, 2, 4):
        all_ = np.asarray(list(itertools.product(range(4), repeat=n)), "<u4")
        assert abs((10.0 ** hmm.forward(model, all_.reshape(-1), np.full(len(all_), n))).sum() - 1) < 1e-9
    counts = hmm.word_counts(documents, ~held_out(7, 2), 16)
    v = hmm.vocabulary(counts, documents.count(), 64, 16)
    share = np.zeros(16)
    for w in counts.collect():
        if w.n * 64 < v.tokens - v.texts:
            share[w["class"]] += (w.n + 1) / (v.class_tokens[w["class"]] + v.class_words[w["class"]] + 1)
    assert np.allclose(share + 1 / (v.class_tokens + v.class_words + 1), 1)


def test_votes_against_brute_force(spark, odd, labels):
    """Every score is the vote of the nearest labelled vectors by exact cosine, one document at a time."""
    model = quality.fit(odd, labels, ~held_out(5, 0))
    from prospark.llm._words import blocks

    texts = [r.text or "" for r in odd.collect()]
    import pyarrow as pa

    tf = np.concatenate([quality.features(b) for b in blocks(pa.array(texts))])
    latent = quality.weigh(tf.copy(), model.idf) @ model.project
    want = []
    for x in latent:
        cosine = [max(float(x @ v) / max(float(np.linalg.norm(x)), 1e-9), 0.0) for v in model.vectors.T]
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: model.neighbours]
        votes = [cosine[i] ** model.power * model.weight[i] for i in near]
        want.append((sum(w * model.label[i] for w, i in zip(votes, near)) + 1e-4 * model.prior) / (sum(votes) + 1e-4))
    got = sorted(r.score for r in quality.score(odd, model).collect())
    assert np.allclose(got, sorted(want), atol=1e-4)
