"""Fingerprints, the Jaccard join and decontamination against brute force, and odd rows."""

from __future__ import annotations

import bisect
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospark.llm import _graph, decontamination, jaccard_join, winnowing

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# winnowing


@pytest.mark.parametrize(("k", "w"), [(8, 8), (3, 4), (5, 1)])
def test_windows_choose_the_rightmost_minimum(spark, odd, documents, k, w):
    df = documents.limit(40).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = df.select("text", winnowing.chosen(F.col("text"), k, w).alias("pairs")).collect()
    for r in rows:
        text, pairs = r.text or "", r.pairs
        at = [(1 << 24) - 1 - (p & ((1 << 24) - 1)) for p in pairs]
        value = dict(zip(at, [p >> 24 for p in pairs]))
        grams = max(1, len(text) - k + 1) if text else 0
        assert at == sorted(set(at)) and (bool(at) == bool(text))
        for first in range(max(1, grams - w + 1)) if text else ():
            k_ = bisect.bisect_left(at, first)
            assert k_ < len(at) and at[k_] < first + w, "every window has a chosen gram"
        same: dict = {}
        for p in at:  # equal grams have equal hashes
            assert same.setdefault(text[p : p + k], value[p]) == value[p]


def test_ties_go_right(spark):
    df = spark.createDataFrame([("a" * 40,)], "text string")
    pairs = df.select(winnowing.chosen(F.col("text"), 4, 8).alias("p")).first().p
    assert [winnowing._LOW - (p & winnowing._LOW) for p in pairs] == list(range(7, 37))


# n-gram Jaccard join


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def check_components(df, **options):
    docs = [(d, shingles(t)) for d, t in texts_of(df)]
    some = [(d, s) for d, s in docs if d is not None]
    parent = {d: d for d, _ in some}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(some, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = jaccard_join.jaccard_components(df, **options).collect()
    assert len(got) == len(docs)
    sizes = {d: len(s) for d, s in some}
    for r in got:
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
        assert r.doc_id is None or r.n_shingles == sizes[r.doc_id]


def copies(n, seed, words=60, most=6):
    """Near copies of a few texts with some words changed, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    bases = [[f"w{r.randrange(400)}" for _ in range(words)] for _ in range(4)]
    out = []
    for d in range(n):
        text = list(r.choice(bases))
        for _ in range(r.randrange(most)):
            text[r.randrange(len(text))] = f"z{r.randrange(10_000)}"
        out.append((d, " ".join(text)))
    return out


@pytest.mark.parametrize("options", [{}, {"short": 2, "block": 8}, {"short": 2, "block": 8, "split": 4}, {"short": 1, "block": 1000, "split": 1}])
def test_jaccard_components(spark, odd, none, options):
    df = spark.createDataFrame(copies(160, 6), "doc_id long, text string")
    check_components(df, **options)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for n in (0, 1, 60, 3000):
        x, y = (np.unique(r.integers(0, 1 << 64, n, np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[::2]]))
        a, b = (jaccard_join._sketches(v, np.asarray([len(v)])) for v in (x, y))
        apart = len(np.setxor1d(x, y))
        least = int(np.bitwise_count(a ^ b).sum())
        assert least <= apart and (apart - least) % 2 == 0 and (n != 60 or least > 0.8 * apart)


def test_jaccard_documents_and_odd_rows(spark, odd, none, documents):
    check_components(documents)
    check_components(odd)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_components(spark, monkeypatch):
    r = random.Random(7)
    edges = [tuple(sorted(r.sample(range(400), 2))) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    for part in (10_000, 40):  # one part, and star steps between parts
        monkeypatch.setattr(_graph, "PART", part)
        df = spark.createDataFrame(edges, "a long, b long").repartition(8)
        got = {x.node: x.component for x in _graph.components(df).collect()}
        assert got == {x: root(x) for x in parent}


# decontamination


def test_decontamination(spark, odd, none):
    item = "Train A leaves Lyon at 9 hours with 120 people, then Paul meets Marie; how many people does Paul see after Marie leaves?"
    other = "Train A leaves Nice at seven hours with 85 people, then Luc meets Jeanne; how many people does Luc see after Jeanne leaves?"
    mixed = "Train A leaves Nice at seven hours with 85 people, then Luc meets Jeanne; how many people does Marc see after Rose leaves?"
    clean = "The train was late again and nobody knew how many people were waiting at the station in the rain that evening."
    docs = [(1, "before " + item + " after"), (2, other), (3, mixed), (4, clean), (5, item.upper()), (6, None), (7, ""), (8, "Some words first. " + other), (8, "Some words first. " + other), (None, item)]
    df = spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, position int, hash string")
    bench = spark.createDataFrame([(7, item, "x"), (8, "tiny item here", "x"), (9, None, "x"), (None, item, "x"), (10, "x", "y")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()}
    assert {(1, 7), (2, 7), (8, 7)} <= got and (3, 7) not in got and not {d for d, _ in got} & {4, 6, 7, None}
    left = decontamination.decontaminate(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {3, 4, 6, 7, None}
    assert decontamination.matches(odd, bench.limit(0)).count() == 0 and decontamination.matches(none, bench).count() == 0
    assert decontamination.decontaminate(odd, bench).count() == odd.count()


def test_copies_in_another_case(spark):
    item = "Train A leaves Lyon at 9 hours with 120 people, then Paul meets Marie; how many people does Paul see after Marie leaves?"
    greek = "Ο Πέτρος πηγαίνει στην Αθήνα και η Μαρία πηγαίνει στην Πάτρα το ίδιο πρωί του Μαΐου"
    texts = [item.upper(), item.lower(), "so \u201c" + item.title() + "\u201d he said", greek.upper().replace("Σ", "σ"), item.lower().replace("120", "85"), "Train a late", "\u3000", "A"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, greek.replace("ς", "σ"))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()}
    assert {(0, 7), (1, 7), (2, 7), (3, 8)} <= got and not {d for d, _ in got} & {5, 6, 7}
    raw = df.where("doc_id = 0").selectExpr("doc_id", "cast(concat(cast(text as binary), x'20ff') as string) as text")
    assert decontamination.matches(raw, bench).count() == 1


def test_short_items_and_items_of_placeholders(spark):
    items = {
        1: "What is 12 + 7 - 3 * 4 / 2?",
        2: "3, 5, 8, 13, 21, 34, 55, 89, 144, 233",
        3: "Trains leave the old town at 9 daily",
        4: "Paris was once the largest of all towns here",
        5: "In winter the old mill stands still for 3 months",
        6: "Compute the exact sum of the following numbers: 4 8 15 16 23 42 4 8 15 16 23 42",
    }
    docs = {
        **{k: f"He wrote:{v}Then he left." if k < 3 else v for k, v in items.items()},
        11: "What is 13 + 7 - 3 * 4 / 2?",
        12: "3, 5, 8, 13, 22, 34, 55, 89, 144, 233",
        13: "as we know Trains leave the old town at 7 daily or so",
        14: "they say that King Paris was once the largest of all towns here and so on",
        15: "Question 5. In winter the old mill stands still for 4 months, why?",
        16: "Compute the exact sum of the following numbers: 5 9 16 17 24 43 5 9 16 17 24 43",
        17: "the old town at 9 and the old mill stands",
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()}
    assert got == {(k, k) for k in items} | {(13, 3), (14, 4), (15, 5), (16, 6)}


def test_whole_items_are_found(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text.lower().split()) for r in bench.collect()]
    windows = {tuple(w[k : k + 8]): i for i, w in items for k in range(len(w) - 7)}
    want = set()
    for d, t in texts_of(documents):
        w = t.lower().split()
        want |= {(d, windows[g]) for k in range(len(w) - 7) if (g := tuple(w[k : k + 8])) in windows}
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(documents, bench).collect()}
    assert got == want


def fingerprint(text: str, k: int, w: int, hashes: dict) -> list[tuple[int, int]]:
    """(hash, position) chosen by the definition: of each window the least hash, the rightmost of equal ones."""
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    values = [hashes[g] for g in grams]
    windows = [range(i, i + w) for i in range(len(values) - w + 1)] or ([range(len(values))] if values else [])
    chosen = [max((i for i in window if values[i] == min(values[j] for j in window))) for window in windows]
    return [(values[i], i) for i in dict.fromkeys(chosen)]


def test_compare_edited_against_brute_force(spark, documents, odd, none):
    """Edited texts, their digests and both likenesses, with the last row wrapping to the first, nulls and repeated rows."""
    import hashlib

    from pyspark.sql import functions as F

    from prospark.llm import winnowing

    k, w = 8, 8
    docs = documents.where("doc_id < 60").select("doc_id", "text").union(odd.where("doc_id != 6").select("doc_id", "text"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for (_, t), (_, n) in zip(rows, rows[1:] + rows[:1])]
    grams = {g for t in [t for _, t in rows] + edited for g in ([t[i : i + k] for i in range(max(1, len(t) - k + 1))] if t else [])}
    own = spark.createDataFrame([(g,) for g in grams], "g string").select("g", winnowing.hash_of(F.element_at(winnowing.chosen(F.col("g"), k, w), 1)).alias("h"))
    hashes = {r.g: r.h for r in own.collect()}
    sets = [{h for h, _ in fingerprint(t, k, w, hashes)} for _, t in rows]
    changed = [{h for h, _ in fingerprint(t, k, w, hashes)} for t in edited]
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(s, c), 12), round(like(s, n), 12)) for (d, t), e, s, c, n in zip(rows, edited, sets, changed, sets[1:] + sets[:1]))
    got = winnowing.compare_edited(docs, k, w).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_chars, r.edited_sha256), set()).add(r.fingerprint)
    assert winnowing.compare_edited(none).count() == 0


def test_positions_beyond_any_wrap(spark):
    """Equal hashes on both sides of a power of two stay two, and the right one of a window is chosen."""
    from pyspark.sql import functions as F

    from prospark.llm import winnowing

    pair = lambda h, p: (h << 31) | ((1 << 31) - 1 - p)
    spots = [(1 << 24) - 1, 1 << 24, (1 << 25) + 3, (1 << 31) - 1]
    df = spark.createDataFrame([(p, pair(5, p)) for p in spots], "p long, x long")
    assert all((r.p, 5) == (r.q, r.h) for r in df.select("p", winnowing.position_of(F.col("x")).alias("q"), winnowing.hash_of(F.col("x")).alias("h")).collect())
    assert sorted(spots, key=lambda p: pair(5, p)) == sorted(spots, reverse=True)


def test_shortest_items_and_many_placeholders(spark):
    items = {1: "Define entropy precisely", 2: "Tom has 3 cats 4 dogs 5 birds 6 fish", 3: "Gravity"}
    docs = {1: "Now: define entropy precisely!", 2: "Jim has 8 cats 9 dogs 2 birds 1 fish", 3: "so Gravity is it", 4: "define it precisely, entropy", 5: "Jim has 8 cats and 9 dogs"}
    df, bench = (spark.createDataFrame(list(x.items()), f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(df, bench).collect()} == {(1, 1), (2, 2), (3, 3)}
