"""Personal data and line dedup on small hand-made texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prospark.llm import line_dedup, pii


def test_base_spans(spark):
    texts = ["a@b.c_d@e.f", "x 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é +33 (0)6 12.34.56.78", "", None]
    want = [["email:0:5", "email:5:11"], ["ip:2:9", "ip:10:17"], ["card:0:19"], ["phone:2:22", "ip:11:22"], [], []]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)).collect()}
    for i, spans in enumerate(want):
        assert [s for s in got[i].spans.split(",") if s in spans] == spans
        assert sum(got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")) == len(spans)


def test_line_dedup(spark):
    line = "a line of words that is long enough to be compared by edits"
    docs = [(1, line + "\nshort"), (2, "first\n" + line), (3, line.replace("words", "wards") + "\nshort"), (4, line.replace("words", "other")), (None, line), (5, None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string").repartition(1)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {d: r.dropped for d, r in got.items()} == {1: [], 2: [1], 3: [0], 4: [], None: [], 5: []}
    assert got[2].text == "first" and got[3].text == "short" and got[None].text == line


def distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return row[-1]


def edited_lines(rng, bases: int) -> list[str]:
    """Lines of many lengths with up to three edits at any place, and short alphabets so that segments recur."""
    lines = []
    for _ in range(bases):
        base = "".join(rng.choice(rng.choice(["ab", "abcdefgh é日"])) for _ in range(rng.randint(38, 60)))
        for _ in range(rng.randint(1, 7)):
            line = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", "日"])
            lines.append("".join(line))
    rng.shuffle(lines)
    return lines


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(5)
    words = ["", "a", "ab", "ba", "日本", *("".join(rng.choice("ab日") for _ in range(rng.randint(0, 9))) for _ in range(60))]
    pairs = [(x, y) for x in words for y in words]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    for r in df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= edits), r


IDS = [list(range(60)), [5, 5 + 2**44, 2**62, -1, 8, 8, 8, -(2**63), 2**63 - 1, 5 + 2**20, *range(100, 150)]]


@pytest.mark.parametrize("ids", IDS)
@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_against_brute_force(spark, monkeypatch, ids, hot):
    """Small, huge, negative and repeated ids; keys met in one place, or as hot ones."""
    if hot:
        monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    lines = edited_lines(random.Random(8), 60)
    docs = [(ids[d], "\n".join(lines[d * 9 : d * 9 + 9])) for d in range(-(-len(lines) // 9))]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").repartition(3)
    df = df.withColumn("digest", F.xxhash64("text"))
    got = {(r.doc_id, r.text0): r for r in line_dedup.dedup_lines(df.select("doc_id", "text", F.col("text").alias("text0"), F.lit("x").alias("digest")), hot_members=1 if hot else 1 << 14).collect()}
    digest = {(r.doc_id, r.text): r.digest for r in df.collect()}
    occurrences = [(d, pos, t, line) for d, t in docs for pos, line in enumerate(t.split("\n")) if len(line) >= 20]
    first: dict = {}
    for d, pos, t, line in sorted(occurrences, key=lambda o: (o[0], digest[o[0], o[2]], o[1])):
        first.setdefault(line, (d, pos, t))
    order = {line: (at[0], digest[at[0], at[2]], at[1]) for line, at in first.items()}
    near = {x for x in first if len(x) >= 40 and any(order[y] < order[x] and len(y) >= 40 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in first)}
    assert near
    for d, t in docs:
        want = [pos for pos, line in enumerate(t.split("\n")) if line in near or line in first and first[line] != (d, pos, t)]
        assert got[d, t].dropped == want, (d, got[d, t])
        assert got[d, t].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want)


def test_line_dedup_odd_rows(spark, odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "dropped"] and out.count() == odd.count()
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(odd.select("doc_id", F.col("text"), F.col("text").alias("before"))).collect()}
    rows = {r.doc_id: r for r in got.values()}
    assert rows[1].dropped == [1] and rows[7].dropped == [0, 1] and rows[7].text == "" and rows[2].text is None and rows[8].dropped == []
    assert rows[None].text == "the cat sat on the mat and looked at the dog"
    assert line_dedup.dedup_lines(none).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """The base patterns by Python's re, with their checks."""
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "") if kind != "email" or "@" in (text or "") else ():
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_personal_data_against_brute_force(spark, documents, odd):
    """Counts, digest and base spans of whole documents; what is added neither moves nor overlaps them."""
    secrets = spark.createDataFrame([(20_000 + i, f'token = "{i:02d}bebab91ab85687d33eeaaf9ac699e1188f962" end') for i in range(60)], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(secrets)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    got = pii.find(df).collect()
    assert len(got) == len(texts)
    want = {d: plain_spans(t) for d, t in texts}
    added = 0
    for r in got:
        spans = [s for _, _, s in want[r.doc_id]]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [sum(s.startswith(k) for s in spans) for k in PLAIN] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        every = r.spans.split(",") if r.spans else []
        assert set(spans) <= set(every) and len(every) == r.n_spans
        added += len(every) - len(spans)
    assert added


def test_trees_add_spans(spark):
    """A national number after a word for telephones, one of the form of international ones, masked mails and secrets; other numbers not."""
    rows = [f"Tel: 01 42 68 53 {i:02d} please" for i in range(60)] + [f"order {123456 + i} of 1{i:06d} parts" for i in range(60)]
    rows += [f"ring +1 (212) 555-01{i:02d} now" for i in range(60)] + [f'token = "{i:02d}bebab91ab85687d33eeaaf9ac699e1188f962" end' for i in range(60)]
    rows += [f"jo{i}(at)example(dot)org" for i in range(60)]
    rows += ["ring (212) 555-0199 now", "jo(at)example(dot)org", "see abcdef0123456789abcdef0123456789abcdef01 there"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert all(got[i] == "phone:5:19" for i in range(60)) and not any(got[i] for i in range(60, 120))
    assert all(got[i].startswith("secret:9:") for i in range(180, 240))
    assert got[300] == "phone:5:19" and got[301].startswith("email:0:") and got[302] == "secret:4:44"


def test_redact(spark, odd):
    rows = [(1, "mail a@b.com now", "x"), (1, "ip 10.1.2.3 and a@b.org", "y"), (1, "mail a@b.com now", "x"), (None, "+1 (212) 555-0199!", "z"), (2, None, "n")]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert sorted((r.text or "", r.base) for r in got) == sorted([("mail <email> now", "x"), ("ip <ip> and <email>", "y"), ("mail <email> now", "x"), ("<phone>!", "z"), ("", "n")])
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and pii.redact(odd.limit(0)).count() == 0


def test_what_fails_its_check_is_no_span(spark):
    """However many valid ones of a form there are, wrong check digits, part limits and grammar are refused."""
    good = ["pay DE89370400440532013000 now", "host 10.0.0.254 up", "mail a.b@x.example here", "card 4111 1111 1111 1111 ok"]
    bad = ["pay DE00370400440532013000 now", "host 999.999.999.999 up", "release 2024.10.11.300 is out", "mail a.b@x here", "number 4111 1111 1111 1112 ok"]
    texts = [t for t in good for _ in range(60)] + bad
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert all(got[i] for i in range(240)) and got[0].startswith("iban:4:26")
    assert {got[240 + k] for k in range(len(bad))} == {""}


def test_labels_are_no_predicates():
    cues, phones = (set(re.findall("[a-zé]{2,}", x.split("(?i)")[1].split(")")[0])) for x in (pii.CUES, pii.PHONES))
    assert not cues & phones
