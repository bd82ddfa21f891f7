"""Wrapper induction: the alignment against a plain one, pages of every kind, templates of a host, whole tables."""

from __future__ import annotations

import html as html_lib
import random
import re

import pytest

from prospark.llm import _dom, wrappers


def said(page: str | None) -> str:
    return wrappers.text_of(page)


def plain_weight(a, b) -> int:
    """Simple tree matching without any shortcut."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i + 1][j], best[i][j + 1], best[i][j] + plain_weight(x, y))
    return best[-1][-1] + 1


def test_matching_is_simple_tree_matching():
    r = random.Random(4)

    def some(depth):
        return r.randrange(3) if not depth or r.random() < 0.3 else [r.choice("abc"), [some(depth - 1) for _ in range(r.randrange(6))]]

    for _ in range(1500):
        a, b = (_dom.trees(["r", [some(3) for _ in range(r.randrange(7))]])[0] for _ in range(2))
        assert _dom.weight(a, b) == plain_weight(a, b)
        pairs = sorted(_dom.match(a, b))
        assert pairs == sorted(set(pairs)) and [j for _, j in pairs] == sorted(j for _, j in pairs)  # in order, each leaf once


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>One <b>two<br><p>thr<i>ee</i>&nbsp; &lt;four&gt;\n five</article>", "One two three <four> five"),
        ("<body><nav><a href=x>Home</a></nav><main><h1>T</h1><p>Body</p></main><footer>f</footer>", "T Body"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by A</p></header><p>Text.</p><footer>tags</footer></article>", "Title Text."),
        ("<article><p>a</p><aside>no</aside><div class='share-buttons'>no</div><form><input>no</form><script>var x='</p>no'</script><p>b</p></article>", "a b"),
        ("<article>a</article><section id=comments><article class=comment><p>no</p></article></section>", "a"),
        ("<form id=aspnet><div id=top-menu>no</div><article>yes</article></form>", "yes"),
        ("<div class='cookie-notice'>no</div><div><p>Some words stand here</p><ul><li><a href=1>menu</a><li><a href=2>menu</a></ul></div>", "Some words stand here"),
        ("<body class=has-sidebar><div class='page with-sidebar'><article>yes</article></div><div class=sidebar>no</div>", "yes"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul><dl><dt>k<dd>v</dl></article>", "1 2 3 x y k v"),
        ("<article>a <span class=ad>no <span>no</span> no</span>b</article>", "a b"),
        ("<article><p>x <!-- <p>no</p> --> y < z & w</p><p hidden>no<p style='display: none'>no</article>", "x y < z & w"),
        ("<ARTICLE><P>up</P></ARTICLE><FOOTER>no", "up"),
        ("<article><p>cut <a href='x", "cut <a href='x"),
        ("<article><style>p{}</style><noscript>no</noscript><svg><text>no</text></svg><p>ok</article>", "ok"),
        ("<article><p>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_pages(page, text):
    assert said(page) == text


def test_long_pages():
    page = "<nav><a>x</a></nav><article>" + "".join(f"<p class=c{i % 7}>word{i} &eacute;</p>" for i in range(30_000)) + "</article>"
    assert said(page) == " ".join(f"word{i} é" for i in range(30_000))
    assert said("<" * 50_000) == "" or said("<p " * 20_000) is not None


def plain(df) -> dict:
    return {r.page_id: (r.url, r.text, r.n_chars) for r in df.collect()}


def site(i: int, body: str) -> tuple:
    """A page of a host whose template nobody could tell by its elements."""
    return (i, f"https://Shop.example/{i}", f"<body><div><div>Acme shop</div><div>{body}</div><div>Call us: 555 and ask</div></div>")


def test_constant_slots_are_template(spark):
    rows = [site(i, f"<p>Story {i} of many.</p><p>It ends {i * i}.</p>") for i in range(12)]
    rows += [(50 + i, f"https://one.example/{i}", f"<article><p>Text number {i} is like no other text</p><p>Subscribe for more</p></article>") for i in range(6)]
    got = plain(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert got[3][1] == "Story 3 of many. It ends 9." and got[3][0] == "https://Shop.example/3"
    assert {got[50 + i][1] for i in range(6)} == {f"Text number {i} is like no other text" for i in range(6)}


def test_copies_are_no_template(spark):
    """Copies of a page count once, few pages make no wrapper, and near copies keep what they share."""
    page = "<article><p>The same long story, word for word.</p><p>Its second part.</p></article>"
    rows = [(i, "http://copies.example/x", page) for i in range(40)] + [(100 + i, f"http://two.example/{i}", page.replace("second", f"{i}th")) for i in range(2)]
    rows += [(200 + i, f"http://near.example/{i}", page.replace("</article>", f"<p>{i}</p></article>")) for i in range(10)]
    got = plain(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert {got[i][1] for i in range(40)} == {"The same long story, word for word. Its second part."}
    assert got[101][1].endswith("Its 1th part.") and got[203][1] == "The same long story, word for word. Its second part. 3"


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>", 5), (None, "x", None, 6), (2, "http://h/1", "", 7), (2, "http://h/1", "", 7), (3, "://", "<article>" + "long " * 50_000 + "</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long").withColumn("host", pages_host()).withColumn("text", pages_host())
    got = sorted(((r.page_id, r.url, r.n_chars) for r in wrappers.extract(pages).collect()), key=repr)
    assert got == sorted([(1, None, 1), (None, "x", 0), (2, "http://h/1", 0), (2, "http://h/1", 0), (3, "://", 249_999)], key=repr)
    empty = wrappers.extract(pages.limit(0))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.collect() == []


def pages_host():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_whole_table(spark, sf_dir):
    """The article of every page, cut out by its tags."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", lambda t: " " if re.match(r"</?(p|br|h\d)\b", t[0]) else "", inner)
        want[r.page_id] = " ".join(html_lib.unescape(inner).split())
    assert {k: v[1] for k, v in plain(wrappers.extract(pages)).items()} == want
