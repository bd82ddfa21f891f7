"""Main text of web pages by wrapper induction: what the pages of a host share is template, what varies in it is content.

Every page becomes an outline, a tree of block elements with a number for each text.  A host's distinct pages are aligned
with one of them, its reference, by simple tree matching, and for each leaf of the reference the pages are counted whose
matched leaf holds the same text.  Leaves alike on SAME of the pages that have them, on SEEN of the host's pages and on LEAST
pages are constant: the reference with these leaves is the host's wrapper.  A page is then aligned with its host's wrapper;
its constant leaves go and what stands in the varying slots stays.  What is known by element, role or class (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) goes on any page; an `article` or `main` bounds the content where
there is one, else the whole body does, without blocks that are links.

Counts are summed within tasks before they are shuffled; outlines hold no texts, and pages themselves are never shuffled while
the wrappers are small enough to be broadcast, which Spark decides.  A host of any size is many tasks: joins by host are dealt
anew where they are skewed, and nothing gathers a host's pages.

Defined results: null or empty html gives an empty text; a null or unreadable url is a page without host, which meets no
wrapper; copies of a page count once; hosts with fewer than LEAST distinct pages have no wrapper.  If more than half of the
characters of a marked article are constant, the host's pages are copies of it and it stays whole.  Elements nested deeper than 200 count as nested so deep.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _dom
from ._shared import stored

SAME, SEEN, LEAST = 0.9, 0.3, 3
LINKED = 0.8  # share of a block's characters in links that makes it a menu, where no article is marked


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def blocks(root: _dom.Node) -> tuple[list[tuple[int, _dom.Leaf]], bool]:
    """The blocks of the content with their places among all leaves, and whether an article is marked."""
    every = _dom.leaves(root)
    inside = [(k, x) for k, (x, noise, main) in enumerate(every) if main and not noise]
    return inside or [(k, x) for k, (x, noise, _) in enumerate(every) if not noise and x.linked < LINKED * len(x.text)], bool(inside)


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, outlines = [], []
        for page in batch.column(1):
            root = _dom.parse(page.as_py() or "")
            found, _ = blocks(root)
            content.append(_dom.number("\n".join(x.text for _, x in found)))
            outlines.append(json.dumps([[k for k, _ in found], _dom.outline(root)], separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.int64()), pa.array(outlines, pa.string())], names=["host", "content", "outline"])


class _Reference:
    """The last reference's tree, as rows of a host mostly follow each other."""

    def __init__(self) -> None:
        self.text, self.tree, self.leaves, self.kept = None, None, [], []

    def of(self, text: str) -> tuple[_dom.Tree, list]:
        if _dom.forget() or text != self.text:
            self.text = text
            self.kept, outline = json.loads(text)
            self.tree, self.leaves = _dom.trees(outline)
        return self.tree, self.leaves


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, leaf, pages, same): of this task's pages, those that match a content leaf of the reference, and those equal there."""
    reference = _Reference()
    for batch in batches:
        pages: Counter = Counter()
        same: Counter = Counter()
        for name, outline, other in zip(*(c.to_pylist() for c in batch.columns)):
            tree, texts = reference.of(other)
            wanted = set(reference.kept)
            own, own_texts = _dom.trees(json.loads(outline)[1])
            for i, j in _dom.match(tree, own):
                if i in wanted:
                    pages[name, i] += 1
                    same[name, i] += texts[i] == own_texts[j]
        keys = list(pages)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([pages[k] for k in keys], pa.int64()), pa.array([same[k] for k in keys], pa.int64())], names=["host", "leaf", "pages", "same"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (a reference's outline) and constant (its constant leaves) of the hosts of pages(url, html) that have some."""
    outlines = pages.select(host(F.col("url")).alias("host"), "html").where("host != ''").mapInArrow(_outlined, "host string, content long, outline string")
    outlines = stored(outlines.groupBy("host", "content").agg(F.min("outline").alias("outline")))
    hosts = outlines.groupBy("host").agg(F.count("*").alias("distinct"), F.min(F.struct("content", "outline")).alias("reference")).where(F.col("distinct") >= LEAST)
    hosts = stored(hosts.select("host", "distinct", F.col("reference.outline").alias("reference")))
    compared = outlines.join(hosts, "host").select("host", "outline", "reference").mapInArrow(_compared, "host string, leaf int, pages long, same long")
    counts = compared.groupBy("host", "leaf").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = counts.join(hosts.select("host", "distinct"), "host").where((F.col("same") >= SAME * F.col("pages")) & (F.col("pages") >= SEEN * F.col("distinct")) & (F.col("pages") >= LEAST))
    constant = constant.groupBy("host").agg(F.collect_set("leaf").alias("constant"))  # leaves of one page at most
    return stored(hosts.join(constant, "host").select("host", F.col("reference").alias("wrapper"), "constant"))


def text_of(page: str | None, wrapper: tuple[_dom.Tree, list] | None = None, constant: list[int] | None = None) -> str:
    """The main text of one page, without the constant leaves of its host's wrapper."""
    root = _dom.parse(page or "")
    found, marked = blocks(root)
    if wrapper is not None and found:
        tree, texts = wrapper
        own, own_texts = _dom.trees(_dom.outline(root))
        fixed = set(constant or ())
        gone = {j for i, j in _dom.match(tree, own) if i in fixed and texts[i] == own_texts[j]}
        left = [(k, x) for k, x in found if k not in gone]
        if not marked or 2 * sum(len(x.text) for _, x in left) >= sum(len(x.text) for _, x in found):
            found = left
    return " ".join(x.text for _, x in found)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reference = _Reference()
    for batch in batches:
        texts = []
        for page, wrapper, constant in zip(batch.column(2), batch.column(3), batch.column(4)):
            known = reference.of(wrapper.as_py()) if wrapper.is_valid else None
            texts.append(text_of(page.as_py(), known, constant.as_py()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    found = own.join(wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper", "constant")
    return found.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
