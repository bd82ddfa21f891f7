"""Pages as trees of blocks, and their alignment by simple tree matching.

A tree holds block elements; what stands between their tags is a leaf: inline markup doesn't split it.  Tags may be left
open, as HTML has it: a block start ends a paragraph, an item ends the item before, an end tag ends all within.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
_TOLD = re.compile(r"class|id|role|hidden|itemprop|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
# fixed values: element names of HTML by how they are parsed
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("audio canvas iframe math noembed noframes noscript object script select style svg template textarea title video xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
DEEPEST = 200  # what is nested deeper counts as nested so deep
#: An open element of the values ends when the key starts, within the nearest of the limits.
_ENDS = {
    **{h: (HEADINGS, ()) for h in HEADINGS},
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    **{x: (("dd", "dt"), ("dl",)) for x in ("dd", "dt")},
    **{x: (("td", "th"), ("tr", "table")) for x in ("td", "th")},
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    **{x: (("tbody", "thead", "tfoot", "caption"), ("table",)) for x in ("tbody", "thead", "tfoot")},
}
# fixed values: what isn't an article, by element, by ARIA role, and by words of class and id
_NOT_BY_TAG = frozenset("aside button dialog fieldset footer form head header label legend menu nav".split())
_NOT_BY_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NOT_BY_WORD = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)


class Node:
    __slots__ = ("tag", "label", "kids", "noise", "main", "head", "open")

    def __init__(self, tag: str, label: str, noise: bool, main: bool, head: bool):
        self.tag, self.label, self.noise, self.main, self.head = tag, label, noise, main, head
        self.kids: list = []
        self.open = 0  # elements of the same name open within, for inline ones


class Leaf:
    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label for matching, whether it isn't part of an article, whether it is one, whether it is a header."""
    noise, main, head, label = tag in _NOT_BY_TAG, tag in ("article", "main"), tag == "header", tag
    if attributes and _TOLD.search(attributes):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "class" or name == "id":
                label += "." + value
                if tag not in ("body", "html", "main"):
                    words = {w.lower() for x in value.split() for w in _PARTS.findall(x) if not re.match("has-|no-|with-|without-", x)}
                    head = head or "header" in words
                    noise = noise or head or not words.isdisjoint(_NOT_BY_WORD)
            elif name == "role":
                noise, main = noise or value.lower() in _NOT_BY_ROLE, main or value.lower() in ("main", "article")
            elif name == "itemprop":
                main = main or value == "articleBody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                noise, head = True, False
    return label, noise, main and not noise, head


def parse(page: str) -> Node:
    root = Node("", "", False, False, False)
    stack, run = [root], []
    linked, link = 0, False
    unescape = html.unescape

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            stack[-1].kids.append(Leaf(text, linked))
        run.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        run.append(text)
        if link:
            linked += len(text)

    at, end = 0, len(page)
    find = _TAG.search
    while (m := find(page, at)) is not None:
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "a":
                link = False
            if tag in BLOCKS:
                if any(n.tag == tag for n in stack) or tag == "p":
                    flush()
                if any(n.tag == tag for n in stack):
                    while stack.pop().tag != tag:
                        pass
            elif stack[-1].tag == tag:
                if stack[-1].open:
                    stack[-1].open -= 1
                else:
                    flush()
                    stack.pop()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>|</{tag}$", re.I).search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style", "title", "textarea", "xmp"):
                at = end
            continue
        if stack[-1].tag == "head" and tag not in _IN_HEAD:
            stack.pop()
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag == "a":
            link = True
        if tag not in BLOCKS:
            if stack[-1].tag == tag:
                stack[-1].open += 1
            elif tag in _NOT_BY_TAG or attributes and _TOLD.search(attributes):
                label, noise, _, _ = _kind(tag, attributes)
                if noise and len(stack) < DEEPEST:
                    flush()
                    node = Node(tag, label, True, False, False)
                    stack[-1].kids.append(node)
                    stack.append(node)
            continue
        flush()
        while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag not in BLOCKS):
            stack.pop()
        ends, limits = _ENDS.get(tag, ((), ()))
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if tag in HEADINGS:
                    break
        node = Node(tag, *_kind(tag, attributes))
        if node.main:
            for n in stack:
                if n.tag == "form":
                    n.noise = False  # the whole page is a form
        stack[-1].kids.append(node)
        if len(stack) < DEEPEST:
            stack.append(node)
    if at < end:
        say(page[at:])
    flush()
    return root


def leaves(node: Node, noise: bool = False, inside: bool = False, head: bool = False) -> list[tuple[Leaf, bool, bool, bool]]:
    """All leaves in page order, with whether they are noise and inside an article; within its header only headings count."""
    out: list = []
    todo = [(node, noise, inside, head)]
    while todo:
        x, noise, inside, head = todo.pop()
        if isinstance(x, Leaf):
            out.append((x, noise or head, inside))
            continue
        if x.head and inside and not noise:
            head = True
        elif x.noise:
            noise = True
        elif x.tag in HEADINGS:
            head = False
        inside = inside or x.main and not noise
        todo.extend((k, noise, inside, head) for k in reversed(x.kids))
    return out


def outline(node: Node) -> list:
    """The tree as [label, children], a leaf as a number for its text: what alignment needs."""
    return [node.label, [number(k.text) if isinstance(k, Leaf) else outline(k) for k in node.kids]]


def number(text: str) -> int:
    """53 bits that stand for a text, in every process alike."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()) >> 11


class Tree:
    """A node of an outline with its shape (told apart by a number), its size and the range of its leaves."""

    __slots__ = ("label", "kids", "shape", "size", "low", "high")


_shapes: dict = {}
_weights: dict = {}
_KEPT = 200_000


def forget() -> bool:
    """Bounds what is remembered of shapes; if so, trees made before can't be matched with later ones."""
    if len(_shapes) > _KEPT:
        _shapes.clear()
        _weights.clear()
        return True
    return False


def trees(outline: list) -> tuple[Tree, list]:
    """The tree of an outline, and its leaves in order."""
    texts: list = []

    def grow(x) -> Tree:
        t = Tree()
        t.low = len(texts)
        if isinstance(x, list):
            t.label, t.kids = x[0], [grow(k) for k in x[1]]
            t.size = 1 + sum(k.size for k in t.kids)
            key = (x[0], *(k.shape for k in t.kids))
        else:
            texts.append(x)
            t.label, t.kids, t.size, key = "#", [], 1, "#"
        t.shape = _shapes.setdefault(key, len(_shapes))
        t.high = len(texts)
        return t

    return grow(outline), texts


def _ends(a: list[Tree], b: list[Tree]) -> tuple[int, int]:
    """How many children of equal shape two lists begin and end with: some best alignment pairs these."""
    n = min(len(a), len(b))
    front = next((k for k in range(n) if a[k].shape != b[k].shape), n)
    back = next((k for k in range(n - front) if a[-1 - k].shape != b[-1 - k].shape), n - front)
    return front, back


def _table(a: list[Tree], b: list[Tree]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest alignment of two lists of children in order: its weight and its pairs."""
    labels = [x.label for x in a]
    if len(set(labels)) == len(a) and labels == [x.label for x in b]:  # others than these pairs have no weight
        return sum(map(weight, a, b)), [(k, k) for k in range(len(a))]
    shapes_a, of_a = np.unique([x.shape for x in a], return_index=True)
    shapes_b, of_b = np.unique([x.shape for x in b], return_index=True)
    each = np.asarray([[weight(a[i], b[j]) for j in of_b] for i in of_a], np.int64)
    row_of, column_of = np.searchsorted(shapes_a, [x.shape for x in a]), np.searchsorted(shapes_b, [x.shape for x in b])
    above = np.zeros(len(b) + 1, np.int64)
    left, up = [], []
    for i in range(len(a)):
        row = above.copy()
        w = each[row_of[i]][column_of]
        row[1:] = np.maximum(row[1:], np.where(w > 0, above[:-1] + w, 0))
        row = np.maximum.accumulate(row)
        left.append(np.packbits(row[1:] == row[:-1]))
        up.append(np.packbits(row[1:] == above[1:]))
        above = row
    pairs, j = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        while j and left[i][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1:
            j -= 1
        if not j:
            break
        if not up[i][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1:
            j -= 1
            pairs.append((i, j))
    return int(above[-1]), pairs[::-1]


def weight(a: Tree, b: Tree) -> int:
    """Nodes of the largest matching of two trees that keeps order and parents: simple tree matching."""
    if a.shape == b.shape:
        return a.size
    if a.label != b.label:
        return 0
    found = _weights.get((a.shape, b.shape))
    if found is None:
        front, back = _ends(a.kids, b.kids)
        rest_a, rest_b = a.kids[front : len(a.kids) - back], b.kids[front : len(b.kids) - back]
        found = 1 + sum(k.size for k in a.kids[:front]) + sum(k.size for k in a.kids[len(a.kids) - back :])
        if rest_a and rest_b:
            found += _table(rest_a, rest_b)[0]
        if len(_weights) > _KEPT:
            _weights.clear()
        _weights[a.shape, b.shape] = found
    return found


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """The pairs of leaves that a largest matching pairs."""
    out: list = []
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        a, b = todo.pop()
        if a.shape == b.shape:
            out.extend(zip(range(a.low, a.high), range(b.low, b.high)))
            continue
        front, back = _ends(a.kids, b.kids)
        todo.extend(zip(a.kids[:front], b.kids[:front]))
        if back:
            todo.extend(zip(a.kids[-back:], b.kids[-back:]))
        rest_a, rest_b = a.kids[front : len(a.kids) - back], b.kids[front : len(b.kids) - back]
        if rest_a and rest_b:
            todo.extend((rest_a[i], rest_b[j]) for i, j in _table(rest_a, rest_b)[1])
    return out
