"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of block-level tags from the root to the leaf. All blocks of one path are one
group: its text ratio is characters per block and its punctuation ratio is marks per block. Both series are smoothed over neighbouring
blocks (the more of their paths two neighbours share, the more they weigh for each other) and multiplied. Elements that say of themselves
that they are something else (menus, page headers, footers, side bars, notices, adverts, forms, comments: by tag, role, class or id) lower
the fused ratio of what is in them; as everything is compared within its page, a label on a wrapper of the whole page changes nothing.
A path is content if its mean ratio passes a share of the spread of the page's ratios and a small absolute value.

All blocks of content paths are returned. So that a heading or a short list stays with its article, blocks of the deepest element that
holds most of the content are returned with it, unless something inside that element sets them apart; if that is only the body, just the
headings before content and what stands between content.

Defined cases: null or empty html, and pages without content, give an empty text; open tags, unclosed paragraphs and cut-off references
are read as browsers read them, as far as text is concerned; elements that aren't shown (hidden, aria-hidden, display:none) are not read;
repeated rows get equal results; a page of any length and depth is read whole, in time that grows with its length; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*+)>", re.S)
_NAMED = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_MARK = re.compile(r"[.,;:!?…。，、！？؟।]")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What a start tag closes: the open elements, up to the elements that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What says that it isn't the article: by tag, by role, and (of elements that only group others) by a word of the class or the whole id.
ASIDE_TAGS = frozenset("nav footer aside head button select option dialog menu fieldset label datalist audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments disqus replies reply respond related recommended recommendations widget widgets toolbar copyright disclaimer".split()
)
GROUPING = frozenset("div section ul ol dl table form header center span p".split())
#: Factors of the ratio under such an element, by how it says so; least ratio of content.
BY_TAG, BY_LABEL, LEAST_RATIO = 0.00001, 0.002, 1.5


class Element:
    """An open or closed element: its place in the tree, its path of block-level tags (a number) and what it says of itself."""

    __slots__ = ("depth", "factor", "hidden", "parent", "path", "serial", "set_apart", "tag")

    def __init__(self, tag: str, parent: Element | None, serial: int, path: int, depth: int):
        self.tag, self.parent, self.serial, self.path, self.depth = tag, parent, serial, path, depth
        self.factor, self.hidden, self.set_apart = (parent.factor, parent.hidden, False) if parent else (1.0, False, False)


class Block:
    __slots__ = ("element", "parts", "shared", "text")

    def __init__(self, element: Element, shared: int):
        self.element, self.shared, self.parts, self.text = element, shared, [], ""


def says(tag: str, attributes: str, inside_article: bool) -> tuple[float, bool]:
    """Factor of an element, and whether it isn't shown."""
    factor, hidden = BY_TAG if tag in ASIDE_TAGS else BY_LABEL if tag == "form" or tag == "header" and not inside_article else 1.0, False
    for name, *values in _NAMED.findall(attributes) if attributes else ():
        name, value = name.lower(), next((v for v in values if v), "").strip()
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            hidden = True
        elif name == "role" and value.lower() in ASIDE_ROLES:
            factor = min(factor, BY_LABEL)
        elif name == "id" and tag in GROUPING and value.lower() in ASIDE_WORDS or name == "class" and tag in GROUPING and any(w.lower() in ASIDE_WORDS for w in _NAME.findall(value)):
            factor = min(factor, BY_LABEL)
    return factor, hidden


class Page:
    """The elements of a page, and its blocks with text in page order. Every step costs the same at any depth."""

    def __init__(self, page: str):
        root = Element("", None, 0, 0, 0)
        self.elements, self.blocks, self.stack = [root], [], [root]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.paths: dict[tuple[int, str], int] = {}
        self.block: Block | None = None
        self.shared = 0  # depth of the path that has stayed open since the last block
        self._read(page)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        kept, shared = [], 1 << 30
        for b in self.blocks:
            shared = min(shared, b.shared)
            if b.text:
                b.shared, shared = shared, 1 << 30
                kept.append(b)
        self.blocks = kept

    def _put(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.hidden:
            if self.block is None:
                self.block = Block(top, min(self.shared, top.depth))
                self.blocks.append(self.block)
                self.shared = top.depth
            self.block.parts.append(html.unescape(text))

    def _cut(self, place: int) -> None:
        """Close the elements from this place of the stack on."""
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.open[gone.tag].pop()
        self.shared = min(self.shared, self.stack[-1].depth)

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.block = None
            if tag in ENDS_PARAGRAPH and self.open.get("p"):
                self._cut(self.open["p"][-1])
            if tag in CLOSES:
                ended, stops = CLOSES[tag]
                while (at := self._last(ended)) > self._last(stops):
                    self._cut(at)
        parent = self.stack[-1]
        path, depth = parent.path, parent.depth
        if tag not in INLINE:
            path, depth = self.paths.setdefault((path, tag), len(self.paths) + 1), depth + 1
        element = Element(tag, parent, len(self.elements), path, depth)
        factor, hidden = says(tag, attributes, bool(self.open.get("article") or self.open.get("main")))
        element.set_apart = factor < 1
        element.factor, element.hidden = min(element.factor, factor), element.hidden or hidden
        self.elements.append(element)
        self.open[tag].append(len(self.stack))
        self.stack.append(element)

    def _read(self, page: str) -> None:
        at = 0
        while (m := _TOKEN.search(page, at)) is not None:
            self._put(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    self.block = None
                if self.open.get(tag):
                    self._cut(self.open[tag][-1])
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
            elif tag == "hr":
                self.block = None
            elif tag in VOID:
                self._put(" ")
            else:
                self._start(tag, m[3] or "")
        self._put(page[at:])


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Characters per block and marks per block of the path of every block."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        key = b.element.path, b.element.factor
        count[key] += 1
        chars[key] += len(b.text)
        marks[key] += len(_MARK.findall(b.text))
    return np.array([(chars[k] / count[k], marks[k] / count[k]) for k in ((b.element.path, b.element.factor) for b in blocks)]).reshape(-1, 2)


def fused_ratios(blocks: list[Block]) -> np.ndarray:
    """The smoothed ratios of every block, multiplied, under the factor of its element (against the page's greatest: a label on everything says nothing)."""
    ratios = path_ratios(blocks)
    smooth, weight = ratios.copy(), np.ones(len(blocks))
    depth = np.array([b.element.depth for b in blocks])
    shared = np.array([b.shared for b in blocks])
    for d, gauss in ((1, 0.6), (2, 0.15)):
        if len(blocks) <= d:
            break
        common = shared[1:] if d == 1 else np.minimum(shared[1:-1], shared[2:])
        w = gauss * (np.minimum(common, np.minimum(depth[d:], depth[:-d])) / np.maximum(np.maximum(depth[d:], depth[:-d]), 1)) ** 2
        smooth[d:] += w[:, None] * ratios[:-d]
        smooth[:-d] += w[:, None] * ratios[d:]
        weight[d:] += w
        weight[:-d] += w
    smooth /= weight[:, None]
    factor = np.array([b.element.factor for b in blocks])
    return smooth[:, 0] * (smooth[:, 1] + 0.05) * factor / max(factor.max(), BY_LABEL)


def content_mask(blocks: list[Block], spread: float = 0.2) -> np.ndarray:
    """Which blocks have a path whose mean fused ratio passes."""
    if not blocks:
        return np.zeros(0, bool)
    fused = fused_ratios(blocks)
    _, group = np.unique([(b.element.path, b.element.factor) for b in blocks], axis=0, return_inverse=True)
    group = group.ravel()
    mean = np.bincount(group, fused) / np.bincount(group)
    limit = max(LEAST_RATIO, min(spread * float(fused.std()), float(mean.max())))
    return (mean >= limit)[group]


def main_text(page: str | None, cover: float = 0.7) -> str:
    """The article of a page."""
    if not page:
        return ""
    read = Page(page)
    blocks, elements = read.blocks, read.elements
    content = content_mask(blocks)
    if not content.any():
        return ""
    size = np.zeros(len(elements))
    for b, good in zip(blocks, content, strict=True):
        size[b.element.serial] += len(b.text) * bool(good)
    total = size.sum()
    for e in reversed(elements[1:]):  # children come after their parents
        size[e.parent.serial] += size[e.serial]
    holders = [e for e in elements if size[e.serial] >= cover * total and e.tag not in INLINE and e.tag not in HEADINGS and e.tag not in ("p", "li")]
    holder = max(holders, key=lambda e: (e.depth, -e.serial))
    with_it = np.zeros(len(elements), bool)
    for e in elements:
        with_it[e.serial] = e is holder or e.parent is not None and with_it[e.parent.serial] and not e.set_apart
    inside = np.array([with_it[b.element.serial] for b in blocks])
    if holder.tag in ("", "html", "body"):
        at = np.flatnonzero(content)
        between = np.zeros(len(blocks), bool)
        between[at[0] : at[-1] + 1] = True
        first = at[0]
        while first and _heading(blocks[first - 1].element):
            first -= 1
            between[first] = True
        inside &= between
    return "\n\n".join(b.text for b, good in zip(blocks, content | inside, strict=True) if good)


def _heading(e: Element | None) -> bool:
    while e is not None and e.tag in INLINE:
        e = e.parent
    return e is not None and e.tag in HEADINGS


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def articles(batch):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return texts, [len(t) for t in texts]

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return beside(rows, ["page_id", "url"], {"text": "string", "n_chars": "long"}, articles)
