"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser feeds blocks (lines) with their text, their tags and the elements around them; blocks
inside menus, headers, footers, asides, forms, scripts, adverts, notices and reader comments are never content. Names
(class, id) count as whole names, and not where the named element holds more text than all the rest.
Each remaining line's text-to-tag ratio is smoothed by a Gaussian; lines above the threshold between the two clusters
of ratios are content, and select the region by their text: the smallest article or main element that holds more than half of it,
the container of several articles that share it, else the smallest container that holds four fifths (a page without such elements gives
the same text if its containers are the same). All blocks of the region are kept in page order, short ones too.

White space inside a block becomes one space, ``<br>`` counts as white space; blocks are joined by a line feed. Null or
empty pages, and pages without content, give the empty text. Unclosed and stray tags are tolerated. Every row is a page of its own:
repeated rows give repeated results, null ids stay null, other columns are left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside button select textarea iframe object svg canvas math"
    " audio video dialog menu map".split()
)
_CONTAINERS = frozenset(("article", "body", "center", "div", "html", "main", "section", "td", ""))
_ENDS_P = BLOCKS - {"body", "html"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Words in a class or id that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification"
    " overlay pager pagination popup promo promoted promotion recommended related respond share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription teaser toolbar tracking widget widgets".split()
)
_HEADS = frozenset("header topbar top".split())
#: Words that may stand beside a mark in one class name; any other word makes it a name of its own (``no-sidebar``).
_BESIDE = frozenset("area bar block bottom box container global inner left list main outer page panel right section site wrap wrapper".split())
#: Marks that also hold for articles inside: an article in a comment section is a comment.
_REPLIES = frozenset("comment comments commentlist disqus respond reply replies".split())
_TEASERS = _REPLIES | frozenset("ad ads advert advertisement sponsored sponsor teaser related recommended promo".split())
#: How an element is left out: not at all, by a name (an article inside still counts), or with all it holds.
IN, NAMED, OUT = 0, 1, 2
SIGMA = 1.0
#: An article with this part of the heaviest one's content is a part of the story too.
PART = 4
#: A plain container is the region if it holds this share of the content, article and main elements if they hold half.
MOST = 0.8


def _marked(value: str, marks: frozenset, beside: frozenset = _BESIDE) -> bool:
    """Does a whole class name (or id) say no more than a mark?"""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name) if not w.isdigit()}
        if words & marks and words <= marks | beside:
            return True
    return False


class _Node:
    __slots__ = ("tag", "parent", "out", "depth", "is_region", "order", "inside", "within_article", "outermost", "weight", "held")

    def __init__(self, tag, parent, out, is_region=False, order=-1):
        self.tag, self.parent, self.out, self.is_region, self.order = tag, parent, out, is_region, order
        self.depth = parent.depth + 1 if parent else 0
        self.weight = self.held = 0
        #: Is it in (or is it) an article or main element; is it in an article; the outermost element left out by name around it.
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.within_article = parent is not None and (parent.tag == "article" or parent.within_article)
        self.outermost = (parent.outermost if parent and parent.out == NAMED else order) if out == NAMED else None


class _Lines(HTMLParser):
    """Collects lines: [text parts, tags, link characters, node]; elements ``unnamed`` (by order) are not left out by name."""

    def __init__(self, names: bool = True, unnamed: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.names, self.unnamed = names, unnamed
        self.order = 0
        #: Characters outside links that each outermost named element leaves out, and those that stay.
        self.left_out: dict[int, int] = {}
        self.stays = 0
        self.node = _Node("", None, IN)
        #: All elements, parents first.
        self.nodes: list[_Node] = [self.node]
        self.lines: list[list] = []
        self.line = None
        self.links = 0

    def _new_line(self):
        self.line = None

    def _tag(self):
        if self.line is not None:
            self.line[1] += 1

    def _outside(self, tag: str, attrs) -> int:
        within = self.node.out
        if within == OUT or tag in NEVER:
            return OUT
        inside = self.node.inside
        if tag == "header" and not inside:
            return OUT
        named = within if tag not in ("article", "main") else IN
        if tag == "form" and self.order not in self.unnamed:
            named = NAMED
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return OUT
            if name == "role" and value.strip().lower() in _ROLES:
                return OUT
            if name in ("class", "id") and self.names and tag not in ("html", "body", "main"):
                if tag == "article":
                    if _marked(value, _TEASERS):
                        return OUT
                elif _marked(value, _REPLIES):
                    return OUT
                elif self.order not in self.unnamed and (_marked(value, _MARKS) or (not inside and tag in ("div", "section", "table", "ul") and _marked(value, _HEADS, _BESIDE - {"page"}))):
                    named = NAMED
        return named

    def _close_to(self, names, stop=()):
        at = self.node
        while at.parent and at.tag not in stop:
            if at.tag in names:
                self.node = at.parent
                return True
            at = at.parent
        return False

    def handle_starttag(self, tag, attrs):
        self._tag()
        if tag in VOID:
            if tag == "hr":
                self._close_to({"p"}, BLOCKS - {"p"})
                self._new_line()
            elif tag == "br":
                self.handle_data(" ")
            return
        if tag in _ENDS_P:
            self._close_to({"p"}, BLOCKS - {"p"})
        if tag in _SIBLINGS:
            self._close_to(*_SIBLINGS[tag])
        if tag in BLOCKS:
            self._new_line()
        role = dict(attrs).get("role") if attrs else None
        self.node = _Node(tag, self.node, self._outside(tag, attrs), tag in ("article", "main") or role in ("main", "article"), self.order)
        self.nodes.append(self.node)
        self.order += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "article", "section", "main", "body"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tag()
        if tag == "br":
            self.handle_data(" ")
            return
        stop = {"table", "article", "main", "body"} - {tag} if tag not in BLOCKS else {"body"} - {tag} if tag not in ("html", "body") else ()
        self._close_to({tag}, stop)
        if tag in BLOCKS:
            self._new_line()
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data):
        if self.node.out:
            if self.node.out == NAMED and not self.links:
                top = self.node.outermost
                self.left_out[top] = self.left_out.get(top, 0) + len(data.strip())
            return
        self.stays += len(data.strip()) if not self.links else 0
        if self.line is None:
            if not data.strip():
                return
            self.line = [[], 1, 0, self.node]
            self.lines.append(self.line)
        self.line[0].append(data)
        if self.links:
            self.line[2] += len(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; ends are extended."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def content_threshold(values: np.ndarray, rounds: int = 30) -> float:
    """The middle between two clusters of line ratios (one-dimensional 2-means)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        cut = (low + high) / 2
        above, below = values[values > cut], values[values <= cut]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _region(lines, content, nodes: list[_Node]) -> _Node | None:
    """The element to keep: chosen by the content clusters' text, of which article and main elements need less."""
    for (text, _, links, node), good in zip(lines, content, strict=True):
        node.weight += max(len(text) - links, 0) if good else 0
    for n in reversed(nodes[1:]):  # what an element holds is known before its parent is reached
        n.parent.weight += n.weight
    total = nodes[0].weight
    if not total:
        return None
    weight = {n: n.weight for n in nodes if n.weight and (n.is_region or n.tag in _CONTAINERS)}
    articles = {n: w for n, w in weight.items() if n.tag == "article" and not n.within_article}  # an article inside another is a part of it
    named = [n for n, w in weight.items() if n.is_region and 2 * w > total and (n.tag != "article" or n in articles)]
    chosen = max(named, key=lambda n: n.depth, default=None)
    if chosen is None or chosen in articles:
        parts = [n for n, w in articles.items() if PART * w >= max(articles.values())]
        if len(parts) > 1 and 2 * sum(articles[n] for n in parts) > total:
            for n in parts:
                n.parent.held += articles[n]
            for n in reversed(nodes[1:]):
                n.parent.held += n.held
            return max((n for n in weight if n.held == nodes[0].held), key=lambda n: n.depth)
    return chosen or max((n for n, w in weight.items() if w >= MOST * total), key=lambda n: n.depth)


def _parsed(html: str, names: bool, unnamed: frozenset = frozenset()) -> _Lines:
    try:
        parser = _Lines(names, unnamed)
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section that the parser does not know
        parser = _Lines(names, unnamed)
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    return parser


def _lines(html: str, names: bool) -> tuple[list[tuple], list[_Node]]:
    """(text, tags, link characters, element) of every line, and all elements; without ``names`` only tags and roles leave elements out.

    An element that holds more text than all that is left is not what its name says, so its name is not heeded.
    """
    parser, unnamed = _parsed(html, names), frozenset()
    while parser.left_out and max(parser.left_out.values()) > parser.stays:
        unnamed |= {k for k, n in parser.left_out.items() if n > parser.stays}
        parser = _parsed(html, names, unnamed)
    return [(text, tags, links, node) for parts, tags, links, node in parser.lines if (text := " ".join("".join(parts).split()))], parser.nodes


def main_text(html: str | None) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    lines, nodes = _lines(html, True)
    if not lines:
        lines, nodes = _lines(html, False)
    if not lines:
        return ""
    ratio = np.array([max(len(text) - links, 0) / tags for text, tags, links, _ in lines], float)
    even = np.round(smoothed(ratio), 9)  # equal lines stay equal
    content = even >= content_threshold(even)
    region = _region(lines, content, nodes)
    if region is None:
        return ""
    kept = {region}
    for n in nodes:  # parents come first
        if n.parent in kept:
            kept.add(n)
    return "\n".join(text for text, _, _, node in lines if node in kept)


def extracted_text(html: str = "html") -> Column:
    """``main_text`` of a column of pages."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return extract(F.col(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return pages.select("page_id", "url", extracted_text("html").alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
