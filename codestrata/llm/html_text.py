"""Main text of web pages.

Method: composite text density.  The page is parsed into a DOM; every node gets its characters and
tags, adjusted for the characters and tags inside links; a node's density sum is the sum over its
children.  The subtree with the largest density sum is taken.  The smallest density on the path from
it to the body is the threshold: further subtrees are taken that reach it in density and, unless they
are text blocks, in density sum too, which an advert or notice of one block does not; headings and
unlinked text blocks of the same article element may be short and need not reach it; blocks of links in the taken subtrees that stay under it are menus and go.

Elements and names (class, id, role) that mark boilerplate only lower densities: what lies inside
counts as linked text, so it is never chosen, and is left out where it lies inside a chosen
subtree.  A mark is ignored on a node that holds the page's article, or most of its text; that of readers'
comments, which may be most of a page, only where all articles are inside or nothing else is there to read.

Defined results: null or empty html, and a page without text outside boilerplate, give the empty
text; unclosed and stray tags are tolerated; nothing is capped, deep nesting included (no recursion);
repeated rows, very long pages and empty tables are pages like any other.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import release_tokens, small_batches

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no text to read.
_DROP = frozenset("script style noscript template head title button select option textarea input label iframe object embed svg canvas audio video map xmp noembed noframes".split())
#: Elements that are boilerplate unless they hold the article.
_MARKED = frozenset("nav footer aside form dialog menu".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = frozenset("p pre blockquote ul ol dl table figure figcaption".split())
#: Words that mark boilerplate where a class, id or role consists of them, besides words of place or form.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion adsense adslot "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs toolbar pagination pager topbar masthead "
    "header siteheader pageheader footer sitefooter pagefooter colophon sidebar sidebars aside rail widget widgets complementary contentinfo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations popular trending search searchbox form copyright legal disclaimer skip".split()
)
_READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
_PLACES = frozenset(
    "site page main global top bottom left right primary secondary inner outer first last user reader readers article post entry the my "
    "box block container wrap wrapper slot unit list area section content body bar row column col group item items link links title heading panel text area zone".split()
)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of the page's unlinked text with which a marked node is no boilerplate.  Readers' comments may be longer than the
#: article, so of them no share tells.
MOST, READERS = 0.5, 2.0


class Node:
    """An element; ``bad`` is 0, ``READERS``, or the share of the page's text from which its mark is ignored."""

    __slots__ = ("tag", "parent", "children", "bad", "link", "chars", "tags", "link_chars", "link_tags", "plain", "held", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, bad: float = 0.0):
        self.tag, self.parent, self.bad = tag, parent, bad
        self.children: list[Node | str] = []


def _marked(name: str, inside: bool) -> float:
    """For one class name, id or role: 0, ``READERS``, or the share of text from which its mark is ignored."""
    words = set(_WORD.findall(_CAMEL.sub(" ", name).lower())) - _PLACES
    if inside:
        words.discard("header")  # an article's own header holds its title
    if not words or not words <= _BAD | _READERS:
        return 0.0
    return READERS if words & _READERS else MOST


def _boilerplate(tag: str, attrs: str, parent: Node) -> float:
    above = parent
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if tag in _MARKED or tag == "header" and above is None:
        return MOST
    if not attrs:
        return 0.0
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return MOST
        if name in ("class", "id", "role") and (share := max((_marked(x, above is not None) for x in value.split()), default=0.0)):
            return share
    return 0.0


def parse(page: str) -> Node:
    """The DOM of a page below a root node; elements without text to read are left out, boilerplate is marked."""
    root = Node("#root", None)
    cur, at = root, 0
    lower = None
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and cur.tag not in _DROP:
            cur.children.append(text)
        if not m:
            return root
        at = m.end()
        close, tag, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            if m.group().startswith("<![CDATA[") and cur.tag not in _DROP:
                cur.children.append(_html.escape(m.group()[9:-3]))
            continue
        if close:
            node = cur
            while node is not root and node.tag != tag:
                if tag not in _BLOCK and node.tag in _BLOCK or node.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "section", "div"):
                    node = root  # an inline or nested end tag doesn't close blocks around it
                    break
                node = node.parent
            if node is not root:
                cur = node.parent
            continue
        if tag in _ENDS_P:
            node = cur
            while node is not root and node.tag not in _BLOCK:
                node = node.parent
            if node.tag == "p":
                cur = node.parent
        if tag in _SAME:
            ends, stops = _SAME[tag]
            node = cur
            while node is not root and node.tag not in ends and node.tag not in stops and node.tag not in ("div", "table", "article", "section"):
                node = node.parent
            if node.tag in ends:
                cur = node.parent
                if tag == "tr" and cur.tag == "tr":
                    cur = cur.parent
        node = Node(tag, cur, _boilerplate(tag, attrs, cur))
        if tag not in _DROP:
            cur.children.append(node)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                at = len(page)
            else:
                stop = page.find(">", end)
                at = len(page) if stop < 0 else stop + 1
            continue
        cur = node


def _squeezed(text: str) -> int:
    return len("".join(text.split()))


def _measure(root: Node) -> list[Node]:
    """Characters, tags, densities and density sums; returns the nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.link = node.tag == "a" or node.parent is not None and node.parent.link
        todo += [x for x in reversed(node.children) if isinstance(x, Node)]
    for node in reversed(order):
        own = sum(_squeezed(_html.unescape(x)) for x in node.children if isinstance(x, str))
        kids = [x for x in node.children if isinstance(x, Node)]
        node.chars = own + sum(x.chars for x in kids)
        node.plain = (0 if node.link else own) + sum(x.plain for x in kids)
        # articles in it; one that is itself a comment is none
        node.held = (node.tag == "main" or node.tag == "article" and node.bad != READERS) + sum(x.held for x in kids)
    free, todo = root.plain, [root]
    while todo:  # unlinked text outside all marks
        node = todo.pop()
        if node.bad:
            free -= node.plain
        else:
            todo += [x for x in node.children if isinstance(x, Node)]
    for node in order:
        # a mark holds for all inside; the article, or a page without one in most of its text, is not boilerplate.
        # Comments are the page only if it has no article beside them, and no other text to read
        if node.bad == READERS and (node.held and node.held == root.held or not root.held and not free):
            node.bad = 0.0
        elif node.bad and node.bad != READERS and (node.held or not root.held and root.plain and node.plain >= node.bad * root.plain):
            node.bad = 0.0
        if node.parent is not None and node.parent.bad:
            node.bad = 1.0
    for node in reversed(order):
        kids = [x for x in node.children if isinstance(x, Node)]
        away = node.link or bool(node.bad)
        node.tags = sum(x.tags + 1 for x in kids)
        node.link_tags = sum(x.link_tags + (x.tag == "a" or bool(x.bad)) for x in kids)
        node.link_chars = node.chars if away else sum(x.link_chars for x in kids)
    body = next((n for n in order if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        kids = [x for x in node.children if isinstance(x, Node)]
        node.total = sum(x.density for x in kids)
        node.best = max([node, *(x.best for x in kids)], key=lambda x: x.total)
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters a tag times the logarithm of their surplus over links, to a base that grows with the links."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0), max(base, 1.0001))


def _chosen(root: Node) -> tuple[list[Node | str], float]:
    """The taken subtrees (and bare texts) in page order, and the threshold."""
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars:
        body = root
    top = body.best
    if top.bad or top.chars == top.link_chars and top.total == 0:  # no text that is not linked or marked
        top = body
    path, node = {top}, top
    threshold, frame = top.density, body
    while True:
        if node.tag in ("article", "main"):
            frame = node
        if node is body or node.parent is None:
            break
        node = node.parent
        path.add(node)
        threshold = min(threshold, node.density)
    found: list[Node | str] = []
    todo: list[tuple[Node | str, bool]] = [(body, frame is body)]
    while todo:
        node, inside = todo.pop()
        if isinstance(node, str):
            found.append(node)
            continue
        if node.bad:
            continue
        if node is top:
            found.append(node)
            continue
        if node not in path:
            own = inside and frame is not body
            kids = any(isinstance(x, Node) for x in node.children)
            prose = node.link_chars < 0.5 * node.chars
            dense = prose and node.density >= threshold
            if own and (node.tag in _HEADINGS or prose and node.tag in _LEAVES) or node.tag == "h1" or dense and (node.total >= threshold or node.tag in _LEAVES or own and not kids):
                found.append(node)
                continue
        within = inside or node is frame
        texts = within and frame is not body and node in path
        todo += [(x, within) for x in reversed(node.children) if isinstance(x, Node) or texts and x.strip()]
    return found, threshold


def _render(nodes: list[Node | str], threshold: float) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif not x.bad and not _menu(x, threshold):
                if x.tag in _BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return "\n".join(blocks)


def _menu(node: Node, threshold: float) -> bool:
    """A list of links under the threshold, outside an article: a menu whatever its name."""
    if node.tag not in ("ul", "ol", "dl") or node.density >= threshold or node.link_tags < 2 or node.link_chars < 0.9 * node.chars:
        return False
    above = node.parent
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    return above is None


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return _render(*_chosen(parse(page)))


def extract(df: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """Adds the main text of every whole page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_tokens()
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return small_batches(df).withColumn(into, text(F.col(html)))
