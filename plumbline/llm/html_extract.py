"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Paragraph-like blocks give points for length and commas to their
parent, grandparent and further ancestors in falling shares; a container's points are discounted by
the share of its text inside links. The best container is kept with its siblings, whatever their
length, but for those that are mostly links and, next to an article or at the top of the page, those
that nothing marks as its text; the text is read block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video noembed noframes xmp plaintext".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option datalist fieldset legend dialog menu input label map area".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "button", "option", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "iframe", "select"}
#: An opening tag ends the open element of these kinds, up to the barrier.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements that an end tag inside does not close from within (``</b>`` stays inside its paragraph).
BARRIER = frozenset("article section div main body html table td th tr ul ol li nav header footer aside form blockquote".split())
#: Elements of readers and of other pages' texts: they hold articles and paragraphs of their own.
FOREIGN = frozenset("comment comments commentlist disqus reply replies respond related recommend recommended recommendation recommendations".split())
#: Columns and boxes that list other articles.
LISTING = FOREIGN | frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsors sponsored promo promos promotion promotions promoted sidebar sidebars widget widgets".split())
#: Whole parts of class and id names.
UNWANTED = LISTING | frozenset(
    "banner banners menu menus nav navs navbar navigation breadcrumb breadcrumbs foot footer footers header headers headingbar masthead cookie cookies consent gdpr notice notices alert alerts"
    " notification notifications newsletter newsletters subscribe subscription subscriptions signup login share shares sharing sharebar social socials popup popups modal modals overlay overlays"
    " toolbar toolbars pagination pager tags tagcloud copyright disclaimer legal skip skiplink skiplinks feedback form forms".split()
)
#: Class names, whole, of what is not shown; parts of names (``overflow-hidden``) say other things.
UNSEEN = frozenset("hidden invisible d-none visually-hidden is-hidden sr-only screen-reader-text".split())
#: What follows in the name says how the page is laid out (``has-sidebar``), not what the element is.
LAYOUT = frozenset("has no with without".split())
PART = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
UNWANTED_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: Attributes as browsers read them: quotes count after an equals sign only, and one that is never closed is part of the value.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A slash that closes its own element, and not one that ends an unquoted value.
CLOSES_ITSELF = re.compile(r"(?:^|[\s\"'])/\s*$")
#: A paragraph shorter than this gives no points.
MIN_POINTS_CHARS = 20


class Node:
    __slots__ = ("attrs", "items", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.items: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = 0

    def unwanted(self, by_name: bool = True) -> tuple[bool, frozenset[str] | None]:
        """Whether to leave it out, and if that is only by its name, role or form, the parts that say so."""
        if self.tag in ("form", "fieldset"):
            return True, frozenset({"form"})
        if self.tag in DROPPED:
            return True, None
        if not self.attrs or self.tag in ("html", "body", "article", "main"):
            return False, None
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)}
        classes = found.get("class", "").lower().split()
        if "hidden" in found or not UNSEEN.isdisjoint(classes) or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return True, None
        parts = unwanted_parts(found.get("class", "")) | unwanted_parts(found.get("id", "")) if by_name else frozenset()
        if found.get("role", "").lower() in UNWANTED_ROLE:
            return True, parts
        return bool(parts), parts


#: The end of a sentence: a mark after a word, not after a sign or a number alone.
SENTENCE = re.compile(r"\w{2}[\"'”’)\]]*[.!?…。！？]")


def unwanted_parts(names: str) -> frozenset[str]:
    out = set()
    for name in names.split():
        before = ""
        for part in PART.split(name):
            part = part.lower().rstrip("0123456789")
            if part in LAYOUT:
                break
            out |= UNWANTED & {part, before + part}
            before = part
    return frozenset(out)


def parse(html: str) -> Node:
    """A tree of elements and texts; end tags without a start are ignored, what stays open ends with the page."""
    root = here = Node("html", None)
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            here.items.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.items.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            own = bool(CLOSES_ITSELF.search(m[3]))
            if tag in RAW and not own:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if tag != "svg" or close:
                    at = close.end() if close else end
                continue
            if tag in CLOSES_P:
                here = _close(here, frozenset({"p"}), BARRIER)
            if tag in IMPLIED:
                here = _close(here, *IMPLIED[tag])
            node = Node(tag, here, m[3])
            here.items.append(node)
            if tag not in VOID and not own:
                here = node
        elif m[1]:
            tag = m[1].lower()
            here = _close(here, frozenset({tag}), frozenset() if tag in BARRIER else BARRIER)
    return root


def _close(here: Node, tags: frozenset[str], barrier: frozenset[str]) -> Node:
    x = here
    while x is not None and x.parent is not None:
        if x.tag in tags:
            return x.parent
        if x.tag in barrier:
            return here
        x = x.parent
    return here


def _prose(root: Node, marks: dict[int, tuple[bool, frozenset[str] | None]]) -> dict[int, tuple[int, bool, bool]]:
    """For each element: characters of paragraphs outside links, and whether it holds a main or an article with such text.

    What is left out for sure and what readers wrote does not count for the elements around it.
    """
    order, todo = [], [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside |= x.tag in PARAGRAPH or x.tag == "div" and not any(isinstance(i, Node) and i.tag in BLOCK for i in x.items)
        order.append((x, inside))
        todo += [(i, inside) for i in x.items if isinstance(i, Node) and i.tag != "a"]
    found: dict[int, tuple[int, bool, bool]] = {}
    for x, inside in reversed(order):
        chars, main, article = sum(len(i.strip()) for i in x.items if isinstance(i, str)) if inside else 0, False, False
        for i in x.items:
            if isinstance(i, Node) and i.tag != "a":
                out, parts = marks[id(i)]
                c, m, a = found[id(i)]
                if not out or parts is not None and not parts & FOREIGN:
                    chars, main, article = chars + c, main or m or i.tag == "main" and c > 0, article or a or i.tag == "article" and c > 0
        found[id(x)] = chars, main, article
    return found


def _prune(root: Node, by_name: bool = True) -> list[Node]:
    """Takes unwanted elements out; returns what stays, parents before children.

    An element that is unwanted by name, role or form stays if it holds a main, an article or most of
    the page's paragraph text: then the name says something else.
    """
    marks, todo = {}, [root]
    while todo:
        x = todo.pop()
        marks[id(x)] = x.unwanted(by_name)
        todo += [i for i in x.items if isinstance(i, Node)]
    prose = _prose(root, marks) if any(parts is not None and out for out, parts in marks.values()) else {}

    def stays(x: Node) -> bool:
        out, parts = marks[id(x)]
        if not out:
            return True
        if parts is None or id(x) not in prose:
            return False
        chars, main, article = prose[id(x)]
        return main or article and not parts & LISTING or 2 * chars > prose[id(root)][0] and not parts & FOREIGN

    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        x.items = [i for i in x.items if isinstance(i, str) or stays(i)]
        todo += [i for i in reversed(x.items) if not isinstance(i, str)]
    return order


def _score(order: list[Node]) -> None:
    commas = {id(x): 0 for x in order}
    for x in reversed(order):
        for i in x.items:
            if isinstance(i, str):
                x.size += len(i.strip())
                commas[id(x)] += i.count(",") + i.count("،") + i.count("、")
            else:
                x.size += i.size
                x.links += i.size if i.tag == "a" else i.links
                commas[id(x)] += commas[id(i)]
    for x in order:
        inline = x.tag == "div" and not any(isinstance(i, Node) and i.tag in BLOCK for i in x.items)
        if (x.tag in PARAGRAPH or inline) and x.size >= MIN_POINTS_CHARS:
            points = (1 + commas[id(x)] + min(x.size / 100, 3)) * (1 - x.links / x.size)
            up, depth = x.parent, 0
            while up is not None and depth < 4:
                up.points += points / (1, 2, 6, 9)[depth]
                up, depth = up.parent, depth + 1
    for x in order:
        x.points += {"article": 10, "main": 10, "section": 2, "div": 2, "ul": -3, "ol": -3, "table": -2}.get(x.tag, 0) * (x.points > 0)
        x.points *= 1 - x.links / x.size if x.size else 0


def _blocks(nodes: list[Node | str]) -> str:
    """Text of the nodes in page order: blocks apart, white space inside a block as one space."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        edge = " " if x.tag in BLOCK else ""
        out.append(edge)
        todo.append(edge)
        todo += reversed(x.items)
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """The article of one page; empty for null, empty and text-free pages."""
    if not html:
        return ""
    return _main_text(html) or _main_text(html, by_name=False)


def _main_text(html: str, by_name: bool = True) -> str:
    order = _prune(root := parse(html), by_name)
    _score(order)
    articles = [x for x in order if x.tag in ("article", "main") and x.size]
    best = max(articles or order, key=lambda x: x.points)  # the first of equals
    if not best.size:
        return ""
    if best.points <= 0:
        return _blocks([best if articles else root])
    up = best.parent
    if up is None:
        return _blocks([best])
    if best.tag in ("article", "main"):  # the page says where its text is
        least = max(10, best.points * 0.2)
        prose = lambda x: x.tag == "p" and x.size and (x.size >= 80 and x.links < 0.25 * x.size or not x.links and x.size >= MIN_POINTS_CHARS)
        title = lambda x: x.tag in ("h1", "h2") and x.size and not x.links
        return _blocks([x for x in up.items if not isinstance(x, str) and (x is best or x.points >= least or prose(x) or title(x))])
    texts = any(isinstance(x, str) and x.strip() for x in up.items)
    while up.parent is not None:  # parts of one text stand in containers of one kind
        alike = [x for x in up.parent.items if isinstance(x, Node) and x is not up and (x.tag, x.attrs) == (up.tag, up.attrs) and x.points > 0 and 2 * x.links < x.size]
        if up.tag in ("html", "body") or not alike:
            break
        return _blocks([i for x in up.parent.items if x is up or x in alike for i in x.items if _belongs(i, best, x, texts)])
    return _blocks([x for x in up.items if _belongs(x, best, up, texts)])


def _belongs(x: Node | str, best: Node, up: Node, texts: bool) -> bool:
    """Whether a sibling of the best container is text like it: all but link lists and, at the top of a page, regions without a heading or a sentence."""
    if isinstance(x, str) or x is best:
        return True
    if x.tag not in BLOCK and texts or x.tag in ("br", "hr"):
        return True  # part of a line
    if not x.size or 2 * x.links >= x.size:
        return False
    if up.tag not in ("html", "body") or x.tag not in ("div", "section", "center", "span"):
        return True
    todo = [x]
    while todo:
        y = todo.pop()
        if y.tag in ("h1", "h2", "h3") and y.size and not y.links:
            return True
        if (y.tag in PARAGRAPH or not any(isinstance(i, Node) and i.tag in BLOCK for i in y.items)) and SENTENCE.search(_blocks([y])):
            return True
        todo += [i for i in y.items if isinstance(i, Node)]
    return False


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars`` (code points).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
    are left out; nothing else is dropped or capped. Null, empty and text-free pages give an empty
    text; a page whose whole text has unwanted names is read without regard to names. Rows that repeat an id give a row each; null ids and urls are kept. Extra columns are not
    read; an empty table gives no rows. Nothing is shuffled.
    """
    ship(pages.sparkSession)
    types = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
