"""Main-text extraction: flat text blocks, neighbour features, a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block has its word
count and link density and those of the blocks before and after it, and what its
ancestors say of it. A CART tree, grown from the small labelled table below, keeps or
drops each block.

Defined results: null or blank html gives an empty text; unclosed and misnested tags are
closed much as browsers do; pages of any length and depth take time in proportion to their
length; every row gives one row, repeated rows included; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlog.llm.common import map_batches

# Names of HTML elements, and words that class names tell of page parts with.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("template svg object canvas audio video select datalist button annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li listing main menu nav ol optgroup option p plaintext pre search section summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
FURNITURE = frozenset("nav footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: Words that name a part of the page wherever they stand alone or with words of PLACES.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices popup modal overlay paywall newsletter subscribe subscription signup signin login register "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets related recommended recommendations trending "
    "share sharing social footer masthead topbar toolbar comment comments commentlist respond disqus pagination pager copyright disclaimer skip outbrain taboola".split()
)
#: Words that often name such parts and often do not.
DOUBTFUL_WORDS = frozenset("banner banners notification notifications alert alerts popular reply replies discussion search form header".split())
PLACES = frozenset(
    "a all and area at back bar bottom box button buttons by bx center col column container content ct desktop div element elements end first fixed for global head header heading holder icon icons id "
    "in inner inline item items js label last layout left link links list lists lg logo main md media mobile module more msg nav of off on our outer page pages panel pane para part parts placeholder post posts "
    "primary right role row secondary section sections side simple site slot sm small social sticky strip sub tab tabs text the thread title to top ul unit us user view with wrap wrapper wrappers xs you your zone".split()
)
MAIN_WORDS = frozenset("article post story entry content main body text prose articlebody".split())
#: Open elements that a start tag closes, and those that keep it from looking farther up.
PARAGRAPH_SCOPE = ("button", "object", "template", "table", "td", "th", "caption", "svg", "math", "canvas", "audio", "video", "select")
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
TABLE = frozenset("table thead tbody tfoot tr td th".split())
HIDDEN_SCOPE = tuple(sorted(HIDDEN))
CELL_SCOPE = (*HIDDEN_SCOPE, "td", "th")
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}
#: Tags that end drawings and formulas which were never closed.
OUT_OF_FOREIGN = frozenset("blockquote body center div dl dt dd h1 h2 h3 h4 h5 h6 hr li ol p pre table ul article section main nav footer header aside form".split())
FOREIGN, HTML_INSIDE = ("svg", "math"), ("foreignobject", "annotation-xml", "desc")

TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z][^>]*+>|<[!?/][^>]*+>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: ``furniture``: 2 if an element or a whole class name tells of a page part other than the
#: article, 1 if a doubtful word or part of a name does, 0 otherwise.
FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "furniture", "main", "heading", "main_elsewhere")

#: The labelled table: FEATURES of a block, then 1 if it belongs to the article. The last
#: rows are blocks below names that tell little: headings, paragraphs and lists of an article's
#: own sections, and boxes of links, search hints and short notices.
LABELLED = (
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 1, 0, 0, 1), (12, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 80, 0.0, 70, 0.0, 0, 1, 0, 0, 1),
    (3, 0.0, 3, 0.0, 2, 0.0, 0, 1, 0, 0, 1), (7, 0.0, 4, 1.0, 30, 0.0, 0, 1, 1, 0, 1), (25, 0.4, 20, 0.0, 0, 0.0, 0, 1, 0, 0, 1),
    (5, 1.0, 40, 0.0, 40, 0.0, 0, 1, 0, 0, 1), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0, 1), (150, 0.1, 9, 0.0, 6, 0.0, 0, 1, 0, 0, 1),
    (18, 0.0, 1, 1.0, 10, 0.0, 0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0, 1), (30, 0.05, 12, 1.0, 3, 0.0, 0, 1, 0, 0, 1),
    (3, 0.0, 40, 0.0, 2, 1.0, 0, 1, 0, 0, 1), (11, 0.0, 30, 0.0, 1, 1.0, 0, 1, 0, 0, 1), (17, 0.1, 2, 1.0, 3, 1.0, 0, 1, 0, 0, 1), (2, 0.0, 50, 0.0, 4, 0.8, 0, 1, 1, 0, 1),
    (1, 0.0, 10, 0.0, 2, 1.0, 0, 1, 1, 0, 1), (4, 0.0, 5, 0.0, 3, 1.0, 0, 1, 0, 0, 1), (8, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 1), (2, 0.0, 3, 0.5, 2, 1.0, 0, 1, 1, 0, 1),
    (40, 0.0, 35, 0.0, 50, 0.0, 2, 0, 0, 0, 0), (9, 0.0, 2, 1.0, 8, 0.0, 2, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0, 1, 0),
    (6, 0.5, 30, 0.0, 0, 0.0, 2, 0, 0, 0, 0), (60, 0.0, 60, 0.0, 60, 0.0, 2, 1, 0, 0, 0), (4, 1.0, 50, 0.0, 45, 0.0, 2, 1, 0, 0, 0),
    (15, 0.2, 40, 0.0, 20, 0.0, 2, 1, 1, 0, 0), (22, 0.0, 22, 0.0, 22, 0.0, 2, 0, 0, 0, 0), (120, 0.0, 5, 0.0, 5, 1.0, 2, 0, 0, 1, 0),
    (3, 0.0, 0, 0.0, 5, 1.0, 2, 0, 1, 1, 0), (80, 0.1, 70, 0.0, 20, 0.0, 2, 0, 0, 0, 0), (10, 0.0, 80, 0.0, 12, 0.0, 2, 1, 0, 0, 0),
    (50, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (30, 0.1, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (16, 0.0, 45, 0.0, 25, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 40, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 22, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 48, 0.0, 0, 0, 1, 0, 1),
    (5, 0.0, 3, 0.0, 20, 0.0, 0, 0, 1, 0, 1), (24, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 7, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 8, 0.0, 6, 0.0, 0, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (12, 0.9, 3, 1.0, 40, 0.0, 0, 0, 0, 0, 0),
    (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (20, 0.7, 20, 0.7, 20, 0.7, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 0), (4, 0.6, 35, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 3, 1.0, 4, 0.9, 0, 0, 1, 0, 0),
    (3, 1.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (4, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 0),
    (9, 0.0, 2, 1.0, 48, 0.0, 0, 0, 0, 1, 0), (50, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 1, 0), (6, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (4, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 1, 0), (30, 0.2, 3, 1.0, 2, 1.0, 0, 0, 0, 1, 0), (2, 1.0, 2, 1.0, 70, 0.0, 0, 0, 0, 1, 0),
    (1, 0.0, 60, 0.0, 40, 0.0, 1, 1, 1, 0, 1), (40, 0.0, 1, 0.0, 35, 0.0, 1, 1, 0, 0, 1), (3, 0.0, 50, 0.0, 45, 0.0, 1, 1, 1, 0, 1),
    (45, 0.1, 3, 0.0, 0, 0.0, 1, 1, 0, 0, 1), (12, 0.0, 45, 0.0, 20, 0.0, 1, 1, 0, 0, 1), (4, 0.0, 30, 0.0, 25, 0.0, 1, 1, 0, 0, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 1, 1, 0, 0, 0), (3, 1.0, 40, 0.0, 2, 1.0, 1, 1, 0, 0, 0), (5, 0.8, 30, 0.0, 40, 0.0, 1, 1, 0, 0, 0),
    (35, 0.0, 30, 0.0, 45, 0.0, 1, 0, 0, 0, 1), (3, 0.0, 40, 0.0, 35, 0.0, 1, 0, 1, 0, 1), (18, 0.0, 3, 0.0, 40, 0.0, 1, 0, 0, 0, 1),
    (4, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0, 0, 0), (6, 0.5, 2, 1.0, 8, 0.0, 1, 0, 0, 0, 0), (2, 1.0, 5, 0.0, 30, 0.0, 1, 0, 0, 0, 0),
    (8, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 1, 0), (25, 0.0, 10, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (1, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 1, 0),
)


class Node(NamedTuple):
    feature: int
    cut: float
    low: "Node | int"
    high: "Node | int"


def grow(rows: np.ndarray, labels: np.ndarray, depth: int) -> "Node | int":
    """CART on the Gini index; cuts lie midway between neighbouring values."""
    majority = int(labels.mean() >= 0.5)
    if depth == 0 or labels.min() == labels.max():
        return majority
    gini = lambda y: len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0
    best = (gini(labels) - 1e-9, -1, 0.0)
    for j in range(rows.shape[1]):
        values = np.unique(rows[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, j] <= cut
            best = min(best, (gini(labels[low]) + gini(labels[~low]), j, float(cut)))
    if best[1] < 0:
        return majority
    low = rows[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


@cache
def tree(depth: int = 7) -> "Node | int":
    data = np.array(LABELLED, dtype=float)
    return grow(data[:, :-1], data[:, -1], depth)


def decide(node: "Node | int", x: tuple) -> int:
    while isinstance(node, Node):
        node = node.low if x[node.feature] <= node.cut else node.high
    return node


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    furniture: int
    main: bool
    heading: bool


def named(value: str) -> int:
    """What the names in a class or id tell: FEATURES' furniture."""
    told = 0
    for name in value.split():
        parts = {p.lower() for p in NAME_PART.findall(name)}
        if parts & FURNITURE_WORDS:
            mixed = "sidebar" in parts and parts & MAIN_WORDS  # a frame around both
            told = max(told, 2 if parts <= FURNITURE_WORDS | DOUBTFUL_WORDS | PLACES and not mixed else 1)
        elif parts & DOUBTFUL_WORDS and not parts & MAIN_WORDS:
            told = max(told, 1)
    return told


def role_of(name: str, raw: str, inside_main: bool) -> tuple[int, bool, bool]:
    """(furniture, main, hidden) that an element's name and attributes tell of."""
    furniture, main, hidden = 2 * (name in FURNITURE or (name == "header" and not inside_main)), name in MAIN, name in HIDDEN
    if raw and "=" in raw or "hidden" in raw:
        for key, a, b, c in ATTRIBUTE.findall(raw):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                value = entities.unescape(value)
                parts = {p.lower() for p in NAME_PART.findall(value)}
                if name not in ("html", "body"):
                    told = 0 if name in MAIN else named(value)
                    if parts <= PLACES | {"header"} and "header" in parts and not parts & MAIN_WORDS:
                        told = 0 if inside_main else 2
                    furniture = max(furniture, told)
                    main |= bool(parts & MAIN_WORDS) and told < 2 and name in ("div", "section", "td")
            elif key == "role":
                furniture = max(furniture, 2 * (value.lower() in FURNITURE_ROLES))
                main |= value.lower() in MAIN
            elif key == "itemprop":
                main |= value.lower() == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return furniture, main, hidden


class Open(NamedTuple):
    """An open element, with what it has from those around it."""

    name: str
    furniture: int
    main: bool
    hidden: bool
    heading: bool


class Page:
    """Open elements and the flat text blocks found so far.

    The places of open elements are kept by name, so that a tag finds what it closes, and
    what keeps it from closing, without walking up: a page of n tags takes n steps.
    """

    def __init__(self):
        self.found: list[Block] = []
        self.stack = [Open("", 0, False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open block elements that show
        self.link: int | None = None  # the place of the open link
        self.text: list[str] = []
        self.linked: list[str] = []
        self.state = self.stack[0]

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name; 0 if there is none."""
        own = self.places.get(name)
        return own[-1] if own else 0

    def flush(self) -> None:
        if self.text:
            whole = " ".join(entities.unescape("".join(self.text)).split())
            if whole:
                n = whole.count(" ") + 1
                link = len(entities.unescape(" ".join(self.linked)).split())
                self.found.append(Block(whole, n, min(1.0, link / n), self.state.furniture, self.state.main, self.state.heading))
            self.text, self.linked = [], []

    def put(self, piece: str) -> None:
        top = self.stack[-1]
        if not top.hidden and piece:
            if not self.text:
                self.state = top
            elif piece.strip():  # a block is furniture only as far as all its text is
                self.state = self.state._replace(furniture=min(self.state.furniture, top.furniture), main=self.state.main or top.main)
            self.text.append(piece)
            if self.link is not None:
                self.linked.append(piece)

    def push(self, name: str, furniture: int, main: bool, hidden: bool) -> None:
        top, at = self.stack[-1], len(self.stack)
        self.places.setdefault(name, []).append(at)
        if name in BLOCK and not (top.hidden or hidden):
            self.blocks.append(at)
        if name == "a":
            self.link = at
        self.stack.append(Open(name, max(top.furniture, furniture), top.main or main, top.hidden or hidden, top.heading or len(name) == 2 and name[0] == "h" and name[1] in "123456"))

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        if self.blocks and self.blocks[-1] >= at:
            self.flush()
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        if self.link is not None and self.link >= at:
            self.link = None

    def shut(self, name: str, within: tuple[str, ...] = ()) -> None:
        """Close the innermost element of a name, unless one of ``within`` lies inside it."""
        at = self.last(name)
        if at and all(self.last(w) < at for w in within):
            self.cut(at)

    def foreign(self) -> int:
        """The place of a drawing or formula that the page is in, outside HTML parts of it."""
        at = max(map(self.last, FOREIGN))
        return at if at and all(self.last(x) < at for x in HTML_INSIDE) else 0

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            self.flush()
        elif name == "p":
            self.shut("p", PARAGRAPH_SCOPE)
            if not self.stack[-1].hidden:
                self.flush()
        elif name == "a":
            self.link = None
            if self.last("a") > (self.blocks[-1] if self.blocks else 0):
                self.cut(self.last("a"))
        elif name in BLOCK:
            self.shut(name, HIDDEN_SCOPE if name in TABLE else CELL_SCOPE)
            if not self.stack[-1].hidden:
                self.flush()
        elif name in HIDDEN or self.last(name) > (self.blocks[-1] if self.blocks else 0):
            self.shut(name)  # an inline element is not closed across an open block

    def start(self, name: str, attributes: str) -> None:
        if name in OUT_OF_FOREIGN and (at := self.foreign()):
            self.cut(at)
        if name == "br":
            self.put("\n")
            return
        if name in BLOCK and not self.stack[-1].hidden:
            self.flush()
            if name not in TABLE and name not in ("option", "optgroup", "legend", "caption", "colgroup"):
                self.shut("p", PARAGRAPH_SCOPE)
        for other in CLOSES.get(name, ()):
            self.shut(other, SCOPES.get(name, ("table",)))
        if name in VOID or attributes.endswith("/") and self.foreign():
            return
        if name == "a":
            self.end("a")
        self.push(name, *role_of(name, attributes, self.stack[-1].main))


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order."""
    out = Page()
    at, n, closed = 0, len(page), page.rfind(">")
    while at < n:
        m = TAG.search(page, at) if at <= closed or "<!" in page[at:] else None  # nothing to close a tag: text
        if m is None:
            out.put(page[at:])
            break
        if m.start() > at:
            out.put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            out.end(name)
            continue
        if name in RAW and not out.foreign():
            if name not in ("script", "style", "noscript"):
                out.flush()
            end = RAW_ENDS[name].search(page, at)
            close = page.find(">", end.end() - 1) if end else -1
            at = n if close < 0 else close + 1
            continue
        out.start(name, m[3])
    out.flush()
    return out.found


def extract(page: str | None) -> str:
    """The article's text: kept blocks, joined by blank lines."""
    if not page:
        return ""
    found = blocks(page.replace("\x00", ""))
    if not found:
        return ""
    has_main = any(b.main and b.furniture < 2 for b in found)
    edge = (0, 0.0)
    shape = [edge, *((b.words, b.link_density) for b in found), edge]
    model, kept = tree(), []
    for i, b in enumerate(found, 1):
        x = (*shape[i], *shape[i - 1], *shape[i + 1], b.furniture, b.main, b.heading, has_main and not b.main)
        if decide(model, x):
            kept.append(b.text)
    return "\n\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of a table with page_id, url and html."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        return {
            "page_id": batch.column("page_id"), "url": batch.column("url"),
            "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    src = pages.select("page_id", "url", "html")
    kinds = dict(src.dtypes)
    return map_batches(src, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
