"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements.  Each element with text below it gets features of its subtree
(text length, density of text against markup, link density, sentence marks, share of the page's text), its
tag and attribute tokens (learned weights, its own and those of its ancestors), depth and siblings.
Trees boosted on labelled pages give log-odds of being main text.  Decoding then chooses for the whole
tree at once: dropping an element drops all below it, and text is kept only under kept elements, so an
ancestor and a descendant never contradict each other.

The labelled pages are generated (``_pages``, a fixed number from a fixed seed), since tables of raw pages
carry no labels: each has an article under varying markup among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.

Blocks: text between block-level boundaries; ``<br>`` counts as white space, and so do all characters that
Unicode calls white space (no-break spaces and the separators U+001C to U+001F with them).  Character
references are decoded within one piece of text, never across markup.

Never text: scripts, styles, ``noscript`` (what stands in for scripts), ``template``, ``svg`` and ``iframe``, the page's
head, and the parts of forms (buttons, choices, text areas).  Formulas and fall-back text of ``object``, ``audio``,
``video`` and ``canvas`` are judged by the trees like other elements.

Defined cases: null or empty html, and html without text, give the empty text; broken markup (open tags,
stray end tags, a page cut off) is parsed as far as it goes; pages of any length and depth take time in
proportion to their length; repeated rows are extracted alike; columns other than page_id, url and html are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._boost import Boosted, boost
from ._pages import labelled_pages
from ._tables import table
from ._words import pieces

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select".split()
)
SILENT = frozenset("script style noscript template svg iframe head title select option button textarea input datalist".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption option select legend summary figcaption".split())
LIKE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_P_STOPS = ("td", "th", "button", "table")

PRICE = 10.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?;:,]")
_STEP = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("attributes", "children", "depth", "items", "parent", "place", "silent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list = []  # strings and child nodes in page order
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.silent = bool(parent and parent.silent) or tag in SILENT
        self.place = 0

    def add(self, tag: str, attributes: str) -> Node:
        node = Node(tag, attributes, self)
        node.place = len(self.children)
        self.items.append(node)
        self.children.append(node)
        return node


def _attribute_text(raw: str) -> str:
    return " ".join(m[2].strip("\"'") for m in _ATTRIBUTE.finditer(raw)) if raw and "=" in raw else ""


class _Open:
    """The open elements, with the places of each tag among them: finding and closing take no walk up the tree."""

    def __init__(self, root: Node):
        self.path = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def nearest(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.path) > place:
            self.places[self.path.pop().tag].pop()


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    opened = _Open(root)
    at, size = 0, len(page)
    while at < size:
        node = opened.path[-1]
        m = _TOKEN.search(page, at)
        if not m:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        if end := m[1]:
            if place := opened.nearest((end.lower(),)):
                opened.close(place)
            continue
        tag, raw = (m[2], m[3]) if m[2] else (m[4], m[5])
        if not tag:
            if m[0].startswith("<![CDATA["):
                node.items.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag in CLOSES_P and (place := opened.nearest(("p",))) > opened.nearest(_P_STOPS):
            opened.close(place)
        if like := LIKE.get(tag):
            names, stops = like
            if (place := opened.nearest(names)) > opened.nearest(stops):
                if tag == "tr" and opened.path[place].tag != "tr":
                    place = opened.nearest(("tr",))
                if place:
                    opened.close(place)
        node = opened.path[-1]
        if tag in VOID:
            node.add(tag, "")
            continue
        child = node.add(tag, _attribute_text(raw))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if not close:
                child.items.append(page[at:])
                break
            child.items.append(page[at : close.start()])
            at = page.find(">", close.end())
            at = size if at < 0 else at + 1
        elif not raw.rstrip().endswith("/") or tag in BLOCK:
            opened.push(child)
    return root


def tokens(node: Node) -> list[str]:
    found = ["<" + node.tag]
    if node.attributes:
        found += _PART.findall(_STEP.sub(r"\1 \2", node.attributes).lower())
    return found


class Page:
    """Nodes with text below them, in page order (parents first), and their features."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.nodes: list[Node] = []
        self.index: dict[int, int] = {}
        self.own: list[int] = []  # characters of direct text
        stack = [self.root]
        order = []
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(reversed(node.children))
        sums: dict[int, list] = {}
        for node in reversed(order):
            own, marks = 0, 0
            if not node.silent:
                for x in node.items:
                    if isinstance(x, str) and (t := x.strip()):
                        own += len(t)
                        marks += len(_SENTENCE.findall(t))
            total = [own, own if node.tag == "a" else 0, marks, 1, node.tag == "p", node.tag == "li", own]
            for c in node.children:
                s = sums[id(c)]
                for j in (0, 1, 2, 3, 4, 5):
                    total[j] += s[j]
            if node.tag == "a":
                total[1] = total[0]
            sums[id(node)] = total
        for node in order:
            if sums[id(node)][0] and not node.silent:
                self.index[id(node)] = len(self.nodes)
                self.nodes.append(node)
        self.sums = [sums[id(n)] for n in self.nodes]
        self.own = [s[6] for s in self.sums]

    def features(self, weights: dict[str, float]) -> np.ndarray:
        out = np.zeros((len(self.nodes), 19))
        whole = max(1, self.sums[0][0]) if self.sums else 1
        before = 0
        lows, highs = [], []
        for i, node in enumerate(self.nodes):
            text, linked, marks, elements, paragraphs, entries, own = self.sums[i]
            known = [weights[t] for t in tokens(node) if t in weights]
            low, high, total = min(known, default=0.0), max(known, default=0.0), sum(known)
            up = self.index.get(id(node.parent)) if node.parent else None
            above_low, above_high = (lows[up], highs[up]) if up is not None else (0.0, 0.0)
            lows.append(min(low, above_low))
            highs.append(max(high, above_high))
            brothers = len(node.parent.children) if node.parent else 1
            parent_text = self.sums[up][0] if up is not None else text
            out[i] = (
                math.log1p(text), text / elements, linked / text, marks / text * 100, text / whole, own / text, paragraphs, entries, elements,
                node.depth, brothers, node.place / brothers, text / parent_text, before / whole, low, high, total, above_low, above_high,
            )
            before += own
        return out

    def decode(self, scores: np.ndarray) -> list[bool]:
        """Which nodes are kept: the best choice over the tree in which a dropped node drops all below it.

        Leaving a kept parent has a price, so that a short paragraph needs clear evidence against it.
        """
        n = len(self.nodes)
        # an element counts by its own text, and a little by itself so that containers have a say
        weight = np.array([math.sqrt(o) + 1 for o in self.own]) * np.clip(scores, -6, 6) if n else np.zeros(0)
        keep, drop = weight.copy(), -weight
        chosen = [False] * n
        for i in range(n - 1, 0, -1):
            up = self.index[id(self.nodes[i].parent)]
            keep[up] += max(keep[i], drop[i] - PRICE)
            drop[up] += drop[i]
        for i in range(n):
            up = self.index[id(self.nodes[i].parent)] if i else None
            chosen[i] = keep[i] > drop[i] - PRICE and chosen[up] if i else keep[i] > drop[i]
        return chosen

    def text(self, chosen: list[bool]) -> str:
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            if run:
                if t := " ".join("".join(run).split()):
                    blocks.append(t)
                run.clear()

        stack: list = [self.root]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, tuple):
                if chosen[x[0]]:
                    run.append(html.unescape(x[1]))
            else:
                i = self.index.get(id(x))
                if x.tag == "br":
                    run.append(" ")
                elif x.tag in BLOCK:
                    flush()
                if i is not None:
                    if x.tag in BLOCK:
                        stack.append(None)
                    stack.extend((i, y) if isinstance(y, str) else y for y in reversed(x.items))
        flush()
        return "\n".join(blocks)


@functools.cache
def trained(pages: int = 400, seed: int = 7) -> tuple[dict[str, float], Boosted]:
    """Token weights and boosted trees from generated pages, on which the marked text is the main text."""
    made = [(Page(p), mark) for p, mark in labelled_pages(pages, seed)]
    labels = []
    seen: dict[str, list[float]] = {}
    for page, mark in made:
        good = [0] * len(page.nodes)
        for i in range(len(page.nodes) - 1, -1, -1):
            node = page.nodes[i]
            good[i] += sum(len(x.strip()) for x in node.items if isinstance(x, str) and mark in x)
            if i:
                good[page.index[id(node.parent)]] += good[i]
        y = [2 * g > s[0] for g, s in zip(good, page.sums, strict=True)]
        labels += y
        for node, label in zip(page.nodes, y, strict=True):
            for t in set(tokens(node)):
                seen.setdefault(t, [0.0, 0.0])[label] += 1
    weights = {t: math.log((b + 1) / (a + 1)) for t, (a, b) in sorted(seen.items()) if a + b >= 4}
    x = np.concatenate([page.features(weights) for page, _ in made])
    return weights, boost(x, np.array(labels, float))


def main_texts(pages: list[str | None], model: tuple[dict[str, float], Boosted]) -> list[str]:
    """The main text of each page; the nodes of all pages are scored together."""
    weights, trees = model
    parsed = [Page(x or "") for x in pages]
    scores = trees.scores(np.concatenate([p.features(weights) for p in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        n = len(p.nodes)
        out.append(p.text(p.decode(scores[at : at + n])) if n else "")
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = main_texts(piece.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
