"""Main text of web pages by composite text density.

A tolerant tokenizer builds the element tree (a block start ends an open paragraph; an end tag ends what is
open within). Every node gets a density: characters per tag, lowered by the share of link characters; blocks
and links count as tags, other markup within a line is text. A node's sum is that of its child blocks'
densities and of its loose text; without child blocks it is the density itself. The node of the largest sum
under body (ties: the deepest, then the last) is selected with all it holds. The least density on the path
from it to body is the threshold: a block beside the path that is denser is selected, too, and so are the
headings beside the selected node and its neighbours of the same element, unless body is their parent.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role, class and
id) count in the densities of what holds them, but are never selected. Scripts, styles and comments are dropped.

Cases: null and empty pages, and pages without text under body, give an empty text of 0 code points. Broken
markup never raises, and any page takes linear time. Pages are independent of one another, so ties and
repeated rows need no rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from boxwright.llm.common import tidy

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CUT = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "dialog", "menu", "head", "audio", "video", "math", "fieldset", "map"} | RAW
CUT_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
CUT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar|side-?bar|widget|related|recommend\w*|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|header|footer|masthead|comments?|commentlist|disqus|repl(?:y|ies)|respond|pagination|pager|toolbar|skip|search|toc)(?=$|[\s_-])", re.I)
#: Names that hold the article even where one of CUT_NAMES is in them too.
KEEP = {"html", "body", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Items end a neighbour of their kind, within the nearest of CONTAINERS.
ITEMS, CONTAINERS = {"li", "dt", "dd", "tr", "td", "th"}, {"ul", "ol", "dl", "table"}
SCHEMA = "page_id long, url string, text string, n_chars long"


class Node:
    __slots__ = ("tag", "parent", "items", "block", "noise", "depth", "chars", "links", "tags", "linked", "loose", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.items, self.block, self.noise = tag, parent, [], tag not in INLINE, noise
        self.depth = parent.depth + 1 if parent else 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" \t\n/") else {}


def is_noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in CUT:
        return True
    if tag in KEEP:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in CUT_ROLES or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None or any(CUT_NAMES.search(attrs.get(k, "")) for k in ("class", "id"))


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that starts at at ends (its >, quoted ones aside), or -1; last: the last place of > and of each quote."""
    first = -1
    while at <= last[">"]:
        end = page.find(">", at)
        first = end if first < 0 else first
        quote = min((q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end
        if quote >= last[page[quote]]:  # it is never closed
            break
        at = page.find(page[quote], quote + 1) + 1
    return first


class Tree:
    """The open elements of a page that is being read."""

    def __init__(self):
        self.root = self.node = Node("body", None)
        self.open: Counter[str] = Counter()
        self.kinds: list[Node] = []  # open items and containers

    def text(self, text: str) -> None:
        if text:
            self.node.items.append(text)

    def add(self, tag: str, void: bool, noise: bool = False) -> None:
        child = Node(tag, self.node, noise)
        self.node.items.append(child)
        if not void:
            self.node = child
            self.open[tag] += 1
            if tag in ITEMS or tag in CONTAINERS:
                self.kinds.append(child)

    def close(self, until: Node) -> None:
        """End until and all that is open within it."""
        while True:
            node, self.node = self.node, self.node.parent
            self.open[node.tag] -= 1
            if self.kinds and self.kinds[-1] is node:
                self.kinds.pop()
            if node is until:
                return

    def end(self, tag: str) -> None:
        if self.open[tag]:
            node = self.node
            while node.tag != tag:
                node = node.parent
            self.close(node)
        elif tag in ("p", "br"):
            self.node.items.append(Node(tag, self.node))

    def start(self, tag: str, attrs: dict[str, str], void: bool) -> None:
        if tag not in INLINE and not void and self.open["p"]:
            node = self.node
            while node.parent and not node.block:
                node = node.parent
            if node.tag == "p":  # a block ends an open paragraph, and what is open in it
                self.close(node)
        if tag in ITEMS:
            for node in reversed(self.kinds):
                if node.tag in CONTAINERS:
                    break
                if node.tag == tag:
                    self.close(node)
                    break
        self.add(tag, void, is_noise(tag, attrs))


def parse(page: str) -> Node:
    """The element tree."""
    tree, at, lower = Tree(), 0, None
    last = {c: page.rfind(c) for c in ">\"'"}
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            tree.text(page[at:])
            break
        if page.startswith("<!--", start):
            tree.text(page[at:start])
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = NAME.match(page, start)
        if not name and not page.startswith(("<!", "<?"), start):
            tree.text(page[at : start + 1])
            at = start + 1
            continue
        end = tag_end(page, name.end() if name else start, last) if name else page.find(">", start)
        if end < 0:
            tree.text(page[at:] if name else page[at:start])
            break
        tree.text(page[at:start])
        at = end + 1
        if not name:
            continue
        tag, rest = name[1].lower(), page[name.end() : end]
        if page[start + 1] == "/":
            if tag not in ("html", "body"):
                tree.end(tag)
        elif tag in RAW:
            if lower is None:
                lower = page.lower()
            close = lower.find(f"</{tag}", at) if len(lower) == len(page) else (m.start() if (m := re.compile(f"</{tag}", re.I).search(page, at)) else -1)
            at = len(page) if close < 0 else (page.find(">", close) + 1 or len(page))
        elif tag not in ("html", "body"):
            tree.start(tag, attributes(rest), tag in VOID or rest.endswith("/") and tag in ("svg", "path"))
    return tree.root


def measure(root: Node) -> list[Node]:
    """Characters, link characters, tags and link tags of every node, then its density and its sum; parents come first."""
    order = [root]
    for n in order:
        order += [x for x in n.items if isinstance(x, Node)]
    for n in reversed(order):
        kids = [x for x in n.items if isinstance(x, Node)]
        own = sum(len(html.unescape(x).strip()) for x in n.items if isinstance(x, str))
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + (k.block or k.tag == "a") for k in kids)
        n.links = n.chars if n.tag == "a" else sum(k.links for k in kids)
        n.linked = (n.tag == "a") + sum(k.linked for k in kids)
        n.loose = 0 if n.tag == "a" else own + sum(k.loose for k in kids if not k.block and not k.noise)
    for n in order:
        c, lc, t, lt = n.chars, n.links, max(n.tags, 1), max(n.linked, 1)
        base = math.log(c / max(c - lc, 1) * lc + root.links / max(root.chars, 1) * c + math.e)
        adjusted = math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(max(base, 1.0001)) if lc else 1.0
        n.density = c / t * min(adjusted, 1.0)
    for n in reversed(order):
        kids = [x for x in n.items if isinstance(x, Node) and x.block and not x.noise and x.chars]
        n.total = sum(k.density for k in kids) + n.loose if kids else n.density
    return order


def selected(root: Node) -> set[int]:
    """Identities of the nodes that are selected with all they hold, noise aside."""
    order, noisy = measure(root), set()
    best = root
    for n in order:
        if n.noise or id(n.parent) in noisy:
            noisy.add(id(n))
        elif (n.total, n.depth) >= (best.total, best.depth):
            best = n
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    least, out = min(n.density for n in path), {id(best)}
    for node in path[:-1]:
        for x in node.parent.items:
            if isinstance(x, Node) and x is not node and x.block and not x.noise:
                beside = node is best and node.parent is not root and (x.tag in HEADINGS or node.block and x.tag == node.tag)
                if x.density > least or beside:
                    out.add(id(x))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    chosen = selected(root)
    out: list[list[str]] = [[]]
    todo: list = [(root, False)]
    while todo:
        x, on = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            if on:
                out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        elif not x.noise:
            on = on or id(x) in chosen
            edge = [(None, on)] if x.block else []
            todo += [*edge, *((y, on) for y in reversed(x.items)), *edge]
    return " ".join(t for b in out if (t := " ".join(html.unescape("".join(b)).split())))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), SCHEMA)
