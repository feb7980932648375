"""Main-text extraction by composite text density (Sun, Song and Liao, 2011).

A page is parsed into a tree. For every node, with C its characters, T its tags, and LC and LT those in links, the
composite density is

    C / T * log(C * T / (LC * LT)), the logarithm to base ln(C / (C - LC) * LC + lb / cb * C + e)

where lb and cb are the body's link characters and characters: characters a tag, less the more of them are links. A node's
density sum is that of its children's densities, but for those that only mark words within a line. The core is the node below the body with the
largest sum, or the body if none has any. The threshold is the least density on the path from the body to the core.

The main text is the core's whole subtree, or, where the core lies in an article, the whole of the outermost article: short
paragraphs, headings and lists of links are as much part of it as long ones. Elsewhere parts of the core that are mostly links (several of
them) and less dense than the threshold go, and beside the path a subtree stays if its density and its density sum reach the threshold, as a
second article's do, or if it is a paragraph, list, table or the like as dense as that and not mostly links; headings right on the path
stay (those of lower ranks where the core comes after them). No name of a class or id counts in finding the core.

By their tag go what is no text of the page (scripts, controls, media), and navigation, asides, footers, forms and headers outside
articles, unless one holds more than half of the page's characters, as a form around a whole page does; by their attributes, what is
hidden or has the role of such a part. An article within an article is a comment, and goes, if it has less text that is no link than the outer one
has of its own; else the outer one is its frame. A container (div, section, list) that a class or id as a whole calls adverts, comments
and the like (NAMES) goes if its density sum is below half of the core's; no paragraph goes by its name.
Texts of blocks have white space runs, also from character references, as one space, are trimmed and joined by line breaks.

Parsing follows HTML's rules where they matter here: raw text in script, style and the like ends only at its own end tag,
comments and declarations go, void tags have no content, p, li, table and list parts close each other implicitly, an end
tag closes up to its nearest open start tag, though not out of a closed container, and what is open at the end is closed.

Defined cases: null and empty pages, and pages without text, give an empty text; every page is one row, repeated or not;
extra columns are kept if named. A page is a row of its own, so no page meets another.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, sliced

# Names of HTML elements by their role in the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("head script style noscript template iframe object embed svg canvas audio video map button input select option textarea dialog menu noembed noframes".split())
ASIDE = frozenset("nav aside footer form header".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "optgroup", "option", "legend"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPE = frozenset("table td th ul ol dl article section main body html div blockquote aside nav footer header form".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span abbr cite q sub sup mark ins del time kbd var samp".split())
HEADING, LOWER = frozenset("h1 h2 hgroup".split()), frozenset("h3 h4 h5 h6".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form tablist".split())
#: Roles of notices, which are text within an article.
NOTICES = frozenset(("alert", "status"))
FRAMES = frozenset("div section ul ol".split())
#: Names that say in one word what a container is; they must be the whole of its class or id.
NAMES = frozenset("ad ads advert advertisement sponsored promo comments comment-list disqus_thread sidebar cookie-notice newsletter share related breadcrumb breadcrumbs pagination".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"\s+")


NEVER, UNLESS, NAMED = 1, 2, 3


class Node:
    __slots__ = ("tag", "parts", "drop", "c", "t", "lc", "lt", "density", "total")

    def __init__(self, tag: str, drop: int = 0):
        self.tag, self.parts, self.drop = tag, [], drop

    def children(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]


def dropped(tag: str, attributes: str, inside: bool = False) -> int:
    """Whether the element is never main text: NEVER, or UNLESS it holds most of the page, or NAMED as no part of the article. inside: it
    is part of an article."""
    if tag in NO_TEXT:
        return NEVER
    if attributes and tag not in ("html", "body", "main", "article"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return NEVER
            if name == "role" and (value in ROLES or value in NOTICES and not inside):
                return UNLESS
            if name in ("class", "id") and tag in FRAMES and value.strip() in NAMES:
                return NAMED
    return UNLESS if tag in ASIDE else 0


def parse(html: str) -> Node:
    """The page's tree; text parts are strings, not yet unescaped."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    find = _TOKEN.search
    open_tags: Counter[str] = Counter()  # of the stack, so that no tag is looked for in vain

    def close(k: int) -> None:
        open_tags.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = find(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not open_tags[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in FORMATTING and stack[k].tag in SCOPE:
                    break  # a formatting element's end does not close what holds it
            continue
        if tag in ("html", "body"):
            if tag == "body" and open_tags["head"]:
                close(next(k for k, x in enumerate(stack) if x.tag == "head"))
            continue
        if tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template") and stack[-1].tag == "head":
            close(len(stack) - 1)  # content ends the head
        implied = IMPLIED.get(tag, frozenset())
        if tag in CLOSES_P and open_tags["p"] or any(open_tags[x] for x in implied):
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k].tag
                if name == "p" and tag in CLOSES_P or name in implied:
                    close(k)
                    if name == "p" or tag in ("li", "dt", "dd", "option"):
                        break
                elif name in SCOPE and name not in ("td", "th") or name in SCOPE and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                    break
        drop = dropped(tag, m[3] or "", bool(open_tags["article"]))
        inside = open_tags["article"] or open_tags["main"]
        node = Node(tag, 0 if tag == "header" and drop == UNLESS and inside else drop)
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            node.parts.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            node.drop = NEVER
        elif tag not in VOID and not ((m[3] or "").endswith("/") and tag in ("svg", "path", "g", "use", "rect", "circle")):
            stack.append(node)  # a slash means nothing on an element with content
            open_tags[tag] += 1
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children())
    return order[::-1]


def count(order: list[Node]) -> None:
    """Sets the characters, tags, link characters and link tags of the nodes."""
    for node in order:
        c = t = lc = lt = 0
        for p in node.parts:
            if isinstance(p, str):
                c += len(p) - p.count(" ") - p.count("\n") if p.strip() else 0
            else:
                c, t, lc, lt = c + p.c, t + p.t + 1, lc + p.lc, lt + p.lt + (p.tag == "a")
        if node.tag == "a":
            lc, lt = c, t
        node.c, node.t, node.lc, node.lt = c, t, lc, lt


def comments(root: Node) -> list[Node]:
    """Articles within an article that have less text outside links than the outer one has of its own."""
    own: dict[int, int] = {}
    within: list[tuple[Node, Node]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, outer = todo.pop()
        if node.tag == "article":
            own[id(node)] = node.c - node.lc
            if outer is not None:
                within.append((node, outer))
            outer = node
        todo.extend((p, outer) for p in node.children())
    for node, outer in within:
        own[id(outer)] -= node.c - node.lc
    return [node for node, outer in within if node.c - node.lc < own[id(outer)]]


def clear(root: Node) -> None:
    """Takes out what goes by its tag or attributes, and comments."""
    for node in in_order(root):
        node.parts = [p for p in node.parts if isinstance(p, str) or p.drop != NEVER]
    count(in_order(root))
    gone = {id(node) for node in comments(root)}
    if gone:
        for node in in_order(root):
            node.parts = [p for p in node.parts if isinstance(p, str) or id(p) not in gone]
        count(in_order(root))
    most, todo = root.c / 2, [root]
    while todo:
        node = todo.pop()
        node.parts = [p for p in node.parts if isinstance(p, str) or p.drop != UNLESS or p.c > most]
        todo.extend(node.children())


def measure(root: Node) -> list[Node]:
    """Sets densities and density sums of all nodes; they are returned, children before parents."""
    order = in_order(root)
    count(order)
    share = root.lc / root.c if root.c else 0.0
    for node in order:
        c, t, lc, lt = node.c, max(node.t, 1), node.lc, node.lt
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0000001)) / base
        node.total = sum(p.density for p in node.children() if p.tag not in FORMATTING)
    return order


def choose(root: Node, order: list[Node]) -> tuple[list[Node], float]:
    """The path from the core to the root, and the threshold."""
    parent = {id(p): node for node in order for p in node.children()}
    core = max(order, key=lambda x: (x is not root) * x.total)  # the root if no other has any
    path = [core if core.total and core is not root else root]
    while id(path[-1]) in parent:
        path.append(parent[id(path[-1])])
    return path, min(x.density for x in path)


def main_text(root: Node) -> Node:
    """The tree of the main text."""
    clear(root)
    order = measure(root)
    path, threshold = choose(root, order)
    core = path[0]
    articles = [k for k, x in enumerate(path) if x.tag == "article"]
    path = path[articles[-1] :] if articles else path
    most = core.total / 2
    todo = [(path[0], bool(articles))]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag == "article"
        node.parts = [p for p in node.parts if isinstance(p, str) or not (p.drop == NAMED and p.total < most) and (inside or p.tag in FORMATTING or p.lt < 2 or 2 * p.lc < p.c or p.density >= threshold)]
        todo.extend((p, inside) for p in node.children())
    made = path[0]
    for below, node in zip(path, path[1:]):
        out, seen = Node(node.tag), False
        for p in node.parts:
            if p is below:
                out.parts.append(made)
                seen = True
            elif not isinstance(p, str) and 2 * p.lc < p.c and (p.tag in HEADING or p.tag in LOWER and not seen or p.density >= threshold and (p.total >= threshold or p.tag in TEXTUAL)):
                out.parts.append(p)
        made = out
    return made


def blocks(node: Node) -> str:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", unescape("".join(line))).strip()
            if text:
                out.append(text)
            line.clear()

    todo: list[tuple[Node, int]] = [(node, 0)]
    while todo:
        at, k = todo.pop()
        if k == 0 and at.tag in BLOCK:
            flush()
        if k < len(at.parts):
            todo.append((at, k + 1))
            p = at.parts[k]
            if isinstance(p, str):
                line.append(p)
            else:
                todo.append((p, 0))
        elif at.tag in BLOCK:
            flush()
    flush()
    return "\n".join(out)


def extract_text(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    return blocks(main_text(parse(html)))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text, n_chars of every page."""
    prepare(pages.sparkSession)
    base = pages.select(*keep, F.col(f"`{html}`").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keep).schema)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, kept):
                texts = [extract_text(h) for h in b.column(kept).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:kept], "text", "n_chars"])

    return base.mapInArrow(run, f"{fields}, text string, n_chars bigint")


def digest(pages: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return extract(pages)
