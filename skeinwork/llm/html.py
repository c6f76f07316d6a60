"""Main text of web pages by composite text density.

For every element: characters C, tags T, link characters LC and link tags LT of its
subtree give the composite density
    C / T * log(C / LC * T / LT) with base ln(C / nLC * LC + LCb / Cb * C + e),
where nLC is C - LC and the subscript b marks the whole body. A node's density sum adds up
its children's densities; the subtree with the largest sum is the text. It is widened by
blocks outside it: next to it those whose density reaches the least density met on the
path from the body to it, and further up those that reach the least one below the body.
Blocks that are mostly links are not added.

Densities count all text that a page shows. Menus, footers, forms, notices, adverts,
sidebars and reader comments that element, role or class name tells apart are not chosen
and not given out, wherever they stand: comments are as dense as an article, and a
one-line article is no denser than a notice beside it. Where a page names nothing,
densities alone decide. Unclosed and stray tags are mended as the elements' nesting
rules have it. Character references are decoded, white space inside a block becomes
one space, and blocks are joined by a newline in page order.

Defined cases: null and empty html give an empty text; pages without markup give
their text as one block; ids and urls pass through as they are, nulls and repeats too;
time and memory grow with a page's length and no faster, whatever it holds; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import gc
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("head nav footer aside form script style noscript template iframe object embed applet canvas svg math audio video button select textarea input dialog menu title noembed noframes xmp".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option optgroup".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th")}
SCOPES = frozenset("article aside body div main section table td th footer header nav form ul ol html".split())
#: What an open paragraph is not closed across.
P_BOUNDS = SCOPES | {"li", "dd", "dt", "blockquote"}
HOLD_LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre hr caption legend summary figcaption dt option".split())
UNSEEN = frozenset("head script style noscript template iframe object embed applet canvas svg math audio video title noembed noframes xmp".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|header|masthead|topbar|footer|colophon|copyright|sidebar|side|aside|rail|widget|widgets|related|recommended|recommendations|popular|trending|share|sharing|social|ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|warning|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|comment|comments|comment-list|respond|reply|replies|disqus|form|search)(?=$|[\s_-])",
    re.IGNORECASE,
)
KEEP_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?=$|[\s_-])", re.IGNORECASE)
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: A tag without quotes up to its end.
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"']*+)([^>\"']*+)>")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?|.", re.DOTALL)
BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "dropped", "shown", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.shown, self.children = tag, parent, dropped, True, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def is_clutter(tag: str, raw: str, inside_article: bool) -> bool:
    if tag in NO_TEXT or tag == "header" and not inside_article:
        return True
    if not raw or tag in ("html", "body", "article", "main"):
        return False
    at = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw) if k}
    if at.get("role", "").lower() in NO_ROLES or at.get("aria-hidden", "").lower() == "true" or "hidden" in at:
        return True
    if re.search(r"display\s*:\s*none", at.get("style", ""), re.IGNORECASE):
        return True
    named = f"{at.get('class', '')} {at.get('id', '')}"
    if not NAMES.search(named):
        return False
    return not (KEEP_NAMES.search(named) and not re.search(r"(?:comment|sidebar|advert|cookie|related|share|footer|nav)", named, re.IGNORECASE))


class Tokens:
    """Tags of a page as (start, end, closing, name, attributes), each place read a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where `what` is next, or -1; what is missing once is not looked for again."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_of(self, at: int) -> int:
        """The > that ends a tag, quoted ones aside; where quotes never close, the next one."""
        place = at
        while self.quotes:
            m = STOP.search(self.page, place)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                close = self.find(m[0], m.end())
                place = m.end() if close < 0 else close + 1
        return self.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                comment = page.startswith("<!--", at)
                end = self.find("-->", at + 4) if comment else self.find(">", at)
                if end < 0 and not comment:
                    return None
                return at, len(page) if end < 0 else end + (3 if comment else 1), False, "", ""
            m = PLAIN.match(page, at)
            if m:
                return at, m.end(), bool(m[1]), m[2].lower(), m[3]
            m = OPEN.match(page, at)
            if m:
                end = self.end_of(m.end())
                if end < 0:
                    return None
                return at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            at += 1
        return None

    def after(self, name: str, at: int) -> int:
        """Where the element of raw text ends, past its end tag; -1 if it never does."""
        if f"</{name}" in self.missing:
            return -1
        m = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(self.page, at)
        if m is None:
            self.missing.add(f"</{name}")
        return m.end() if m else -1


class Stack:
    """Open elements, with the places of each tag and of those that bound a scope."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes, self.bounds = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        tag, at = node.tag, len(self.nodes)
        self.places.setdefault(tag, []).append(at)
        if tag in P_BOUNDS:
            self.bounds.append(at)
            if tag in SCOPES:
                self.scopes.append(at)
        self.nodes.append(node)

    def last(self, tag: str) -> int:
        x = self.places.get(tag)
        return x[-1] if x else 0

    def close(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in P_BOUNDS:
                self.bounds.pop()
                if tag in SCOPES:
                    self.scopes.pop()

    def closing(self, tag: str) -> None:
        at = self.last(tag)
        if at and (tag in SCOPES or self.scopes[-1] < at):
            self.close(at)

    def before(self, tag: str) -> None:
        """Closes what an opening tag ends."""
        if tag in ENDS:
            stop = max(map(self.last, SAME_LEVEL[tag]))
            ends = [x[i] for t in ENDS[tag] if (x := self.places.get(t)) and (i := bisect.bisect_right(x, stop)) < len(x)]
            if ends:
                self.close(min(ends))
        elif tag in CLOSES_P and (at := self.last("p")) > self.bounds[-1]:
            self.close(at)


def parse(page: str) -> Node:
    """The element tree; text stands between elements as strings."""
    root = Node("#root", None, False)
    tokens, stack, at = Tokens(page), Stack(root), 0
    while token := tokens.next(at):
        start, end, closing, tag, raw = token
        if start > at:
            stack.nodes[-1].children.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            stack.closing(tag)
            continue
        stack.before(tag)
        parent = stack.nodes[-1]
        node = Node(tag, parent, parent.dropped or (tag in NO_TEXT or tag == "header" or bool(raw)) and is_clutter(tag, raw.strip(), bool(stack.last("article"))))
        node.shown = parent.shown and tag not in UNSEEN
        parent.children.append(node)
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            after = tokens.after(tag, at)
            if after >= 0 or tag in ("script", "style", "textarea", "template"):
                at = len(page) if after < 0 else after
            continue
        stack.push(node)
    if at < len(page):
        stack.nodes[-1].children.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Fills counts bottom up, of all that is shown; returns the nodes that count, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.shown:
            continue
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) if not c.isspace() else 0
            elif c.shown:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def densities(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t = node.chars, max(1, node.tags)
        if not c:
            continue
        lc, lt = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + ratio * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + math.e - 1) / max(base, 1.0)
    for node in order:
        node.sum = sum(c.density for c in node.children if not isinstance(c, str))


def select(root: Node) -> list[Node]:
    """The subtrees to keep, in page order."""
    order = measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    densities(order, body)
    # an element of lines is a part of the text, not the text
    inner = [n for n in order if n.chars and not n.dropped and n.tag in BLOCKS and n.tag not in HOLD_LINES and n.tag != "html"]
    if not inner:
        return [body]
    best = max(inner, key=lambda n: n.sum)
    if best.sum <= 0:
        best = body
    path, node = [best], best
    while node is not body and node.parent is not None:
        node = node.parent
        path.append(node)
    inside = [n.density for n in path if n is not root and n is not body] or [best.density]
    near = min(inside + ([body.density] if body is not root else []))
    far = min(inside)
    held = {id(n) for n in path[1:]}
    chosen, stack = [], [path[-1]]
    while stack:
        node = stack.pop()
        if node is best:
            chosen.append(node)
        elif id(node) in held:
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
        elif node.tag in BLOCKS and node.chars and node.link_chars * 2 < node.chars and node.density >= (near if node.parent is best.parent and best.parent is not body else far):
            chosen.append(node)
    return chosen


def blocks_of(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = BLANKS.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        # None stands where a block ends
        stack: list = [top]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                run.append(node)
            elif node is None:
                if run:
                    end()
            elif not node.dropped:
                if node.tag in ("br", "wbr"):
                    run.append(" " if node.tag == "br" else "")
                    continue
                if node.tag in BLOCKS or node.tag == "#root":
                    if run:
                        end()
                    stack.append(None)
                stack.extend(reversed(node.children))
        if run:
            end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    # nothing of a tree is garbage before its end: collections would only walk it again and again
    gc.disable()
    try:
        return "\n".join(blocks_of(select(parse(page))))
    finally:
        gc.enable()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "html"):
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
