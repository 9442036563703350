"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, lowered by the share and the density of
links. The node whose children's densities sum highest stands in the main text; the least
density on the path from it up to the body is the threshold, and what stays below that on the
way back down is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIP = frozenset(
    "head script style template svg math canvas iframe object noembed noframes noscript nav header footer aside form button select "
    "textarea input dialog menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
# an open <p> ends before these
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend summary".split())
# an open element ends before these, up to the limit elements
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table", "tbody", "thead", "tfoot"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("article main".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup mark".split())
# words in class, id or role that mark what is not the article
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related recommended share social comment comments commentlist respond replies "
    "disqus cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay paywall toolbar pagination pager "
    "skip login search complementary contentinfo alert".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "text", "chars", "tags", "link_chars", "link_tags", "density", "total", "aside", "parent")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, text: str | None = None):
        self.tag, self.parent, self.aside, self.text = tag, parent, aside, text
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        if parent is not None:
            parent.kids.append(self)


def _marked(tag: str, attrs: str) -> bool:
    if tag in SKIP:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif any(w in ASIDE_WORDS for w in _WORD.findall(_CAMEL.sub(" ", value).lower())):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; what can't be nested is closed as browsers do, roughly."""
    root = at = Node("html", None)
    pos, end = 0, len(page)
    opened: Counter[str] = Counter()  # every element opened and not surely closed

    def open_in(tags: frozenset, limits: frozenset) -> Node | None:
        n = at
        while n is not root and n.tag not in limits:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    def put(text: str) -> None:
        if text:
            Node("#text", at, text=html.unescape(text) if "&" in text else text)

    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            put(page[pos:])
            break
        put(page[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            opened[tag] -= 1
            n = at
            while n is not root and n.tag != tag:
                if tag in FORMATTING and n.tag in BLOCK:
                    n = root  # a stray end tag of a format doesn't close blocks
                    break
                n = n.parent
            if n is not root:
                at = n.parent
            continue
        if tag in ("html", "body", "head"):
            if tag == "head":
                at = Node("head", at, True)
                opened["head"] += 1
            elif tag == "body":
                while at.tag == "head":
                    at = at.parent
                if not any(k.tag == "body" for k in root.kids):
                    at = Node("body", root)
            continue
        if tag in ENDS_P and (p := open_in(frozenset(["p"]), frozenset(["td", "th", "li", "div", "article", "section"]))):
            at = p.parent
        if tag in ENDS and (n := open_in(*ENDS[tag])):
            at = n.parent
        node = Node(tag, at, _marked(tag, m[3] or ""))
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        opened[tag] += 1
        at = node
    return root


def _order(root: Node) -> list[Node]:
    """The nodes in page order, without what stands aside."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.aside:
            out.append(n)
            todo.extend(reversed(n.kids))
    return out


def measure(root: Node) -> None:
    """Fill in densities: composite, from characters, tags, link characters and link tags."""
    nodes = _order(root)
    for n in reversed(nodes):
        if n.text is not None:
            n.chars = len(_SPACE.sub(" ", n.text).strip())
            continue
        for k in n.kids:
            if not k.aside:
                n.chars += k.chars
                n.tags += k.tags + (k.text is None)
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.chars and n.text is None:
            tags, link, links = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * link + share * n.chars + math.e)
            ratio = n.chars / link * tags / links
            n.density = n.chars / tags * math.log(ratio, base) if ratio > 1 else 0.0
    for n in nodes:
        n.total = sum(k.density for k in n.kids)


def _blocks(top: Node, path: set[Node], best: Node, threshold: float) -> list[str]:
    """The texts of the blocks below `top`, in order.

    Below `best` all blocks count, linked ones too; beside the path to it headings do, and
    blocks that are as dense as the threshold. Other blocks of mostly links below the threshold
    don't, and on a page of links alone none does.
    """
    out: list[str] = []
    run: list[str] = []
    main = best.total > 0 or best.tag in WHOLE  # else the page is links only

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node, bool, bool]] = [(top, True, top is best)]
    while todo:
        n, enter, inside = todo.pop()
        if not enter:
            flush()
        elif n.text is not None:
            run.append(n.text)
        elif n.tag in ("br", "wbr"):
            run.append(" ")
        elif not n.aside:
            inside = inside or n is best
            if n.tag in BLOCK and n is not top:
                sparse = n.density < threshold
                counts = main and (inside or n.tag in HEADINGS)
                if sparse and not counts and (2 * n.link_chars > n.chars or not inside and n not in path and n.tag not in HEADINGS):
                    flush()
                    continue
            if n.tag in BLOCK:
                flush()
                todo.append((n, False, inside))
            todo.extend((k, True, inside) for k in reversed(n.kids))
    flush()
    return out


def extract(page: str | None) -> str:
    """Blocks of the main text joined by an empty line; "" for a page without text."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    nodes = [n for n in _order(root) if n.text is None]
    body = next((n for n in nodes if n.tag == "body"), root)
    best = max(nodes, key=lambda n: n.total)
    path, threshold = set(), math.inf
    n = best
    while n is not None:
        path.add(n)
        if n.density and n.tag != "html":
            threshold = min(threshold, n.density)
        n = n.parent
    whole = next((n for n in sorted(path, key=lambda n: -n.chars) if n.tag in WHOLE), None)
    if whole is not None:
        return "\n\n".join(_blocks(whole, path, whole, threshold))
    return "\n\n".join(_blocks(body if body in path else root, path, best, threshold))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row of pages; text is "" where there is none.

    One pass over Arrow batches. A null or empty page has no text; markup that is not closed,
    not nested or not HTML at all gives what text it holds; ids and urls may be null or repeat;
    other columns are ignored; an empty table gives no rows.
    """
    slim = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    kinds = f"id {slim.schema['id'].dataType.simpleString()}, url {slim.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [extract(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, kinds).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
