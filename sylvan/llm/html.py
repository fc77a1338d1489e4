"""Main text of web pages by composite text density.

The page is parsed to a tree, without the elements that are no main text by their kind (scripts, styles, forms, navigation, footers, asides,
hidden ones).  Elements whose class, id or role says so are doubtful, by a whole name (``sidebar``) or a part of one (``post-comments``, ``cookieNotice``),
unless another part makes it a property of something else (``has-sidebar``).  They go, but for: headings and paragraphs of an article; elements that
hold an article, main or first heading, unless their whole name says that they are adverts, comments and the like; and, where no article lies
elsewhere, one of a layout's name that has more text than all of the page outside doubtful elements.  Of an article's own header the headings stay.
Every node left gets its link-adjusted characters per tag; a node's density sum adds up its children's.  The subtree with the largest sum is the
content; the least density on its path to the body is the threshold, and where the subtree lies in an article element, that whole article is
taken.  Of the taken node, if it is in no article, children that fall below the threshold and are mostly links go.  Parsing and sifting are linear in
the page.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one line feed; a <br> is
white space.  Defined results: null, empty or text-free pages give the empty text; pages without any tag are one block; unclosed and
misnested tags are closed as browsers close them, as far as text goes; repeated rows each have a result; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"""<(?:!--(?P<comment>.*?(?:-->|\Z))|(?P<other>[!?][^>]*(?:>|\Z))|(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg annotation annotation-xml".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What an opening tag closes: itself and its likes, up to the element that holds them.
_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",)}
_HOLD = frozenset("ul ol dl table select article section div main body".split())
#: No main text by kind.
_DROPPED = frozenset("head nav footer aside form menu button select input label dialog object audio video canvas map".split()) | _RAW
#: No main text by class, id or role: what is besides it on any page, and what a layout may call the place of the main text too.
_BESIDES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promotions comment comments commentlist respond reply replies disqus cookie cookies consent gdpr newsletter subscribe subscription share sharing related recommended recommendations breadcrumb breadcrumbs popup modal pagination pager login signin signup register".split())
_LAYOUT = frozenset("banner sidebar menu nav navbar navigation footer notice notices notification notifications alert overlay social widget widgets toolbar complementary contentinfo dialog search masthead topbar".split())
#: Parts beside which such a word says something of another element.
_STATES = frozenset("has have with without no not non is hide hides hidden show shows free layout wrap wrapper container page site".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PARTS = re.compile(r"[^a-zA-Z0-9]+")
#: Parts of an article that such a name doesn't drop.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | {"p"}


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "doubtful", "articles", "depth", "block", "hold")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.children, self.dropped = tag, parent, [], dropped
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.doubtful = 0  # 1: a layout's name; 2: a part of a name; 3: a whole name of what is besides main text
        self.articles = 0 if parent is None else parent.articles + (parent.tag == "article")  # above it
        # How deep it lies, and the nearest block and the nearest element that holds list items and the like, itself included.
        self.depth = 0 if parent is None else parent.depth + 1
        self.block = self.depth if parent is None or tag in _BLOCK else parent.block
        self.hold = self.depth if parent is None or tag in _HOLD else parent.hold


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not inside):
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _doubtful(tag: str, attrs: str, inside: bool) -> int:
    if tag in ("html", "body", "main") or tag in _PROSE and inside or "=" not in attrs:
        return 0
    most = 0
    for name, *values in _ATTR.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for whole in "".join(values).split():
                parts = [p.lower() for p in _PARTS.split(_CAMEL.sub(" ", whole)) if p]
                if _STATES.isdisjoint(parts):
                    most = max([most, *(1 if p in _LAYOUT else 3 if len(parts) == 1 else 2 for p in parts if p in _LAYOUT or p in _BESIDES)])
    return most


_ENDS = {tag: re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I | re.A) for tag in _RAW}


def parse(page: str) -> Node:
    """The tree; text is kept as strings among the children."""
    root = Node("#root", None)
    node, at = root, 0
    opened: dict[str, list[Node]] = {}  # by name, the deepest last

    def close(last: Node) -> Node:
        """Ends all elements up to and with that one."""
        own = node
        while own is not last.parent:
            opened[own.tag].pop()
            own = own.parent
        return own

    def nearest(tags: tuple[str, ...]) -> Node | None:
        return max((opened[t][-1] for t in tags if opened.get(t)), key=lambda n: n.depth, default=None)

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not node.dropped:
            node.children.append(unescape(text))
        if m is None:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            own = nearest((tag,))
            if own is not None and (tag in _BLOCK or own.depth > node.block):  # an inline tag doesn't close blocks
                node = close(own)
            elif tag == "br" and not node.dropped:
                node.children.append(" ")
            continue
        if tag in _RAW:
            if m["attrs"].endswith("/") and tag == "svg":
                continue
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _CLOSES_P or tag in _LIKE:
            ends = _LIKE.get(tag, ()) + (("p",) if tag in _CLOSES_P else ())
            while (own := nearest(ends)) is not None and own.depth > node.hold:
                node = close(own)
                if own.tag == "p" or tag != "tr":
                    break
        if tag == "body" or tag == "html":
            if any(isinstance(c, Node) and c.tag == tag for c in (root.children if node is root else ())):
                continue
        if tag == "br":
            if not node.dropped:
                node.children.append(" ")
            continue
        inside = node.articles > 0 or node.tag == "article"
        own = Node(tag, node, node.dropped or _boilerplate(tag, m["attrs"], inside))
        if not own.dropped:
            own.doubtful = _doubtful(tag, m["attrs"], inside)
            node.children.append(own)
        if tag not in _VOID:
            node = own
            opened.setdefault(tag, []).append(own)
    return root


def _ordered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        own = todo.pop()
        out.append(own)
        todo += [c for c in own.children if isinstance(c, Node)]
    return out


def sift(root: Node) -> None:
    """Takes out doubtful elements but those that hold the main text (see above)."""
    nodes = _ordered(root)
    holds = set()  # what has an article, main or first heading inside that isn't doubtful itself
    for own in reversed(nodes):
        own.chars = sum(len("".join(c.split())) if isinstance(c, str) else c.chars for c in own.children)
        if any(isinstance(c, Node) and c.chars and (id(c) in holds or not c.doubtful and c.tag in ("article", "main", "h1")) for c in own.children):
            holds.add(id(own))
            if own.doubtful in (1, 2):
                own.doubtful = 0
        if own.doubtful:
            holds.discard(id(own))
    tops, articles, plain = [], 0, root.chars

    def open_up(own: Node) -> None:
        """Below a node that stays: which doubtful ones come first, and what they take away."""
        nonlocal articles, plain
        todo = [own]
        while todo:
            own = todo.pop()
            articles += own.tag == "article" and own.chars > 0
            for c in own.children:
                if isinstance(c, Node):
                    if c.doubtful:
                        heapq.heappush(tops, (-c.chars, len(tops), c))
                        plain -= c.chars
                    else:
                        todo.append(c)

    open_up(root)
    while tops:
        most = tops[0][-1]
        if most.chars <= plain or articles > most.articles or most.doubtful > 1 and plain:
            break
        heapq.heappop(tops)
        most.doubtful = 0
        plain += most.chars
        open_up(most)
    for own in nodes:
        own.chars = 0
        own.children = [c for c in own.children if isinstance(c, str) or not c.doubtful]


def trim_headers(root: Node) -> None:
    """Of an article's own header only the headings stay: its title is main text, what else stands there is not."""
    for own in _ordered(root):
        if own.tag == "header":
            found, todo = [], list(reversed(own.children))
            while todo:
                c = todo.pop()
                if isinstance(c, Node):
                    if c.tag in _HEADINGS:
                        found.append(c)
                    else:
                        todo += reversed(c.children)
            own.children = found


def measure(root: Node) -> list[Node]:
    """All nodes, parents before children, with their counts, densities and density sums."""
    nodes = _ordered(root)
    for own in reversed(nodes):
        for c in own.children:
            if isinstance(c, str):
                own.chars += len(c) - c.count(" ") - c.count("\n")
            else:
                own.chars += c.chars
                own.tags += c.tags + 1
                own.link_chars += c.link_chars
                own.link_tags += c.link_tags
        if own.tag == "a":
            own.link_chars, own.link_tags = own.chars, own.link_tags + 1
    share = root.link_chars / max(root.chars, 1)
    for own in nodes:
        if own.chars:
            plain = max(own.chars - own.link_chars, 1)
            base = math.log(own.chars / plain * own.link_chars + share * own.chars + math.e)
            ratio = own.chars / max(own.link_chars, 1) * max(own.tags, 1) / max(own.link_tags, 1)
            own.density = own.chars / max(own.tags, 1) * math.log1p(ratio) / math.log1p(base)
    for own in nodes:
        own.total = sum(c.density for c in own.children if isinstance(c, Node))
    return nodes


def _blocks(node: Node, threshold: float, top: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out, line = [], []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    up, article = top, False
    while up is not None and not article:
        article, up = up.tag in ("article", "main"), up.parent
    todo: list[tuple[Node | str | None, bool]] = [(node, True)]
    while todo:
        own, opening = todo.pop()
        if own is None:
            flush()
        elif isinstance(own, str):
            line.append(own)
        else:
            if not article and own.parent is top and own.tag in _BLOCK and own.density < threshold and 2 * own.link_chars > own.chars:
                continue
            if own.tag in _BLOCK:
                flush()
                todo.append((None, False))
            todo += [(c, True) for c in reversed(own.children)]
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    sift(root)
    trim_headers(root)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    within = _ordered(body)
    best = max(within, key=lambda n: n.total)
    if best.total == 0:
        best = body
    path, up = [], best
    while up is not None:
        path.append(up)
        if up is body:
            break
        up = up.parent
    threshold = min(n.density for n in path)
    for own in path:
        if own.tag == "article":
            best = own
    if best.tag != "article":  # an article with most of the text, in which no subtree stands out
        articles = [n for n in within if n.tag == "article" and 2 * n.chars > body.chars]
        best = articles[0] if articles and best in path[-1:] else best
        # Blocks before and after the densest subtree that are as dense as the path belong to it.
        while best is not body and best.parent is not None and best.parent.chars > best.chars and all(isinstance(c, str) or c.density >= threshold or c is best for c in best.parent.children) and 2 * best.parent.link_chars < best.parent.chars:
            best = best.parent
    return "\n".join(_blocks(best, threshold, best))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return common.map_frames(own, run, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract(common.read(spark, sf_dir, "pages"))
