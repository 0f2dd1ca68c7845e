"""Main text of web pages by composite text density.

The page becomes a tree of elements.  Each node has characters, tags, link characters and link tags below it; its
density is characters per tag, adjusted by the share of links, and its density sum is the sum over its children.  The
subtree of the highest sum is the core.  The lowest density on the path from the body to the core is the threshold.  The
core takes in what surrounds it while that hardly links and is little, or in one article with it, or as dense as the
whole page with its furniture; beside the path to the body, siblings as dense as the threshold are text as well, and headings before the core are titles.

Names only weigh.  Elements whose tag, class, id or role speaks of furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) are left out of all densities, unless they hold half of the page's text that is not
links and its first heading, if it has one, or nine tenths of it: those are wrappers.  Names of comments need nine tenths.

Defined results: null and empty pages, and pages without text, give an empty string; broken markup is read as browsers
do in the main (unclosed and stray tags); very long pages are read whole, in time that grows with their length; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Names of HTML elements by their role in the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that have no text of the page, and elements that are furniture by their standard meaning.
SILENT = frozenset("script style noscript template head title button select textarea input iframe object embed svg canvas audio video noembed noframes option datalist".split())
ROLES = frozenset("nav footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: What a start tag closes if it is open, and the elements that keep it from reaching further out.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
# Words in class, id or role that speak of furniture, of comments, of states of a page, and of an article's own parts.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices alert alerts gdpr sidebar sidebars side menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer share sharing social related recommended newsletter subscribe signup popup modal overlay pagination pager toolbar widget search login complementary contentinfo dialog".split()
)
COMMENTS = frozenset("comment comments replies reply respond responses disqus".split())
STATES = frozenset("has with no not without open closed enabled disabled off is layout".split())
ARTICLE_PARTS = frozenset("entry post article story content".split())
#: Shares of the page's text beyond which a named element is a wrapper, and of link characters and own size up to which the core takes in what surrounds it.
WRAPS, NEARLY_ALL, LINKED, LITTLE = 0.5, 0.9, 1 / 3, 0.5
PLAIN, FURNISHED, COMMENTED, SILENCED = range(4)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.IGNORECASE)


class Node:
    __slots__ = ("name", "kids", "parent", "kind", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, kind: int = PLAIN):
        self.name, self.parent, self.kind, self.dropped = name, parent, kind, False
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def kind_of(name: str, attributes: str, inside_article: bool) -> int:
    """What an element's names say of it."""
    if name in SILENT or (attributes and _HIDDEN.search(attributes)):
        return SILENCED
    found = FURNISHED if name in ROLES or (name == "header" and not inside_article) else PLAIN
    if attributes and name not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            for token in next(filter(None, m.groups()), "").split():
                parts = {x.lower() for x in _PARTS.split(token)}
                if parts & STATES:
                    continue
                if parts & COMMENTS:
                    return COMMENTED
                if parts & FURNITURE and not (parts & FURNITURE == {"header"} and parts & ARTICLE_PARTS):
                    found = FURNISHED
    return found


class Tags:
    """Reads a page from one tag to the next; never looks at a part of it again, whatever is broken."""

    def __init__(self, page: str):
        self.page, self.place = page, 0
        self.quotes = True  # until quotes lead to the page's end

    def close(self, at: int) -> int:
        """The place of the tag's end; quoted values may hold one."""
        page, k = self.page, at
        while self.quotes:
            m = _ATTRIBUTE.search(page, k)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                end = page.find(m[1], m.end())
                k = m.end() if end < 0 else end + 1
        return page.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str, str]]:
        """(text before, slash of an end tag, name, attributes); the last one has no name."""
        page, held = self.page, self.place
        ends = comments = True  # whether there may be further ends of tags and comments
        while True:
            at = page.find("<", self.place) if ends else -1
            if at < 0:
                yield page[held:], "", "", ""
                return
            if page.startswith("<!--", at):
                text, end = page[held:at], page.find("-->", at + 4) if comments else -1
                comments = end >= 0
                self.place = held = end + 3 if comments else len(page)
                if text:
                    yield text, "", "!", ""
                continue
            slash = "/" if page.startswith("/", at + 1) else ""
            m = _NAME.match(page, at + 1 + len(slash))
            if m is None:
                if page[at + 1 : at + 2] in ("!", "?", "/"):
                    end = page.find(">", at)
                    if end < 0:
                        ends = False
                        continue
                    text, self.place = page[held:at], end + 1
                    held = self.place
                    if text:
                        yield text, "", "!", ""
                else:
                    self.place = at + 1
                continue
            end = self.close(m.end())
            if end < 0:
                ends = False
                continue
            text, self.place = page[held:at], end + 1
            yield text, slash, m[0].lower(), page[m.end() : end]
            held = self.place

    def skip_raw(self, name: str) -> None:
        """Goes behind the end tag of an element whose content is no markup."""
        m = re.compile(f"</{name}", re.IGNORECASE | re.ASCII).search(self.page, self.place)
        end = self.page.find(">", m.end()) if m else -1
        self.place = end + 1 if end >= 0 else len(self.page)


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings with their references decoded."""
    root = at = Node("#root", None)
    article, tags = 0, Tags(page)
    open_: Counter[str] = Counter()

    def leave(until: Node) -> None:
        """Closes all that is open up to a node, that one too."""
        nonlocal at, article
        while True:
            done = at
            at = done.parent
            article -= done.name in ("article", "main")
            open_[done.name] -= 1
            if done is until:
                return

    for text, slash, name, attributes in tags:
        if text:
            at.kids.append(html.unescape(text) if "&" in text else text)
        if not name or name == "!":
            continue
        if slash:
            if not open_[name]:
                if name in ("br", "p"):
                    at.kids.append(Node(name, at))
                continue
            node = at
            while node.name != name and (name in BLOCK or node.name not in BLOCK):
                node = node.parent
            if node.name == name:  # an inline end tag does not close blocks
                leave(node)
            continue
        if open_["p"] and name in BLOCK and name not in ("html", "body"):
            for x in _ancestors(at):  # a block ends an open paragraph
                if x.name == "p":
                    leave(x)
                    break
                if x.name in BLOCK or x.name == "button":
                    break
        if name in CLOSES and any(open_[x] for x in CLOSES[name][0]):
            closed, kept = CLOSES[name]
            last = None
            for x in _ancestors(at):
                if x.name in kept:
                    break
                if x.name in closed:
                    last = x
            if last is not None:
                leave(last)
        if name == "body":
            if open_["body"]:
                continue
            if at is not root and at.name != "html":  # an unclosed head ends here
                top = at
                while top.parent is not root and top.parent.name != "html":
                    top = top.parent
                leave(top)
        node = Node(name, at, kind_of(name, attributes, article > 0))
        at.kids.append(node)
        if name in RAW:
            tags.skip_raw(name)
        elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "path")):
            article += name in ("article", "main")
            open_[name] += 1
            at = node
    return root


def _ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        yield node
        node = node.parent


def own_chars(node: Node) -> int:
    return sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))


def in_order(root: Node) -> list[Node]:
    """All nodes that are not dropped, each before those below it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node) and not k.dropped]
    return order


def furnish(root: Node) -> float:
    """Marks as dropped what has no text of the page, and what is furniture by name and no wrapper by what it holds.

    Returns the page's characters per tag before furniture goes.
    """
    every, stack, size = [], [(root, False)], 0
    while stack:
        node, in_link = stack.pop()
        node.dropped = node.kind == SILENCED
        if node.dropped:
            continue
        in_link = in_link or node.name == "a"
        every.append(node)
        size += (own := own_chars(node))
        node.chars = 0 if in_link else own  # for now: characters that are not links
        stack += [(k, in_link) for k in node.kids if isinstance(k, Node)]
    heading = next((n for n in every if n.name == "h1"), None)
    above = set(map(id, _ancestors(heading))) if heading is not None else set(map(id, every))
    for node in reversed(every):
        if node.parent is not None:
            node.parent.chars += node.chars
    whole = root.chars
    for node in every:
        if node.kind != PLAIN:
            wraps = node.kind == FURNISHED and node.chars >= WRAPS * whole and id(node) in above
            node.dropped = not whole or not (wraps or node.chars >= NEARLY_ALL * whole)
    for node in every:
        node.chars = 0
    return size / max(len(every) - 1, 1)


def measure(root: Node) -> tuple[list[Node], float]:
    """Fills in what each node that is not furniture holds; returns these nodes, each before those below it, and the page's characters per tag."""
    page = furnish(root)
    order = in_order(root)
    linked: set[int] = set()
    for node in order:
        if node.name == "a" or (node.parent is not None and id(node.parent) in linked):
            linked.add(id(node))
    for node in reversed(order):
        node.chars += own_chars(node)
        if id(node) in linked:
            node.link_chars = node.chars
            node.link_tags += 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole = next((n for n in order if n.name == "body"), root)
    share = whole.link_chars / whole.chars if whole.chars else 0.0
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        node.total = sum(k.density for k in node.kids if isinstance(k, Node) and not k.dropped)
    return order, page


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, on a logarithm whose base grows with the share of link characters."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    rest = max(chars - link_chars, 1)
    base = math.log(chars / rest * link_chars + share * chars + math.e)
    value = chars / links * tags / link_tags
    return chars / tags * (math.log(value) / math.log(base) if base > 1 else math.log(value)) if value > 1 else 0.0


def takes_in(core_: Node, up: Node, page: float) -> bool:
    """Whether what a parent holds beside the core hardly links, and is little, in one article with it, or as dense as the page."""
    chars, tags = up.chars - core_.chars, up.tags - core_.tags - 1
    if not chars:
        return True
    return up.link_chars - core_.link_chars <= LINKED * chars and (chars <= LITTLE * core_.chars or chars / max(tags, 1) >= page or any(x.name in ("article", "main") for x in _ancestors(up)))


def core(root: Node) -> list[Node | str]:
    """The nodes and texts that are the page's, in page order."""
    order, page = measure(root)
    body = next((n for n in order if n.name == "body"), root)
    if not body.chars:
        return []
    best = max((n for n in order if n.chars), key=lambda n: n.total)
    if not best.total:
        return [body]
    path = list(_ancestors(best))
    inner = path[: path.index(body) + 1] if body in path else path
    threshold = min((n.density for n in inner), default=0.0)
    while best is not body and best.parent is not None and best.parent is not body and best.parent is not root and takes_in(best, best.parent, page):
        best = best.parent
    found: list[Node | str] = [best]
    at = best
    while at is not body and at.parent is not None:
        place = next(k for k, x in enumerate(at.parent.kids) if x is at)
        before = [k for k in at.parent.kids[:place] if joins(k, threshold, True)]
        found = [*before, *found, *(k for k in at.parent.kids[place + 1 :] if joins(k, threshold, False))]
        at = at.parent
    return found


def joins(part: Node | str, threshold: float, before: bool) -> bool:
    """Whether a sibling on the way to the body is text too: as dense, or a title before the core; loose text counts as one tag."""
    if isinstance(part, str):
        return len("".join(part.split())) >= max(threshold, 1)
    if part.dropped or not part.chars:
        return False
    return part.density >= threshold or (before and part.name in HEADINGS and part.link_chars < part.chars)


def blocks(nodes: list[Node | str]) -> Iterator[str]:
    """Texts of blocks, white space turned into single blanks."""
    parts: list[str] = []

    def flush() -> Iterator[str]:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            yield text

    for top in nodes:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            x, leaving = stack.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            if leaving:
                yield from flush()
                continue
            if x.dropped:
                if x.name in BLOCK:
                    yield from flush()
                else:
                    parts.append(" ")
                continue
            if x.name == "br":
                parts.append(" ")
                continue
            if x.name in BLOCK:
                yield from flush()
                stack.append((x, True))
            stack += [(k, False) for k in reversed(x.kids)]
        yield from flush()


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(core(parse(page)))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars: one row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
