"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, an ancestor's points
are discounted by its link density; the best container and those of its siblings that look
like part of the article are kept, without the boilerplate inside them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TO_THE_END = frozenset("script style textarea title xmp".split())  # without an end tag these hold the rest of the page
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - {'option', 'optgroup'}))})(?![^\s/>])", re.I)
CLOSES = {  # an opening element -> the open elements it ends, up to the elements that bound the search
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
SCOPES = frozenset("html table td th button object caption".split())  # a closing p does not look past these
CONTAINERS = frozenset("#root article aside blockquote body center div dd figure footer form header html li main nav ol section table td th tr ul".split())

# Elements that hold no article text, and names that say so.
BOILERPLATE = frozenset("nav footer aside form button menu dialog head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
UNLIKELY = frozenset(
    "ad ads advert adverts adbox adslot adsense banner promo promos promotion nav navbar navigation topnav menu menubar breadcrumb breadcrumbs sidebar side rail footer foot masthead topbar header "
    "comment comments commentlist disqus discussion reply replies respond review reviews cookie cookies consent gdpr notice notices alert popup modal overlay newsletter signup login share sharing social "
    "follow related widget pagination pager tags tagcloud skip toolbar copyright legal disclaimer search print rss form".split()
)
UNLIKELY_STARTS = ("advertis", "sponsor", "subscri", "recommend")
LIKELY = frozenset("article articlebody body content entry hentry main page post story text blog".split())
ABOUT_ANOTHER = frozenset("has with no without is js".split())  # "has-sidebar" says nothing about the element itself
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
UNENDED = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")


class Node:
    __slots__ = ("tag", "parent", "order", "unlikely", "pruned", "likely", "points", "chars", "links", "blocks")

    def __init__(self, tag: str, parent: Node | None, order: int, unlikely: bool, likely: bool, pruned: bool) -> None:
        self.tag, self.parent, self.order, self.unlikely, self.likely, self.pruned = tag, parent, order, unlikely, likely, pruned
        self.points, self.chars, self.links = 0.0, 0, 0
        self.blocks: list[str] = []


def marks(tag: str, attributes: str, parent: Node | None) -> tuple[bool, bool]:
    """(is boilerplate by name, is article-like by name)."""
    if tag in BOILERPLATE:
        return True, False
    unlikely = likely = sure = False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), a or b or c
        if hidden or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, False
        if name == "role":
            unlikely |= value.lower() in ROLES
            sure |= value.lower() in ("main", "article")
        elif name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in NAME_WORDS.findall(token)]
                if not words or words[0] in ABOUT_ANOTHER:
                    continue
                bad = [w in UNLIKELY or w.startswith(UNLIKELY_STARTS) for w in words]
                good = [w in LIKELY for w in words]
                unlikely |= bad[-1] or (any(bad) and not any(good))  # the last word is what it is
                likely |= any(good)
                sure |= all(good)
        elif name == "itemprop" and value == "articleBody":
            sure = True
    if tag in ("article", "main"):
        sure = True
    if tag in ("html", "body"):
        return False, False
    if tag == "header" or (unlikely and re.search("header", attributes, re.I)):  # the article's own header is part of it
        inside = parent
        while inside is not None and inside.tag not in ("article", "main"):
            inside = inside.parent
        return inside is None, False
    if tag == "article" and unlikely:  # a reader's comment may be an article element
        sure = False
    return unlikely and not sure, likely or sure


def element_ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a name end, by where they begin; nested ones are paired, unclosed ones left out."""
    opened, out = [], {}
    for m in re.compile(rf"<(/?){re.escape(tag)}(?![^\s/>])[^>]*>", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def next_block(page: str, at: int) -> int:
    """Where an element without an end stops at the latest: before the next block's tag."""
    m = BLOCK_TAG.search(page, at)
    return m.start() if m else len(page)


def blocks_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Nodes in page order and text blocks (nearest block element, text, link characters).

    The tree is made in one pass with an explicit stack: elements end where HTML lets their
    end tag be left out, stray end tags are ignored, unclosed elements end with the page.
    Elements without text of the article (``RAW``) are passed over; one that is never
    closed ends at the next block, but for scripts and the like, which have no markup inside.
    """
    root = Node("#root", None, 0, False, False, False)
    nodes, stack, out = [root], [root], []
    text: list[str] = []
    linked = 0
    opened: Counter[str] = Counter()  # elements open now, so that no search walks the stack in vain

    def holder() -> Node:
        for node in reversed(stack):
            if node.tag in BLOCKS:
                return node
        return root

    def end_block() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            out.append((holder(), whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    def close_to(index: int) -> None:
        opened.subtract(node.tag for node in stack[index:])
        del stack[index:]

    def find(tags: tuple[str, ...], bounds: frozenset | tuple) -> int | None:
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in tags) else ():
            if stack[k].tag in tags:
                return k
            if stack[k].tag in bounds:
                return None
        return None

    ends: dict[str, dict[int, int]] = {}
    at, size = 0, len(page)
    last = page.rfind(">") + 1  # a tag that never ends is left out
    while at < size:
        m = MARKUP.search(page, at, last)
        piece = page[at : m.start()] if m else UNENDED.split(page[at:], maxsplit=1)[0]
        if piece:
            plain = html.unescape(piece) if "&" in piece else piece
            text.append(plain)
            if opened["a"]:
                linked += len(plain.strip())
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag in BLOCKS:
                end_block()
            k = find((tag,), ("table",) if tag not in ("table", "html", "body") and tag in BLOCKS else () if tag in BLOCKS else BLOCKS)
            if k is not None:
                close_to(k)
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if tag in TO_THE_END:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            elif not attributes.rstrip().endswith("/"):
                if tag not in ends:
                    ends[tag] = element_ends(page, tag)
                at = ends[tag].get(m.start()) or next_block(page, at)
            continue
        if tag in BLOCKS:
            end_block()
            k = find(("p",), SCOPES)
            if k is not None:
                close_to(k)
            if tag in CLOSES:
                k = find(*CLOSES[tag])
                while k is not None:
                    close_to(k)
                    k = find(*CLOSES[tag])
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close_to(len(stack) - 1)
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        parent = stack[-1]
        unlikely, likely = marks(tag, attributes, parent)
        node = Node(tag, parent, len(nodes), unlikely, likely, parent.pruned or unlikely)
        if unlikely and tag not in BLOCKS:  # inline boilerplate ends the running text
            end_block()
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    end_block()
    return nodes, out


def main_blocks(page: str | None) -> list[str]:
    """The article's blocks in page order."""
    nodes, blocks = blocks_of(page or "")
    kept = [(node, text, linked) for node, text, linked in blocks if not node.pruned]
    if not kept:
        return []
    for node, text, linked in kept:
        node.chars += len(text)
        node.links += linked
        if len(text) >= 25:
            points = 1 + min(text.count(",") + text.count("、") + text.count("，"), 10) + min(len(text) / 100, 3)
            part: Node | None = node
            for share in (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12):
                while part is not None and part.tag not in CONTAINERS:
                    part = part.parent
                if part is None:
                    break
                part.points += points * share
                part = part.parent
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links

    def worth(node: Node) -> float:
        base = node.points * (1.25 if node.likely else 1.0) + (25 if node.tag in ("article", "main") and node.chars else 5 if node.likely and node.points else 0)
        return base * (1 - node.links / max(node.chars, 1))

    held = [n for n in nodes if n.chars and not n.pruned and n.tag in CONTAINERS]
    best = max(held, key=lambda n: (worth(n), -n.order))
    level = max(10.0, 0.2 * worth(best))
    inside: dict[int, bool] = {}

    def part_of(node: Node) -> bool:
        path = []
        up: Node | None = node
        while up is not None and up.order not in inside:
            path.append(up)
            if up is best:
                break
            up = up.parent
        found = up is not None and (up is best or inside.get(up.order, False))
        for n in reversed(path):
            if not found and n.parent is best.parent and n is not best:
                found = n.tag in CONTAINERS and worth(n) >= level and n.links <= 0.25 * n.chars
            inside[n.order] = found
        return found

    out = []
    for node, text, linked in kept:
        sibling = node.parent is best.parent and node is not best and node.tag == "p" and len(text) >= 80 and linked <= 0.25 * len(text)
        if part_of(node) or sibling or (node is best):
            out.append(text)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [" ".join(main_blocks(p)) for p in b.column("html").to_pylist()]
        names = [n for n in b.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    ``text``: the blocks of the main container, character references decoded, white space
    inside a block one space, blocks joined by one space; empty for a null or empty page and
    a page without article text.  ``n_chars`` counts code points.  Pages are read whole;
    equal rows give equal rows; ids may be null or repeat; other columns are not read; an
    empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
