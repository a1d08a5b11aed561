"""Main text of web pages by composite text density.

A page is read into a tree of its block elements (inline markup and line breaks belong to the block around them).
Elements that are never article text go first, by tag (menus, headers, footers, sidebars, forms, scripts ...) and by
role. Words of class and id (adverts, notices, reader comments ...) are hints only: of the elements that have one, from
small to large, each goes unless it holds most of the text outside of links that is then left; such an element stays and
its density decides, but if an `article` or `main` element beside it holds most of the text without hints, it goes, too.
Words behind no, with, has and the like (no-sidebar, has-header) are no hints. For every remaining block, with C characters,
T tags, LC link characters and LT link tags in its subtree, and C_b, LC_b those of the body, the composite density is

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e)

where a divisor of 0 counts as 1. The subtree with the largest sum of its children's densities is the core; it is
widened along the path to the body as long as the parent is at least as dense as the body (the path's threshold) and
what the parent adds is mainly not links. An `article` or `main` element that holds most of the text stands in for the
body.

Defined cases: a null or empty page, or one without text outside of the removed elements, gives an empty text; broken
markup is read as browsers do in outline (unclosed elements end with their parents, a block ends an open paragraph, an
unclosed comment or script runs to the end); null page_id and url stay null; repeated rows give repeated rows; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the closing tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset(
    "head nav header footer aside form menu dialog button select option input svg math canvas audio video object embed "
    "map script style textarea title noscript iframe noembed noframes template figcaption".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets comment comments disqus replies "
    "respond cookie cookies consent gdpr notice notices notification banner popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations pagination pager toolbar "
    "copyright legal disclaimer".split()
)
#: What follows one of these in a name tells of the layout, not of the element.
LAYOUT_WORDS = frozenset("no non not without with has have hide".split())
#: A new one of these ends an open one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS |= {"option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
#: Where the search for an element to end stops.
SCOPES = frozenset("table ul ol dl body html article main section div td th".split())

_MARKUP = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """A block element: children are blocks and (text, link text length, links) runs, in page order."""

    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Block | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _hinted(names: str) -> bool:
    """Whether a name in a class or id has a dropped word that no layout word precedes."""
    for name in names.split():
        for word in _WORD.findall(_CAMEL.sub(" ", name).lower()):
            if word in LAYOUT_WORDS:
                break
            if word in DROPPED_WORDS:
                return True
    return False


def _unwanted(tag: str, attributes: str) -> str:
    """"never": never article text; "hint": a word of class or id says so; else empty."""
    if tag in DROPPED:
        return "never"
    if not attributes or tag in ("html", "body", "main", "article"):
        return ""
    hint = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "never"
        if name == "role" and value.lower() in DROPPED_ROLES:
            return "never"
        if name in ("class", "id") and _hinted(value):
            hint = "hint"
    return hint


class Hints:
    """The elements of a page with a hint, and the characters outside of links in them, beside them and in articles."""

    def __init__(self):
        # Of each element: its place in the page, the element and the article around it, its own characters.
        self.places, self.around, self.article, self.chars = [], [], [], []
        self.open: list[tuple[int, str, int]] = []
        self.levels: dict[str, int] = {}
        self.last: dict[str, list[int]] = {}
        self.plain = 0
        self.articles: list[list[int]] = []  # [article around it, characters without a hint]
        self.open_articles: list[tuple[int, str]] = []

    def meet(self, tag: str, closing: bool) -> None:
        """Every tag outside of removed elements: an element ends as a removed one does."""
        level = self.levels[tag] = self.levels.get(tag, 0) + (-1 if closing else 1)
        if closing and tag in ("body", "html") or not closing and tag in ("article", "main"):
            self._end(0)
        elif closing:
            held = self.last.get(tag)
            while held and self.open[held[-1]][2] > level:
                self._end(held[-1])
        if tag in ("article", "main"):
            if not closing:
                self.open_articles.append((len(self.articles), tag))
                self.articles.append([self.open_articles[-2][0] if len(self.open_articles) > 1 else -1, 0])
            elif any(t == tag for _, t in self.open_articles):
                while self.open_articles.pop()[1] != tag:
                    pass

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            self.last[self.open.pop()[1]].pop()

    def begin(self, tag: str, place: int) -> None:
        self.around.append(self.open[-1][0] if self.open else -1)
        self.article.append(self.open_articles[-1][0] if self.open_articles else -1)
        self.last.setdefault(tag, []).append(len(self.open))
        self.open.append((len(self.places), tag, self.levels[tag]))
        self.places.append(place)
        self.chars.append(0)

    def say(self, chars: int) -> None:
        if self.open:
            self.chars[self.open[-1][0]] += chars
            return
        self.plain += chars
        if self.open_articles:
            self.articles[self.open_articles[-1][0]][1] += chars

    def removed(self) -> frozenset[int]:
        """The places of the elements to remove."""
        left = self.plain + sum(self.chars)
        for i in reversed(range(len(self.places))):
            if self.around[i] >= 0:
                self.chars[self.around[i]] += self.chars[i]
        for i in reversed(range(len(self.articles))):
            if self.articles[i][0] >= 0:
                self.articles[self.articles[i][0]][1] += self.articles[i][1]
        # The innermost article with most of the text without hints.
        lead = max((i for i, (_, chars) in enumerate(self.articles) if 2 * chars > self.plain), default=-1)
        gone = set()
        # Inner elements come before those around them.
        for i in sorted(range(len(self.places)), key=lambda i: (self.chars[i], -i)):
            article = self.article[i]
            while article > lead:
                article = self.articles[article][0]
            if 2 * self.chars[i] > left and (lead < 0 or article == lead):
                continue
            own, around = self.chars[i], i
            left -= own
            while around >= 0:
                self.chars[around] -= own
                around = self.around[around]
            gone.add(self.places[i])
        return frozenset(gone)


def parse(page: str) -> Block:
    """The block tree of a page, without the elements that are not article text."""
    root = _read(page, frozenset(), hints := Hints())
    removed = hints.removed()
    return _read(page, removed, None) if removed else root


def _read(page: str, removed: frozenset[int], hints: Hints | None) -> Block:
    """The block tree of a page without the elements at the places `removed`; `hints` are gathered if asked for."""
    root = node = Block("#page", None)
    text: list[str] = []
    link_depth, link_chars, links = 0, 0, 0
    # While inside a removed element: its tag and how many of that tag are open.
    gone, depth = "", 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal text, link_chars, links
        joined = " ".join("".join(text).split())
        if joined or links:
            node.children.append((joined, min(link_chars, len(joined)), links))
        text, link_chars, links = [], 0, 0

    def say(raw: str) -> None:
        nonlocal link_chars
        decoded = html.unescape(raw) if "&" in raw else raw
        text.append(decoded)
        if link_depth:
            link_chars += len("".join(decoded.split()))
        elif hints is not None:
            hints.say(len("".join(decoded.split())))

    def unwanted(tag: str, attributes: str, place: int, single: bool) -> bool:
        found = _unwanted(tag, attributes)
        if found == "hint" and hints is not None and not single:
            hints.begin(tag, place)
        return found == "never" or found == "hint" and (place in removed or single)

    while at < n:
        match = _MARKUP.search(page, at)
        if match is None:
            if not gone:
                say(page[at:])
            break
        if not gone and match.start() > at:
            say(page[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        closing, tag = bool(match[1]), name.lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if gone:
            if tag == gone:
                depth += -1 if closing else 1
                if depth == 0:
                    gone = ""
            elif closing and tag in ("body", "html") or gone != "head" and tag in ("article", "main") and not closing:
                gone, depth = "", 0  # a removed element that never ended
            elif gone == "head" and tag == "body":
                gone, depth = "", 0
            if gone or tag not in ("article", "main", "body"):
                continue
        if hints is not None:
            hints.meet(tag, closing)
        if tag in INLINE:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1))
                links += not closing
            if tag == "br":
                text.append(" ")
            elif not closing and tag not in VOID and unwanted(tag, match[3], match.start(), False):
                gone, depth = tag, 1
            continue
        if closing:
            other = node
            while other is not None and other.tag != tag:
                other = other.parent
            if other is not None and other.parent is not None:
                flush()
                node, link_depth = other.parent, 0
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        link_depth = 0
        single = match[3].rstrip().endswith("/")
        if unwanted(tag, match[3], match.start(), single):
            if not single:
                gone, depth = tag, 1
            continue
        # A block ends an open paragraph or heading; list items, cells and rows end their like.
        ends = ENDS.get(tag, frozenset())
        other = node
        while other.parent is not None:
            if other.tag in ends or other.tag == "p":
                node = other.parent
            elif other.tag in SCOPES and other.tag not in ends:
                break
            other = other.parent
        node.children.append(block := Block(tag, node))
        node = block
    flush()
    return root


def _measure(node: Block) -> list[Block]:
    """Fill in the counts, children before parents; returns all blocks in that order."""
    order, stack = [], [node]
    while stack:
        current = stack.pop()
        order.append(current)
        stack += [c for c in current.children if isinstance(c, Block)]
    order.reverse()
    for block in order:
        for child in block.children:
            if isinstance(child, Block):
                block.chars += child.chars
                block.tags += child.tags + 1
                block.link_chars += child.link_chars
                block.link_tags += child.link_tags
            else:
                block.chars += len(child[0])
                block.tags += child[2]
                block.link_chars += child[1]
                block.link_tags += child[2]
    return order


def _density(block: Block, body: Block) -> float:
    chars, linked = block.chars, block.link_chars
    if chars == 0:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + body.link_chars / max(body.chars, 1) * chars + math.e)
    ratio = chars / max(linked, 1) * max(block.tags, 1) / max(block.link_tags, 1)
    # A base of 1 (ln e) means no link anywhere: plain characters per tag.
    return chars / max(block.tags, 1) * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1.0001 else 1.0)


def _texts(block: Block) -> list[str]:
    out: list[str] = []
    stack: list = [block]
    while stack:
        current = stack.pop()
        if isinstance(current, Block):
            stack += reversed(current.children)
        elif current[0]:
            out.append(current[0])
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by a line feed."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    if root.chars == 0:
        return ""
    body = next((b for b in order if b.tag == "body"), root)
    if 2 * body.chars < root.chars:
        body = root
    holders = [b for b in order if b.tag in ("article", "main") and 2 * b.chars > body.chars]
    if holders:
        body = min(holders, key=lambda b: b.chars)
    inside, blocks = body, []
    stack = [inside]
    while stack:
        current = stack.pop()
        blocks.append(current)
        stack += [c for c in current.children if isinstance(c, Block)]
    for block in blocks:
        block.density = _density(block, body)
    for block in blocks:
        block.total = sum(c.density for c in block.children if isinstance(c, Block))
    core = max(blocks, key=lambda b: b.total) if len(blocks) > 1 else body
    while core is not body:
        parent = core.parent
        added, linked = parent.chars - core.chars, parent.link_chars - core.link_chars
        if parent.density < body.density or 2 * linked > added:
            break
        core = parent
    return "\n".join(_texts(core))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # One page at a time becomes a Python string.
        texts = [main_text(page.as_py()) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(rows, _extracted, "page_id long, url string, text string, n_chars long")
