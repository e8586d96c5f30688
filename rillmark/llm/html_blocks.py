"""Main text of a page from flat text blocks, classified by a small decision tree.

A page is flattened to blocks at block-level tags. A block knows its words and its link density, and both
for its neighbours; weaker signs are whether it stands in an article element, in an element for
boilerplate, or in one whose class or id is named like boilerplate. A decision tree, grown here by Gini
impurity from `TABLE`, a small table labelled by hand, tells text from boilerplate.

The parser is linear in the page: it looks at each character a fixed number of times, and every open element
carries what its ancestors are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text

# fixed values: tags by what they mean for blocks
_DROPPED = frozenset("script style noscript template svg iframe object canvas head title select option textarea button".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
_MAIN_TAGS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag of the first kind ends an open element of the second
_ENDS = {"li": ("li",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
# names of classes, ids and roles for what is no article: a whole one, or one among words that only say which or where
_NAMED = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related share social comment comments reply replies respond disqus footer header subscribe newsletter login copyright".split())
# these are no part of an article even inside it
_READER = frozenset("comment comments reply replies respond disqus".split())
_ADVERT = frozenset("ad ads advert adverts advertisement sponsored promo".split())
_BEHIND = frozenset("area bar block body box btn button buttons col column container content dialog entry form group grid icons inner item items left line link links list main message meta outer overlay panel primary right row secondary section slot space text thread title toggle top bottom tree unit view widget wrap wrapper".split())
_BEFORE = frozenset("bottom global left main right site top user reader".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^-_\sA-Za-z\d]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    main: bool
    boiler: bool
    named: bool


class Place(NamedTuple):
    """What the ancestors of a piece of text are."""

    dropped: bool = False
    heading: bool = False
    main: bool = False
    boiler: bool = False
    named: bool = False


def _attributes(text: str) -> dict[str, str]:
    """An opening tag's attributes; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def _meant(token: str) -> str:
    """What a class or id is named for: itself, or the one word of it that all the others only say more of (`comment-list`, `site-footer`, `ad-3`)."""
    words = [w.lower() for w in _WORDS.findall(token)]
    for i, word in enumerate(words):
        if word in _NAMED and all(w in _BEFORE for w in words[:i]) and all(w in _BEHIND or w in _NAMED or w.isdigit() for w in words[i + 1 :]):
            return word
    return ""


def _names(attributes: dict[str, str]) -> set[str]:
    tokens = (x for name in ("class", "id", "role") for x in attributes.get(name, "").split())
    return {_meant(x) for x in tokens} - {""}


def _inside(outer: Place, tag: str, text: str) -> Place:
    """The place of what an element contains. Inside an article its own header is part of it, and names other than those of comments and adverts mean nothing.

    What a whole page is named says nothing of its parts.
    """
    attributes = _attributes(text) if text else {}
    if outer.dropped or tag in _DROPPED or _hidden(attributes):
        return outer._replace(dropped=True)
    names = _names(attributes) if tag not in ("html", "body") else set()
    boiler = outer.boiler or tag in _BOILER_TAGS or (tag == "header" and not outer.main) or bool(names & _READER) or (outer.main and bool(names & _ADVERT))
    if tag in _MAIN_TAGS:
        return outer._replace(main=not boiler, boiler=boiler, named=False)
    named = outer.named or (not outer.main and bool(names))
    return outer._replace(heading=outer.heading or tag in _HEADINGS, boiler=boiler, named=named)


@dataclass
class _Open:
    tag: str
    outer: Place  # what holds again when it is closed


def blocks_of(html: str | None) -> list[Block]:
    """The page's text blocks in page order; white space inside a block is one space, empty blocks are none.

    As in browsers, a comment or tag that is never closed takes the rest of the page with it, and `<`
    before anything but a letter, `/`, `!` or `?` is text.
    """
    if not html:
        return []
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    here, in_link = Place(), False

    def close_block() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(text.split()), len(unescape("".join(linked)).split()), here.heading, here.main, here.boiler, here.named))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text and not here.dropped:
            parts.append(text)
            if in_link:
                linked.append(text)

    def pop() -> Place:
        top = stack.pop()
        opened[top.tag] -= 1
        return top.outer

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        name = _NAME.match(html, lt + 1)
        if not name and html[lt + 1 : lt + 2] not in ("/", "!", "?"):
            add(html[at : lt + 1])
            at = lt + 1
            continue
        add(html[at:lt])
        if not name:
            close = "-->" if html.startswith("<!--", lt) else ">"
            end = html.find(close, lt + (4 if close == "-->" else 2))
            at = end + len(close) if end >= 0 else n
            continue
        end = name.end()
        while (m := _INSIDE.search(html, end)) and m[0] != ">":
            end = m.end()
        if not m:
            break
        attributes, at = html[name.end() : m.start()], m.end()
        tag, closing = name[1].lower(), html[lt + 1] == "/"
        if tag == "br":
            add(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            close_block()
        if closing:
            if tag == "a":
                in_link = False
            if opened[tag]:
                while True:
                    found = stack[-1].tag == tag
                    here = pop()
                    if found:
                        break
            continue
        if tag in _RAW:  # its content is no markup
            raw = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            shut = html.find(">", raw.start()) if raw else -1
            at = shut + 1 if shut >= 0 else n
            continue
        if tag == "a":
            in_link = True
        if tag in _VOID or attributes.endswith("/"):
            continue
        if inline:
            if not attributes or not _hidden(_attributes(attributes)):
                continue
        else:
            in_link = in_link and tag not in ("p", "li", "tr", "td", "th", "dd", "dt")
            if stack and stack[-1].tag == "p":
                here = pop()
            while stack and stack[-1].tag in _ENDS.get(tag, ()):
                here = pop()
        stack.append(_Open(tag, here))
        opened[tag] += 1
        here = _inside(here, tag, attributes)
    close_block()
    return out


NAMES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density", "heading", "main", "beside", "boiler", "named")


def rows_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """A row of NAMES for each block; beyond the page's ends stand blocks of no words. beside: the page has an article, elsewhere."""
    some_main = any(b.main for b in blocks)
    shape = [(float(b.words), b.linked / b.words) for b in blocks]
    around = [(0.0, 0.0), *shape, (0.0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], float(b.heading), float(b.main), float(some_main and not b.main), float(b.boiler), float(b.named)) for i, b in enumerate(blocks)]


# Labelled by hand: words and link density of the block, of the one before and the one behind; heading, main, beside, boiler,
# named; and 1 for text, 0 for boilerplate. Fixed values.
TABLE: tuple[tuple[tuple[float, ...], int], ...] = (
    # paragraphs of pages that name no article
    ((90, 0, 40, 0, 60, 0, 0, 0, 0, 0, 0), 1),
    ((45, 0.1, 4, 0, 80, 0, 0, 0, 0, 0, 0), 1),
    ((30, 0.2, 60, 0, 3, 0, 0, 0, 0, 0, 0), 1),
    ((24, 0, 0, 0, 25, 0, 0, 0, 0, 0, 0), 1),
    ((35, 0.3, 2, 1, 50, 0, 0, 0, 0, 0, 0), 1),
    ((60, 0, 80, 0, 3, 1, 0, 0, 0, 0, 0), 1),
    ((28, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0), 1),
    ((22, 0, 40, 0, 2, 1, 0, 0, 0, 0, 0), 1),
    ((12, 0, 20, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((9, 0, 60, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((25, 0, 6, 1, 0, 0, 0, 0, 0, 0, 0), 1),
    ((120, 0.05, 1, 1, 2, 1, 0, 0, 0, 0, 0), 1),
    # short ones among paragraphs
    ((6, 0, 50, 0, 45, 0, 0, 0, 0, 0, 0), 1),
    ((2, 0, 30, 0, 60, 0, 0, 0, 0, 0, 0), 1),
    ((8, 0, 2, 1, 55, 0, 1, 0, 0, 0, 0), 1),
    ((2, 0, 1, 1, 25, 0, 1, 0, 0, 0, 0), 1),
    ((3, 0, 2, 1, 60, 0, 1, 0, 0, 0, 0), 1),
    ((5, 0, 3, 1, 8, 0, 1, 0, 0, 0, 0), 1),
    ((12, 0, 35, 0, 1, 0, 0, 0, 0, 0, 0), 1),
    ((3, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0), 1),
    ((1, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((4, 0, 5, 0, 6, 0, 0, 0, 0, 0, 0), 1),
    ((9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((15, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((6, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((11, 0, 4, 0, 9, 0, 0, 0, 0, 0, 0), 1),
    ((5, 0.4, 40, 0, 30, 0, 0, 0, 0, 0, 0), 1),
    # menus, lists of links, blocks that are mostly link
    ((1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0), 0),
    ((2, 1, 3, 1, 2, 1, 0, 0, 0, 0, 0), 0),
    ((1, 1, 1, 1, 9, 0, 0, 0, 0, 0, 0), 0),
    ((4, 0.75, 60, 0, 3, 1, 0, 0, 0, 0, 0), 0),
    ((25, 0.8, 40, 0, 20, 0.9, 0, 0, 0, 0, 0), 0),
    ((60, 0.7, 10, 0.5, 40, 0.6, 0, 0, 0, 0, 0), 0),
    ((7, 1, 12, 0.4, 6, 1, 1, 0, 0, 0, 0), 0),
    ((3, 1, 5, 1, 0, 0, 0, 0, 0, 0, 0), 0),
    ((1, 1, 1, 1, 60, 0, 0, 0, 0, 0, 0), 0),
    ((3, 1, 2, 1, 120, 0, 0, 0, 0, 0, 0), 0),
    ((5, 1, 50, 0, 90, 0, 0, 0, 1, 0, 0), 0),
    ((8, 1, 90, 0, 7, 1, 0, 0, 1, 0, 0), 0),
    ((2, 1, 2, 1, 2, 1, 0, 0, 1, 1, 0), 0),
    ((1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 0), 0),
    ((1, 1, 0, 0, 1, 1, 0, 0, 1, 1, 0), 0),
    ((1, 1, 1, 1, 10, 0, 0, 0, 1, 1, 0), 0),
    ((3, 1, 4, 1, 4, 1, 0, 0, 1, 0, 1), 0),
    # short ones beside links
    ((3, 0, 2, 1, 4, 0.8, 0, 0, 0, 0, 0), 0),
    ((5, 0, 3, 0.6, 3, 1, 0, 0, 0, 0, 0), 0),
    ((7, 0, 4, 1, 0, 0, 0, 0, 0, 0, 0), 0),
    ((10, 0.5, 1, 1, 5, 1, 0, 0, 0, 0, 0), 0),
    ((6, 0, 5, 0, 3, 1, 0, 0, 1, 0, 0), 0),
    ((2, 0, 60, 0, 5, 1, 1, 0, 0, 0, 0), 0),
    ((3, 0, 45, 0, 4, 0.9, 0, 0, 0, 0, 0), 0),
    ((2, 0, 80, 0, 6, 1, 0, 0, 0, 0, 0), 0),
    # inside an article: blocks of any length, and links in running text
    ((12, 0, 8, 0, 40, 0, 1, 1, 0, 0, 0), 1),
    ((40, 0, 12, 0, 150, 0, 0, 1, 0, 0, 0), 1),
    ((150, 0.02, 40, 0, 2, 0, 0, 1, 0, 0, 0), 1),
    ((2, 0, 150, 0, 1, 0, 0, 1, 0, 0, 0), 1),
    ((1, 0, 2, 0, 14, 0, 0, 1, 0, 0, 0), 1),
    ((9, 0, 2, 1, 30, 0, 1, 1, 0, 0, 0), 1),
    ((9, 1, 14, 0, 30, 0, 0, 1, 0, 0, 0), 1),
    ((3, 1, 20, 0, 12, 0.1, 0, 1, 0, 0, 0), 1),
    ((2, 0.5, 30, 0, 8, 0, 0, 1, 0, 0, 0), 1),
    ((5, 0, 20, 0, 0, 0, 0, 1, 0, 0, 0), 1),
    ((7, 0, 3, 1, 6, 0, 0, 1, 0, 0, 0), 1),
    ((3, 0, 9, 0, 2, 1, 0, 1, 0, 0, 0), 1),
    ((10, 0, 3, 0, 4, 1, 0, 1, 0, 0, 0), 1),
    ((6, 0, 5, 0, 9, 1, 0, 1, 0, 0, 0), 1),
    ((4, 0, 2, 1, 3, 1, 0, 1, 0, 0, 0), 1),
    ((20, 0.5, 4, 0, 6, 1, 0, 1, 0, 0, 0), 1),
    ((30, 0.3, 2, 0, 3, 1, 0, 1, 0, 0, 0), 1),
    ((5, 1, 6, 0, 8, 0, 0, 1, 0, 0, 0), 1),
    ((8, 0.8, 0, 0, 5, 0, 0, 1, 0, 0, 0), 1),
    ((6, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0), 1),
    ((7, 0.6, 3, 1, 0, 0, 0, 1, 0, 0, 0), 1),
    ((11, 0, 4, 0, 0, 0, 0, 1, 0, 0, 0), 1),
    # notices, adverts, forms, footers, side bars and comments in elements made for them
    ((8, 0, 1, 1, 12, 0, 0, 0, 1, 0, 1), 0),
    ((12, 0, 6, 1, 9, 0, 0, 0, 1, 0, 1), 0),
    ((14, 0, 40, 0, 0, 0, 0, 0, 1, 0, 1), 0),
    ((5, 0, 0, 0, 30, 0, 0, 0, 0, 0, 1), 0),
    ((20, 0, 3, 0, 2, 0, 0, 0, 0, 0, 1), 0),
    ((14, 0, 40, 0, 9, 0, 0, 0, 0, 0, 1), 0),
    ((10, 0, 30, 0, 0, 0, 0, 0, 0, 0, 1), 0),
    ((6, 0, 25, 0, 40, 0, 0, 0, 0, 0, 1), 0),
    ((9, 0, 1, 1, 70, 0, 0, 0, 0, 0, 1), 0),
    ((16, 0, 0, 0, 140, 0, 0, 0, 1, 0, 1), 0),
    ((16, 0, 0, 0, 140, 0, 0, 0, 0, 0, 1), 0),
    ((9, 0, 100, 0, 120, 0, 0, 0, 0, 0, 1), 0),
    ((3, 0, 8, 0, 5, 0, 1, 0, 0, 0, 1), 0),
    ((12, 0, 6, 0, 0, 0, 0, 0, 1, 1, 0), 0),
    ((60, 0, 12, 0, 50, 0, 0, 0, 1, 1, 0), 0),
    ((45, 0.05, 60, 0, 3, 0, 0, 0, 1, 1, 0), 0),
    ((35, 0, 5, 0, 40, 0, 0, 0, 0, 1, 0), 0),
    ((120, 0, 90, 0, 80, 0, 0, 0, 0, 1, 0), 0),
    ((4, 0.5, 30, 0, 2, 1, 0, 0, 0, 1, 0), 0),
    ((2, 0, 3, 1, 25, 0, 1, 0, 0, 1, 0), 0),
    ((120, 0, 90, 0, 80, 0, 0, 0, 1, 1, 0), 0),
    ((90, 0, 12, 0, 0, 0, 0, 0, 1, 1, 0), 0),
    ((70, 0.1, 80, 0, 100, 0, 0, 0, 1, 1, 1), 0),
    ((100, 0, 30, 0, 40, 0, 0, 0, 0, 1, 1), 0),
    ((18, 0, 22, 0, 30, 0, 0, 1, 0, 1, 0), 0),
    ((70, 0, 22, 0, 30, 0, 0, 1, 0, 1, 0), 0),
    ((3, 0, 30, 0, 18, 0, 0, 1, 0, 1, 0), 0),
    # text in an element that only sounds like one of those
    ((110, 0, 9, 0, 130, 0, 0, 0, 0, 0, 1), 1),
    ((80, 0.1, 60, 0, 90, 0, 0, 0, 0, 0, 1), 1),
    ((95, 0, 70, 0, 8, 0, 0, 0, 0, 0, 1), 1),
    ((75, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), 1),
    ((95, 0, 70, 0, 8, 0, 0, 0, 1, 0, 1), 0),
    # beside an article element, in no element of their own
    ((5, 0, 1, 1, 12, 0, 0, 0, 1, 0, 0), 0),
    ((14, 0, 3, 1, 8, 0, 0, 0, 1, 0, 0), 0),
    ((30, 0.1, 150, 0, 10, 1, 0, 0, 1, 0, 0), 0),
    ((9, 0, 60, 0, 0, 0, 0, 0, 1, 0, 0), 0),
    ((3, 0, 20, 0, 30, 0, 1, 0, 1, 0, 0), 0),
    ((7, 0, 2, 1, 80, 0, 0, 0, 1, 0, 0), 0),
    ((40, 0, 30, 0, 20, 0, 0, 0, 1, 0, 0), 0),
    ((25, 0, 10, 0, 50, 0, 0, 0, 1, 0, 0), 0),
    ((33, 0, 70, 0, 8, 0, 0, 0, 1, 0, 0), 0),
    ((140, 0, 12, 0, 90, 0, 0, 0, 1, 0, 0), 0),
    ((75, 0.05, 80, 0, 60, 0, 0, 0, 1, 0, 0), 0),
)

# Inside an article a block is text whatever stands around it (references are lists of links, and a short line may follow one), but
# for runs of links of a word or three, which are menus, and what stands in an element for boilerplate. Each shape with each kind of
# neighbour, labelled by that rule.
_SHAPES = ((1, 0), (3, 0), (6, 0), (40, 0), (1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (12, 0.7), (40, 1))
_NEIGHBOURS = ((0, 0), (1, 1), (3, 1), (2, 0), (4, 1), (8, 1), (40, 0))


def _is_menu(block: tuple[float, float], *around: tuple[float, float]) -> bool:
    def short_link(words: float, density: float) -> bool:
        return 0 < words <= 3 and density == 1

    return short_link(*block) and any(short_link(*x) for x in around)


TABLE += tuple(((*block, *before, *behind, 0, 1, 0, boiler, 0), int(not boiler and not _is_menu(block, before, behind))) for block in _SHAPES for before in _NEIGHBOURS for behind in _NEIGHBOURS for boiler in (0, 1))

Tree = int | tuple[int, float, "Tree", "Tree"]  # a class, or: feature, limit, tree at or below it, tree above it


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 12) -> Tree:
    """CART: the split of the least Gini impurity; ties go to the earlier feature and the lower limit."""
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part: list[tuple[tuple[float, ...], int]]) -> float:
        p = sum(y for _, y in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            limit = (a + b) / 2
            low, high = [r for r in rows if r[0][f] <= limit], [r for r in rows if r[0][f] > limit]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, limit, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, limit, low, high = best
    return (f, limit, grow(low, depth - 1), grow(high, depth - 1))


def classify(tree: Tree, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


def main_text(html: str | None, tree: Tree) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, row in zip(blocks, rows_of(blocks)) if classify(tree, row))


def extract(pages: DataFrame, table: tuple[tuple[tuple[float, ...], int], ...] = TABLE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages. No html, or no block of text: the empty string."""
    tree = grow(list(table))
    main = each_text(lambda: lambda pages_: ([main_text(h, tree) for h in pages_],), "text string")
    done = pages.select("page_id", "url", main(F.col("html").cast("string"))["text"].alias("text"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
