"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at every tag that is not inline. A block is described by its word count and
link density, those of its neighbours, whether it is a heading, and where it stands (``PLACES``). A tree of
yes-no questions, grown here on the small table ``LABELLED``, tells text from the rest.

Defined results: a null or empty page, and one without main text, has an empty text; a page that ends
inside a tag, comment, script, style, textarea or title ends there; unclosed elements end with the element around
them, an unclosed head at the first tag or word that cannot stand in it, svg and select at the next flow element;
repeated rows give repeated results; other columns pass through ``extract`` unless they are called ``text`` or
``n_chars``, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.arrays import unused

# Where a block stands: in an element for other things than text, outside the page's article, on a page
# without one, in the article, in a part of one of the last two whose name may mean other things.
PLACES = OTHER, OUTSIDE, PLAIN, ARTICLE, DOUBT = range(5)
SKIPPED = -1  # what is inside is not read

# Elements by their role in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr object "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd "
    "mstyle mpadded mphantom menclose mmultiscripts mprescripts mfenced".split()
)
# RAW ones are read to their end tag, the others are elements among the open ones.
UNREAD = frozenset("script style noscript template svg annotation annotation-xml iframe head title textarea select button canvas audio video".split())
RAW = frozenset("script style textarea title".split())
NO_SLASH = RAW | {"noscript", "iframe", "template"}
WITHIN = frozenset("button annotation annotation-xml".split())  # these cut no block
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
# These cannot stand in a drawing or a list of choices.
FLOW = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav "
    "ol p pre section table ul".split()
)
NOT_TEXT = frozenset("nav footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id, role and label attributes that tell of other things than the article.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe subscription signup login sidebar side widget menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar pagination pager footer masthead topbar comment comments commentlist respond reply replies "
    "disqus discussion social share sharing related recommended recommendations search tags toc complementary contentinfo "
    "adslot adbox adunit cookiebar cookiebanner sharebar sharebox relatedposts relatedarticles usercomments commentbox sidebox".split()
)
# Of these, words that an article's own parts have too.
MAYBE = frozenset(
    "notice alert banner promotion side menu respond reply replies discussion social related recommended recommendations search tags toc "
    "sharing subscription signup login".split()
)
COMMENTS = frozenset(["comment", "comments", "commentlist"])
# A name with one of these tells of what an element has or lacks, not of what it is.
ABOUT = frozenset("has no with without not".split())
# Elements that may be wrapped around a whole page.
WRAPPERS = frozenset("form fieldset dialog header".split())
# Not the words "header" and "banner" of an article's own head.
PAGE_ONLY = frozenset(["header", "site-header", "page-header"])

# words, link density, words before, link density before, words after, link density after, heading, place, text?
LABELLED = [
    (1, 1.0, 0, 0.0, 1, 1.0, 0, OTHER, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, OTHER, 0), (3, 0.0, 1, 1.0, 9, 0.0, 0, OTHER, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, 0, OTHER, 0), (60, 0.0, 40, 0.0, 55, 0.0, 0, OTHER, 0), (25, 0.1, 80, 0.0, 0, 0.0, 0, OTHER, 0),
    (8, 0.0, 120, 0.0, 0, 0.0, 0, OTHER, 0), (4, 0.0, 30, 0.0, 22, 0.0, 1, OTHER, 0), (35, 0.0, 4, 0.0, 12, 0.0, 0, OTHER, 0),
    (15, 0.3, 2, 1.0, 3, 1.0, 0, OTHER, 0), (90, 0.02, 5, 0.0, 0, 0.0, 0, OTHER, 0), (2, 0.0, 0, 0.0, 2, 0.0, 0, OTHER, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, OUTSIDE, 0), (5, 0.0, 1, 1.0, 9, 0.0, 0, OUTSIDE, 0), (14, 0.1, 90, 0.0, 0, 0.0, 0, OUTSIDE, 0),
    (45, 0.0, 30, 0.0, 6, 0.0, 0, OUTSIDE, 0), (6, 0.0, 0, 0.0, 70, 0.0, 1, OUTSIDE, 0), (28, 0.0, 12, 0.0, 35, 0.0, 0, OUTSIDE, 0),
    (9, 0.5, 4, 1.0, 7, 0.0, 0, OUTSIDE, 0), (3, 0.0, 45, 0.0, 1, 1.0, 0, OUTSIDE, 0), (110, 0.0, 2, 0.0, 3, 0.0, 0, OUTSIDE, 0),
    (9, 0.0, 5, 0.0, 11, 0.0, 1, ARTICLE, 1), (2, 0.0, 1, 0.0, 30, 0.0, 1, ARTICLE, 1), (1, 0.0, 45, 0.0, 1, 0.0, 0, ARTICLE, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, ARTICLE, 1), (12, 0.0, 3, 0.0, 60, 0.0, 0, ARTICLE, 1), (70, 0.0, 40, 0.0, 35, 0.0, 0, ARTICLE, 1),
    (240, 0.05, 90, 0.0, 14, 0.0, 0, ARTICLE, 1), (8, 0.0, 150, 0.0, 5, 0.3, 0, ARTICLE, 1), (30, 0.4, 55, 0.0, 44, 0.0, 0, ARTICLE, 1),
    (5, 0.0, 1, 1.0, 20, 0.0, 0, ARTICLE, 1), (18, 0.0, 7, 0.0, 1, 1.0, 0, ARTICLE, 1), (6, 1.0, 50, 0.0, 64, 0.0, 0, ARTICLE, 1),
    (15, 0.7, 33, 0.0, 21, 0.0, 0, ARTICLE, 1), (4, 0.0, 6, 0.0, 5, 0.0, 0, ARTICLE, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, ARTICLE, 1),
    (7, 0.0, 90, 0.0, 0, 0.0, 0, ARTICLE, 1), (3, 0.0, 20, 0.0, 1, 1.0, 0, ARTICLE, 1), (11, 0.0, 35, 0.0, 0, 0.0, 0, ARTICLE, 1),
    (5, 0.0, 9, 0.0, 2, 0.0, 0, ARTICLE, 1), (12, 0.3, 14, 0.0, 0, 0.0, 0, ARTICLE, 1), (6, 0.0, 2, 1.0, 1, 0.0, 0, ARTICLE, 1),
    (9, 0.0, 7, 0.0, 1, 0.0, 0, ARTICLE, 1), (4, 0.2, 11, 0.0, 0, 0.0, 0, ARTICLE, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, ARTICLE, 1),
    (2, 0.0, 4, 0.0, 2, 0.0, 0, ARTICLE, 1), (8, 0.0, 5, 1.0, 0, 0.0, 0, ARTICLE, 1), (3, 0.0, 16, 0.0, 0, 0.0, 0, ARTICLE, 1),
    (10, 0.4, 1, 0.0, 2, 1.0, 0, ARTICLE, 1), (2, 0.0, 0, 0.0, 1, 1.0, 1, ARTICLE, 1), (13, 0.0, 2, 1.0, 2, 0.0, 0, ARTICLE, 1),
    (4, 0.0, 2, 1.0, 30, 0.0, 1, ARTICLE, 1), (3, 0.0, 3, 1.0, 12, 0.0, 1, ARTICLE, 1), (5, 0.0, 2, 1.0, 6, 0.0, 0, ARTICLE, 1),
    (2, 0.0, 4, 1.0, 9, 0.0, 1, ARTICLE, 1), (40, 0.0, 2, 1.0, 1, 1.0, 0, ARTICLE, 1), (6, 0.0, 1, 1.0, 1, 1.0, 1, ARTICLE, 1),
    (15, 0.0, 3, 1.0, 4, 1.0, 0, ARTICLE, 1), (3, 0.0, 2, 1.0, 2, 1.0, 0, ARTICLE, 1), (80, 0.2, 1, 1.0, 2, 1.0, 0, ARTICLE, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, ARTICLE, 1), (4, 1.0, 5, 1.0, 4, 1.0, 0, ARTICLE, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, ARTICLE, 1),
    (6, 1.0, 6, 1.0, 7, 1.0, 0, ARTICLE, 1), (3, 1.0, 2, 1.0, 5, 1.0, 0, ARTICLE, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, PLAIN, 0), (2, 1.0, 2, 1.0, 1, 1.0, 0, PLAIN, 0), (1, 1.0, 1, 1.0, 7, 0.0, 0, PLAIN, 0),
    (4, 1.0, 80, 0.0, 5, 1.0, 0, PLAIN, 0), (9, 0.8, 3, 1.0, 30, 0.0, 0, PLAIN, 0), (6, 0.0, 1, 1.0, 2, 1.0, 0, PLAIN, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0, PLAIN, 0), (8, 0.2, 4, 1.0, 1, 1.0, 0, PLAIN, 0), (7, 0.0, 90, 0.0, 0, 0.0, 0, PLAIN, 1),
    (11, 0.6, 60, 0.0, 0, 0.0, 0, PLAIN, 0), (3, 0.0, 2, 1.0, 1, 1.0, 1, PLAIN, 0), (20, 0.7, 5, 1.0, 4, 1.0, 0, PLAIN, 0),
    (7, 0.0, 1, 1.0, 55, 0.0, 1, PLAIN, 1), (4, 0.0, 0, 0.0, 34, 0.0, 1, PLAIN, 1), (3, 0.0, 40, 0.0, 62, 0.0, 1, PLAIN, 1),
    (25, 0.0, 1, 1.0, 40, 0.0, 0, PLAIN, 1), (55, 0.0, 7, 0.0, 70, 0.0, 0, PLAIN, 1), (130, 0.05, 60, 0.0, 22, 0.0, 0, PLAIN, 1),
    (40, 0.1, 75, 0.0, 7, 0.0, 0, PLAIN, 1), (5, 0.0, 45, 0.0, 38, 0.0, 0, PLAIN, 1), (2, 0.0, 66, 0.0, 24, 0.0, 0, PLAIN, 1),
    (10, 0.0, 35, 0.0, 28, 0.0, 0, PLAIN, 1), (22, 0.2, 18, 0.0, 50, 0.0, 0, PLAIN, 1), (300, 0.0, 1, 1.0, 2, 1.0, 0, PLAIN, 1),
    (33, 0.0, 0, 0.0, 0, 0.0, 0, PLAIN, 1), (48, 0.0, 20, 0.0, 3, 1.0, 0, PLAIN, 1),
    (4, 0.0, 60, 0.0, 0, 0.0, 0, PLAIN, 1), (9, 0.0, 30, 0.0, 12, 0.0, 0, PLAIN, 1), (3, 0.0, 12, 0.0, 40, 0.0, 0, PLAIN, 1),
    (12, 0.0, 5, 0.0, 9, 0.0, 0, PLAIN, 1), (2, 0.0, 25, 0.0, 0, 0.0, 0, PLAIN, 1), (1, 0.0, 70, 0.0, 33, 0.0, 0, PLAIN, 1),
    (6, 0.0, 8, 0.0, 0, 0.0, 0, PLAIN, 1), (5, 0.0, 3, 0.0, 4, 0.0, 0, PLAIN, 1),
    (25, 0.0, 40, 0.0, 30, 0.0, 0, DOUBT, 1), (60, 0.05, 4, 0.0, 0, 0.0, 0, DOUBT, 1), (12, 0.0, 30, 0.0, 20, 0.0, 0, DOUBT, 1),
    (8, 0.0, 25, 0.0, 0, 0.0, 0, DOUBT, 1), (7, 0.0, 2, 0.0, 45, 0.0, 0, DOUBT, 1), (3, 0.0, 20, 0.0, 30, 0.0, 1, DOUBT, 1),
    (1, 0.0, 40, 0.0, 25, 0.0, 1, DOUBT, 1), (14, 0.3, 18, 0.0, 50, 0.0, 0, DOUBT, 1), (5, 0.0, 33, 0.0, 12, 0.0, 0, DOUBT, 1),
    (4, 0.0, 15, 0.0, 0, 0.0, 0, DOUBT, 1), (2, 0.0, 9, 0.0, 11, 0.0, 0, DOUBT, 1), (16, 0.0, 1, 0.0, 8, 0.0, 0, DOUBT, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, DOUBT, 0), (5, 1.0, 6, 1.0, 4, 1.0, 0, DOUBT, 0), (1, 1.0, 40, 0.0, 1, 1.0, 0, DOUBT, 0),
    (9, 0.8, 3, 1.0, 30, 0.0, 0, DOUBT, 0), (7, 1.0, 2, 0.0, 8, 1.0, 0, DOUBT, 0), (14, 0.9, 60, 0.0, 11, 1.0, 0, DOUBT, 0),
    (2, 0.0, 40, 0.0, 5, 1.0, 1, DOUBT, 0), (1, 0.0, 55, 0.0, 1, 1.0, 0, DOUBT, 0), (3, 0.0, 30, 0.0, 6, 1.0, 1, DOUBT, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, DOUBT, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, DOUBT, 0), (1, 0.0, 1, 1.0, 0, 0.0, 0, DOUBT, 0),
]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_TAG_END = re.compile(r">|\Z")
_SIGN = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    words: int
    link: float
    heading: bool
    place: int  # while the page is read, the number of its element


@dataclass
class Element:
    name: str
    parent: int
    signs: set[str]
    words: float = 0.0
    heads: bool = False  # a first or second heading, or an article, is inside


def _tells(attributes: str) -> set[str]:
    """Words of an element's names, without names of what it has or lacks."""
    told: set[str] = set()
    for found in _SIGN.findall(attributes):
        for name in "".join(found).split():
            words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            if ABOUT.isdisjoint(words):
                told.update(words)
    return told


def _holds_text(e: Element) -> bool:
    return e.name in ("article", "main") or "main" in e.signs and "content" in e.signs


def _mark(e: Element) -> int | None:
    """``OTHER`` or ``DOUBT`` by an element's own name and signs."""
    if e.signs & COMMENTS:
        return OTHER
    if e.name in NOT_TEXT:
        return OTHER
    if e.name in HEADINGS or e.name in ("body", "html", "article", "main"):
        return None
    if e.signs & SIGNS:
        return OTHER if e.signs & (SIGNS - MAYBE) else DOUBT
    return None


def _places(elements: list[Element], blocks: list[Block]) -> list[int]:
    """The place of what stands in each element, judged on the whole page; the first element is the page itself.

    A mark does not count on an element that is wrapped around the text: one that holds more than half of the words of
    the article or page around it together with a heading or an article (a form also without), or one around the
    only articles of the page.
    """
    for b in blocks:
        elements[b.place].words += b.words * (1 - b.link)
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
        elements[e.parent].heads |= e.heads or e.name in ("h1", "h2") or _holds_text(e)
    marks: list[int | None] = [None]
    scope, clear, commented = [0], [True], [False]  # article or page around, no mark around, in comments
    for i, e in enumerate(elements[1:], 1):
        around = elements[e.parent]
        mark = _mark(e)
        header = e.name == "header" or bool(e.signs & PAGE_ONLY)
        soft = e.name not in NOT_TEXT or e.name in WRAPPERS
        scope.append(e.parent if _holds_text(around) else scope[e.parent])
        commented.append(commented[e.parent] or bool(e.signs & COMMENTS))
        wraps = e.heads or e.name in ("form", "fieldset")
        if (mark is not None or header) and soft and not commented[i] and wraps and e.words > elements[scope[i]].words / 2:
            mark, header = None, False
        marks.append(OTHER if header and scope[i] == 0 and not _holds_text(around) and mark is None else mark)
        clear.append(clear[e.parent] and marks[i] is None)
    if not any(_holds_text(e) and clear[i] for i, e in enumerate(elements)):
        for i, e in enumerate(elements):
            if _holds_text(e) and not commented[i]:
                j = e.parent
                while j and not clear[j]:
                    if marks[j] is not None and (elements[j].name not in NOT_TEXT or elements[j].name in WRAPPERS):
                        marks[j] = None
                    j = elements[j].parent
    places = [PLAIN]
    for i, e in enumerate(elements[1:], 1):
        outer = places[e.parent]
        place = outer if outer == OTHER or marks[i] is None else marks[i]
        places.append(ARTICLE if place != OTHER and _holds_text(e) else place)
    if ARTICLE in places:
        inside = [False]
        for i, e in enumerate(elements[1:], 1):
            inside.append(inside[e.parent] or places[i] == ARTICLE)
        places = [OUTSIDE if p in (PLAIN, DOUBT) and not inside[i] else p for i, p in enumerate(places)]
    return places


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in its order."""
    found: list[Block] = []
    texts: list[tuple[str, bool]] = []
    # open elements: name, number in ``elements``, heading
    around: list[tuple[str, int, bool]] = []
    closed: set[str] = set()  # names of which no element is open
    elements = [Element("", 0, set())]
    links = 0

    def close_block() -> None:
        raw = "".join(t for t, _ in texts)
        linked = "".join(t for t, inside in texts if inside)
        texts.clear()
        text = " ".join(html.unescape(raw).split())
        if text:
            inside = next((a for a in reversed(around) if a[1] != SKIPPED), ("", 0, False))
            words = text.count(" ") + 1
            found.append(Block(text, words, min(1.0, len(html.unescape(linked).split()) / words), inside[2], inside[1]))

    def skipping() -> bool:
        return bool(around) and around[-1][1] == SKIPPED

    def read_on(names: frozenset[str]) -> None:
        """Ends the outermost unread element if it is one of ``names``, with all inside it."""
        first = len(around)
        while first and around[first - 1][1] == SKIPPED:
            first -= 1
        if first < len(around) and around[first][0] in names:
            del around[first:]

    def add(text: str) -> None:
        if around and around[-1][0] == "head" and text.strip():
            around.pop()
        if not skipping():
            texts.append((text, links > 0))

    at = 0
    while at < len(page):
        tag = _TOKEN.search(page, at)
        if not tag:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at:tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - (not skipping()))
            elif name in INLINE:
                continue
            else:
                i = -1 if name in closed else next((i for i in range(len(around) - 1, -1, -1) if around[i][0] == name), -1)
                if i < 0:
                    closed.add(name)
                unread = around[i][1] == SKIPPED if i >= 0 else skipping()
                if not unread or i >= 0 and name not in WITHIN and not (i and around[i - 1][1] == SKIPPED):
                    close_block()
                    links = 0
                if i >= 0:
                    del around[i:]
            continue
        if name in RAW:
            if not skipping():
                close_block()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = _TAG_END.search(page, end.end()).end() if end else len(page)
            continue
        if skipping():
            if around[-1][0] == "head" and name not in IN_HEAD:
                around.pop()
            elif name == "body":
                read_on(frozenset(["head"]))
            elif name in FLOW:
                read_on(frozenset(["svg", "select"]))
        if skipping():
            if name not in VOID and name not in INLINE and not tag[3].endswith("/"):
                closed.discard(name)
                around.append((name, SKIPPED, False))
            continue
        if name == "br":
            texts.append((" ", False))
            continue
        if name in UNREAD:
            if tag[3].endswith("/") and name not in NO_SLASH:
                continue
            if name not in WITHIN:
                close_block()
            closed.discard(name)
            around.append((name, SKIPPED, False))
            continue
        signs = _tells(tag[3]) if tag[3] else set()
        if name in INLINE:
            links += name == "a"
            continue
        close_block()
        links = 0
        if name in VOID:
            continue
        if name == "p" or name in HEADINGS:  # these end with the next of their kind
            while around and (around[-1][0] == "p" or around[-1][0] in HEADINGS):
                around.pop()
        elements.append(Element(name, around[-1][1] if around else 0, signs))
        closed.discard(name)
        around.append((name, len(elements) - 1, name in HEADINGS or (bool(around) and around[-1][2])))
    close_block()
    places = _places(elements, found)
    for b in found:
        b.place = places[b.place]
    return found


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block of a page: its own figures, its neighbours', heading and place."""
    out = np.zeros((len(blocks), 8))
    for i, b in enumerate(blocks):
        out[i, 0], out[i, 1], out[i, 6], out[i, 7] = b.words, b.link, b.heading, b.place
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree of ``(feature, threshold, below, above)`` by least Gini impurity; a leaf is a share of text."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut_at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut_at
            parts = [y[low], y[~low]]
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut_at), low
    if best is None:
        return (share,)
    _, f, cut_at, low = best
    return f, cut_at, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    """True for rows that the tree takes for text."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    low = x[:, tree[0]] < tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree[2], x[low]), classify(tree[3], x[~low])
    return out


def main_text(page: str, tree: tuple) -> str:
    """Blocks of main text, one per line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = classify(tree, features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, labelled: list[tuple] = LABELLED) -> DataFrame:
    """Add ``text`` and ``n_chars`` to each page, by a tree grown on ``labelled``."""
    table = np.array(labelled, float)
    tree = grow(table[:, :-1], table[:, -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [main_text(page or "", tree) for page in part.column(hidden).to_pylist()]
                rest = part.drop_columns([hidden])
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*rest.schema.names, "text", "n_chars"],
                )

    kept = pages.drop("text", "n_chars")
    hidden = unused(kept, "_html")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return kept.withColumn(hidden, F.col("html").cast("string")).mapInArrow(run, schema)
