"""Main text of web pages from shallow block features.

A page becomes a flat list of text blocks. Markup that says what it is (menus, footers,
forms, containers named as adverts or comments) is never main text, whatever its length,
but stays in the list as a neighbour. Every other block is described by its word count and
link density, those of the blocks before and after it, and whether it lies inside the
page's article; a decision tree grown on a small labelled table says which are main text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset(
    "script style noscript template svg math iframe object canvas head title button select textarea option "
    "datalist audio video map form dialog".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a head can hold.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_FURNITURE = frozenset("nav footer aside menu".split())
_ARTICLE = frozenset("article main".split())
#: Parts of a class, id or role that make furniture of any name they stand in.
_COMMENT = re.compile(r"comments?(?:list|form|box|area|section|thread|wrap(?:per)?)?|disqus")
_ALWAYS = re.compile(
    r"ads?(?:box|slot|unit|space|zone|block|text|banner|container|wrap(?:per)?|sense|choices)?|advert[a-z]*|"
    r"(?:top|sub|side|main|foot|mega)?(?:nav|menu)s?(?:bar|igation|list|links?|items?)?|side(?:bar|rail)[a-z]*|breadcrumbs?|"
    r"(?:site|page)?footer|tagcloud|outbrain|taboola"
)
#: Parts that do so where the rest of the name says no more than a kind, a place or a number.
_SOMETIMES = re.compile(
    r"sponsor[a-z]*|promo[a-z]*|banners?|masthead|topbar|header|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|"
    r"newsletter|subscri[a-z]*|signup|signin|login|respond|replies|reply|sharing|shar(?:e|ing)[a-z]*|social[a-z]*|related|recommend[a-z]*|"
    r"widgets?|toolbar|paginat[a-z]*|pager|copyright|disclaimer|legal|search[a-z]*|complementary|contentinfo|dialog|skip[a-z]*|tags|follow"
)
_PLAIN = frozenset(
    "area bar block bottom box button buttons container content form global icon icons inner inline item items left link links list "
    "message main media outer page panel policy post posts primary right row secondary section site small sticky text thread to top "
    "unit us user wrap wrapper".split()
)
#: An article's own header holds its title.
_OWN_HEADER = frozenset("article content entry post story".split())
#: Parts that tell a state of what is inside: has-sidebar, comments-open.
_STATE = frozenset(
    "has is no not with without open opened close closed enabled disabled show shown hide off free active layout".split()
)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1 << 16)
def _named(name: str) -> str:
    """What a class, id or role names: ``comment``, ``header``, other ``furniture``, or nothing."""
    parts = [p for p in (part.lower().rstrip("0123456789") for part in _PARTS.split(name)) if p and not p[:-1].isdigit()]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    if _STATE.intersection(parts):
        return ""
    if any(map(_COMMENT.fullmatch, parts + pairs)):
        return "comment"
    if any(map(_ALWAYS.fullmatch, parts + pairs)):
        return "furniture"
    rest = [part for part in parts if not _SOMETIMES.fullmatch(part)]
    if len(rest) == len(parts) or not _PLAIN.issuperset(rest):
        return ""
    if "header" in parts:
        return "" if _OWN_HEADER.intersection(parts) else "header"
    return "furniture"


class Block(NamedTuple):
    """A block of text; ``article`` is 1 inside the page's article, -1 outside of it and 0
    on pages without one."""
    text: str
    words: int
    links: float
    furniture: bool
    article: int


class _Skip(NamedTuple):
    """An open element of _SKIP: its name and what there was before it."""
    tag: str
    start: int
    depth: int
    anchors: int


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._found: list[tuple[Block, int] | None] = []  # with the innermost mark
        self._open: list[tuple[str, bool, bool, int]] = []  # containers: whether furniture, whether article, the mark before
        self._marks: list[tuple[int, str]] = []  # containers with a name: the mark around, what it names
        self._around: list[int] = []  # the marks around outermost articles
        self._mark = -1
        self._furniture = self._article = self._anchors = 0
        self._skipped: list[_Skip] = []
        self._skips: Counter[str] = Counter()
        self._left: dict[str, list[tuple[int, int]]] = defaultdict(list)  # skipped parts that lost their parent
        self._text: list[tuple[str, bool]] = []

    def flush(self) -> None:
        parts, self._text = self._text, []
        text = _SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
        if text:
            words = len(text.split(" "))
            linked = len(" ".join(p for p, anchored in parts if anchored).split())
            block = Block(text, words, min(1.0, linked / words), self._furniture > 0, int(self._article > 0))
            self._found.append((block, self._mark))

    def blocks(self) -> list[Block]:
        found = [entry for entry in self._found if entry]
        read = self._judged(found, frozenset())
        around = frozenset(chain for mark in self._around for chain in self._chain(mark))
        if around:
            # A name around an article counts, unless more of the page's text is inside
            # such articles than in all that no name speaks against.
            freed = self._judged(found, around)
            inside = sum(new.words for old, new in zip(read, freed, strict=True) if old.furniture and not new.furniture and new.article)
            if inside > sum(block.words for block in read if not block.furniture and block.links < 0.5):
                read = freed
        own = [block for block in read if not block.furniture and block.links < 0.5]
        # An article with less text than the rest of the page is not the page's article.
        inside = sum(block.words for block in own if block.article)
        if not inside or 2 * inside < sum(block.words for block in own):
            return [block._replace(article=0) for block in read]
        return [block if block.article else block._replace(article=-1) for block in read]

    def _judged(self, found: list[tuple[Block, int]], ignored: frozenset[int]) -> list[Block]:
        named: list[bool] = []  # whether a mark or one around it counts
        for k, (around, _) in enumerate(self._marks):
            named.append(k not in ignored or (around >= 0 and named[around]))
        return [block._replace(furniture=True) if mark >= 0 and named[mark] else block for block, mark in found]

    def _chain(self, mark: int) -> Iterator[int]:
        """A mark and those around it that do not name comments."""
        while mark >= 0 and self._marks[mark][1] != "comment":
            yield mark
            mark = self._marks[mark][0]

    def _close(self, depth: int) -> None:
        while len(self._open) > depth:
            _, furniture, article, self._mark = self._open.pop()
            self._furniture -= furniture
            self._article -= article

    def _pop(self) -> _Skip:
        skip = self._skipped.pop()
        self._skips[skip.tag] -= 1
        return skip

    def _drop(self, tag: str) -> None:
        """Ends the innermost skipped ``tag`` and takes out what was read since its start."""
        self.flush()
        while (skip := self._pop()).tag != tag:
            pass
        del self._found[skip.start:]
        for parts in self._left.values():
            while parts and parts[-1][1] > skip.start:
                parts.pop()
        self._close(skip.depth)
        self._anchors = skip.anchors

    def _leave_head(self, tag: str) -> None:
        """Ends a head without end tag where something starts that it cannot hold."""
        if self._skips["head"] and (tag == "body" or (self._skipped[-1].tag == "head" and tag not in _IN_HEAD)):
            self._drop("head")

    def handle_starttag(self, tag: str, attrs) -> None:
        self._leave_head(tag)
        if tag in _SKIP:
            self.flush()
            self._skipped.append(_Skip(tag, len(self._found), len(self._open), self._anchors))
            self._skips[tag] += 1
        elif tag == "br":
            self._text.append((" ", False))
        elif tag == "a":
            self._anchors += 1
        elif tag in _BLOCK:
            self.flush()
            self._anchors = 0
            if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "hr"):
                return
            given = {key: value or "" for key, value in reversed(attrs)}
            names = {_named(name) for key in ("class", "id", "role") for name in given.get(key, "").split()}
            article = (tag in _ARTICLE or given.get("role") in _ARTICLE) and "comment" not in names
            # An article's own header holds its title; any other is the page's.
            furniture = "hidden" in given or tag in _FURNITURE or (tag == "header" and not self._article)
            self._open.append((tag, furniture, article, self._mark))
            self._furniture += furniture
            if article and not self._article:
                self._around.append(self._mark)
            elif tag == "article" and self._mark >= 0 and self._main_only():
                self._around.append(self._mark)
            self._article += article
            names -= {"", "header"} if self._article else {""}
            if names and tag not in ("body", "html") and not article:
                self._marks.append((self._mark, "comment" if "comment" in names else "furniture"))
                self._mark = len(self._marks) - 1

    def _main_only(self) -> bool:
        """Whether no article element is open around the innermost element."""
        return not any(name == "article" and article for name, _, article, _ in self._open[:-1])

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in _SKIP:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            if self._skips[tag]:
                self._drop(tag)
            elif self._left[tag]:
                start, end = self._left[tag].pop()
                self._found[start:end] = [None] * (end - start)
        elif tag == "a":
            self._anchors = max(0, self._anchors - 1)
        elif tag in _BLOCK:
            self.flush()
            at = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag), None)
            if at is not None:
                # Skipped elements inside end with it; without an end tag later on, their text stays.
                while self._skipped and self._skipped[-1].depth > at:
                    skip = self._pop()
                    self._left[skip.tag].append((skip.start, len(self._found)))
                self._close(at)

    def handle_data(self, data: str) -> None:
        if self._skipped and data.strip():
            self._leave_head("")
        if not (self._skips["script"] or self._skips["style"]):
            self._text.append((data, self._anchors > 0))


def blocks(page: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.blocks()


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article")

IN, NONE, OUT = 1, 0, -1

#: The labelled table: pages as rows of blocks in their order. A block is its place (inside
#: the article, no article on the page, outside of it), word count, link density and label:
#: 1 for main text, None for furniture that markup names, a neighbour only.
LABELLED = [
    # Articles between menus and footers.
    [(OUT, 1, 1.0, None), (OUT, 1, 1.0, None), (OUT, 8, 0.0, None), (IN, 10, 0.0, 1), (IN, 90, 0.0, 1), (IN, 1, 0.0, 1), (IN, 240, 0.0, 1), (OUT, 9, 0.0, None)],
    [(OUT, 2, 1.0, None), (IN, 5, 0.0, 1), (OUT, 9, 0.0, None)], [(OUT, 2, 1.0, None), (IN, 2, 0.0, 1), (OUT, 3, 1.0, None)],
    [(OUT, 14, 0.0, None), (IN, 30, 0.0, 1), (OUT, 2, 1.0, None)], [(OUT, 60, 1.0, None), (IN, 3, 0.0, 1), (IN, 2, 0.0, 1), (OUT, 25, 0.9, None)],
    [(IN, 6, 0.0, 1), (IN, 12, 0.0, 1), (IN, 2, 0.0, 1), (IN, 3, 0.0, 1), (IN, 1, 0.0, 1), (IN, 4, 0.0, 1), (IN, 25, 0.0, 1)],
    # Linked titles, linked text and lists of links in articles.
    [(OUT, 1, 1.0, None), (IN, 7, 1.0, 1), (IN, 60, 0.0, 1), (IN, 4, 1.0, 1), (IN, 80, 0.05, 1), (OUT, 3, 1.0, None)],
    [(IN, 40, 0.3, 1), (IN, 22, 0.2, 1), (IN, 35, 0.45, 1), (IN, 12, 0.33, 1), (IN, 50, 0.0, 1), (IN, 9, 1.0, 1), (IN, 33, 0.0, 1)],
    [(IN, 70, 0.0, 1), (IN, 1, 1.0, 0), (IN, 2, 1.0, 0), (IN, 1, 1.0, 0), (IN, 1, 1.0, 0), (IN, 3, 1.0, 0), (IN, 45, 0.0, 1), (IN, 3, 0.0, 1)],
    [(IN, 55, 0.0, 1), (IN, 4, 1.0, 0), (IN, 6, 1.0, 0), (IN, 5, 0.8, 0), (OUT, 9, 0.0, None)], [(IN, 24, 0.0, 1), (IN, 25, 1.0, 0), (IN, 40, 0.0, 1)],
    [(IN, 55, 0.0, 1), (IN, 31, 0.9, 0), (OUT, 8, 0.0, None)], [(IN, 20, 0.0, 1), (IN, 18, 1.0, 0), (IN, 8, 0.0, 1)], [(IN, 90, 0.0, 1), (IN, 60, 0.8, 0), (IN, 30, 0.0, 1)],
    [(IN, 2, 0.0, 1), (IN, 3, 1.0, 0), (IN, 4, 1.0, 0), (IN, 2, 0.0, 1), (IN, 5, 1.0, 0), (IN, 3, 1.0, 0), (IN, 6, 0.0, 1)],
    # Pages without an article: titles, short paragraphs, subheadings and list items among text.
    [(NONE, 3, 1.0, 0), (NONE, 2, 1.0, 0), (NONE, 4, 1.0, 0), (NONE, 8, 0.0, 1), (NONE, 12, 0.0, 1), (NONE, 60, 0.0, 1), (NONE, 3, 0.0, 1), (NONE, 45, 0.0, 1),
     (NONE, 4, 0.0, 1), (NONE, 5, 0.0, 1), (NONE, 2, 0.0, 1), (NONE, 70, 0.0, 1), (NONE, 3, 1.0, 0), (NONE, 2, 1.0, 0)],
    [(NONE, 2, 1.0, 0), (NONE, 7, 0.0, 1), (NONE, 3, 0.0, 1), (NONE, 50, 0.0, 1), (NONE, 20, 0.0, 1), (NONE, 2, 0.0, 1), (NONE, 2, 1.0, 0), (NONE, 3, 1.0, 0)],
    [(NONE, 5, 0.0, 1)], [(NONE, 2, 0.0, 1), (NONE, 3, 0.0, 1)], [(NONE, 200, 0.0, 1)], [(NONE, 9, 0.0, 1), (NONE, 150, 0.0, 1), (NONE, 40, 0.0, 1)],
    [(NONE, 2, 1.0, None), (NONE, 6, 0.0, 1), (NONE, 30, 0.0, 1), (NONE, 4, 0.0, 1), (NONE, 12, 0.0, None)], [(NONE, 1, 1.0, None), (NONE, 25, 0.0, 1), (NONE, 2, 1.0, None)],
    [(NONE, 2, 1.0, 0), (NONE, 26, 0.0, 1), (NONE, 2, 1.0, 0)], [(NONE, 3, 1.0, 0), (NONE, 80, 0.0, 1), (NONE, 5, 1.0, 0), (NONE, 2, 1.0, 0)],
    # Labels among links, and what stands at the ends of such pages.
    [(NONE, 2, 1.0, 0), (NONE, 3, 0.0, 0), (NONE, 2, 1.0, 0)], [(NONE, 1, 1.0, 0), (NONE, 2, 0.0, 0), (NONE, 3, 1.0, 0), (NONE, 5, 1.0, 0), (NONE, 8, 0.0, 0), (NONE, 4, 1.0, 0)],
    [(NONE, 60, 0.0, 1), (NONE, 2, 1.0, 0), (NONE, 2, 1.0, 0), (NONE, 6, 0.0, 0)], [(NONE, 44, 0.0, 1), (NONE, 3, 1.0, 0), (NONE, 9, 0.0, 0)],
    [(NONE, 36, 0.0, 1), (NONE, 9, 0.4, 0)], [(NONE, 60, 0.0, 1), (NONE, 12, 0.5, 0), (NONE, 3, 1.0, 0)], [(NONE, 5, 0.6, 0), (NONE, 8, 0.0, 1), (NONE, 40, 0.0, 1)],
    [(NONE, 4, 0.75, 0), (NONE, 9, 0.0, 1), (NONE, 50, 0.0, 1)], [(NONE, 6, 0.5, 0), (NONE, 4, 0.5, 0), (NONE, 70, 0.0, 1)], [(NONE, 2, 1.0, 0), (NONE, 70, 0.0, 1)],
    # Linked text, linked headings, menus and tag clouds on them.
    [(NONE, 30, 0.0, 1), (NONE, 25, 0.3, 1), (NONE, 45, 0.1, 1), (NONE, 18, 0.28, 1), (NONE, 33, 0.0, 1), (NONE, 40, 0.45, 1), (NONE, 50, 0.0, 1)],
    [(NONE, 60, 0.0, 1), (NONE, 5, 1.0, 1), (NONE, 70, 0.0, 1)], [(NONE, 6, 1.0, 1), (NONE, 75, 0.0, 1)], [(NONE, 40, 0.0, 1), (NONE, 7, 1.0, 1), (NONE, 32, 0.1, 1)],
    [(NONE, 30, 1.0, 0), (NONE, 8, 0.0, 1), (NONE, 60, 0.0, 1)], [(NONE, 200, 1.0, 0), (NONE, 60, 0.0, 1)], [(NONE, 12, 0.9, 0), (NONE, 50, 0.0, 1)],
    [(NONE, 60, 0.0, 1), (NONE, 25, 1.0, 0), (NONE, 50, 0.0, 1)], [(NONE, 58, 0.0, 1), (NONE, 26, 0.96, 0)], [(NONE, 35, 0.0, 1), (NONE, 16, 0.85, 0), (NONE, 20, 0.0, 1)],
    [(NONE, 4, 1.0, 0), (NONE, 22, 0.8, 0), (NONE, 7, 1.0, 0), (NONE, 15, 0.7, 0), (NONE, 3, 1.0, 0)], [(NONE, 45, 0.0, 1), (NONE, 3, 1.0, 0), (NONE, 2, 1.0, 0), (NONE, 3, 1.0, 0), (NONE, 30, 0.0, 1)],
    [(NONE, 2, 1.0, 0), (NONE, 5, 1.0, 0), (NONE, 6, 1.0, 0), (NONE, 60, 0.0, 1)], [(NONE, 3, 1.0, 0), (NONE, 7, 1.0, 0), (NONE, 80, 0.0, 1)],
    [(NONE, 6, 1.0, 0), (NONE, 8, 1.0, 0), (NONE, 45, 0.0, 1)], [(IN, 70, 0.0, 1), (IN, 5, 1.0, 0), (IN, 6, 1.0, 0), (IN, 45, 0.0, 1)],
    [(IN, 20, 0.0, 1), (IN, 8, 0.0, 1), (IN, 5, 1.0, 1), (IN, 6, 0.0, 1), (IN, 9, 0.0, 1)], [(NONE, 30, 0.0, 1), (NONE, 8, 0.0, 1), (NONE, 5, 1.0, 1), (NONE, 9, 0.0, 1), (NONE, 30, 0.0, 1)],
    [(IN, 7, 0.0, 1), (IN, 2, 1.0, 1), (IN, 12, 0.0, 1), (IN, 3, 1.0, 1), (IN, 15, 0.0, 1)], [(NONE, 20, 0.0, 1), (NONE, 3, 1.0, 1), (NONE, 14, 0.0, 1), (NONE, 6, 0.67, 1), (NONE, 11, 0.0, 1)],
    # Short blocks after links: a title where unlinked text follows, a label where links do, a note where nothing does.
    [(NONE, 2, 1.0, 0), (NONE, 5, 0.0, 1), (NONE, 2, 0.0, 1), (NONE, 60, 0.0, 1)], [(NONE, 3, 1.0, 0), (NONE, 9, 0.0, 1), (NONE, 6, 0.0, 1), (NONE, 40, 0.0, 1)],
    [(NONE, 4, 1.0, 0), (NONE, 4, 0.0, 1), (NONE, 30, 0.0, 1)], [(NONE, 1, 1.0, 0), (NONE, 1, 0.0, 1), (NONE, 11, 0.0, 1), (NONE, 24, 0.0, 1)], [(NONE, 9, 1.0, 0), (NONE, 3, 0.0, 1), (NONE, 4, 0.0, 1), (NONE, 18, 0.0, 1)],
    [(NONE, 3, 1.0, 0), (NONE, 4, 0.0, 0), (NONE, 2, 1.0, 0), (NONE, 1, 0.0, 0), (NONE, 6, 1.0, 0)], [(NONE, 2, 1.0, 0), (NONE, 6, 0.0, 0), (NONE, 9, 1.0, 0)], [(NONE, 5, 0.8, 0), (NONE, 9, 0.0, 0), (NONE, 4, 0.6, 0), (NONE, 3, 1.0, 0)],
    [(NONE, 4, 1.0, 0), (NONE, 3, 0.0, 0)], [(NONE, 2, 1.0, 0), (NONE, 12, 0.0, 0)], [(NONE, 6, 1.0, 0), (NONE, 7, 0.0, 0)], [(NONE, 70, 0.0, 1), (NONE, 3, 1.0, 0), (NONE, 50, 0.0, 1)],
    [(NONE, 50, 0.0, 1), (NONE, 8, 0.0, 1)], [(NONE, 40, 0.0, 1), (NONE, 9, 0.0, 1)], [(NONE, 30, 0.0, 1), (NONE, 6, 0.0, 1), (NONE, 7, 0.0, 1)], [(NONE, 25, 0.0, 1), (NONE, 2, 0.0, 1), (NONE, 1, 1.0, 0), (NONE, 2, 1.0, 0)],
    [(NONE, 60, 0.0, 1), (NONE, 8, 0.38, 0)], [(NONE, 28, 0.0, 1), (NONE, 7, 0.43, 0), (NONE, 2, 1.0, 0)], [(NONE, 42, 0.0, 1), (NONE, 5, 0.4, 0), (NONE, 3, 1.0, 0)],
    # Beside an article: slogans, notes and links; text among text.
    [(OUT, 2, 1.0, 0), (OUT, 4, 0.0, 0), (IN, 9, 0.0, 1), (IN, 60, 0.0, 1), (IN, 25, 0.0, 1), (OUT, 6, 0.0, 0), (OUT, 3, 1.0, 0)],
    [(OUT, 12, 0.0, 0), (IN, 7, 0.0, 1), (IN, 100, 0.0, 1), (OUT, 30, 0.0, 0)], [(IN, 80, 0.0, 1), (OUT, 20, 0.0, 0), (OUT, 15, 0.0, 0)],
    [(IN, 45, 0.0, 1), (OUT, 160, 0.0, 0)], [(OUT, 130, 0.0, 0), (IN, 6, 0.0, 1), (IN, 55, 0.0, 1)], [(IN, 60, 0.0, 1), (OUT, 40, 0.9, 0), (OUT, 7, 0.0, 0)],
    [(IN, 90, 0.0, 1), (OUT, 70, 0.0, 1), (OUT, 65, 0.05, 1), (IN, 80, 0.0, 1)], [(IN, 75, 0.0, 1), (OUT, 85, 0.0, 1), (IN, 95, 0.0, 1)], [(IN, 64, 0.0, 1), (OUT, 5, 0.0, 0), (IN, 70, 0.0, 1)],
]


def _row(before: tuple, own: tuple, after: tuple) -> tuple:
    """The features of a block from (article, words, links) of it and its neighbours."""
    return own[1], own[2], before[1], before[2], after[1], after[2], own[0]


_EDGE = (0, 0, 0.0)


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in LABELLED:
        for before, own, after in zip([_EDGE, *page], page, [*page[1:], _EDGE]):
            if own[3] is not None:
                rows.append(_row(before, own, after))
                labels.append(own[3])
    return np.array(rows, dtype=float), np.array(labels, dtype=float)


class Tree:
    """A classification tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 1):
        self.feature, self.value = -1, float(y.mean())
        if depth == 0 or len(y) < 2 * least or self.value in (0.0, 1.0):
            return
        best = len(y) * self.value * (1 - self.value) - 1e-9
        for feature in range(x.shape[1]):
            for cut in (np.unique(x[:, feature])[1:] + np.unique(x[:, feature])[:-1]) / 2:
                left = x[:, feature] < cut
                impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
                if min(left.sum(), (~left).sum()) >= least and impurity < best:
                    best, self.feature, self.cut = impurity, feature, float(cut)
        if self.feature >= 0:
            left = x[:, self.feature] < self.cut
            self.left, self.right = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def __call__(self, row: tuple) -> float:
        node = self
        while node.feature >= 0:
            node = node.left if row[node.feature] < node.cut else node.right
        return node.value


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*labelled_rows())


def main_text(page: str | None) -> str:
    found, grown = blocks(page), tree()
    about = [_EDGE, *[(block.article, block.words, block.links) for block in found], _EDGE]
    return "\n".join(
        block.text for k, block in enumerate(found)
        if not block.furniture and grown(_row(about[k], about[k + 1], about[k + 2])) >= 0.5
    )


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: page_id, url, text, n_chars, one row per row of ``pages``.

    Null or empty html, or a page without main text: empty text, 0 characters. Broken
    markup is read as far as it goes; a head without end tag ends at the first thing it
    cannot hold. Forms, objects and the like that are left out end with their end tag; where
    it is missing their text is judged like any other, so that nothing after them is lost.
    An unclosed script or style holds the rest of the page, as in HTML. Pages of any length
    are read whole. Null ids or urls and repeated rows stay as they are; an empty
    table gives no rows. Other columns are not read. One scan, no shuffle.
    """
    schema = T.StructType([
        T.StructField("page_id", pages.schema[id_col].dataType),
        T.StructField("url", pages.schema[url_col].dataType),
        T.StructField("text", T.StringType(), False),
        T.StructField("n_chars", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, arrow.field("text").type),
                 pa.array([len(t) for t in texts], pa.int64())], schema=arrow,
            )

    columns = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")]
    return pages.select(*columns).mapInArrow(run, schema)
