"""Main text of web pages by rules over blocks, in two passes.

A page is cut into blocks, the text between tags that begin or end a line. The first pass decides each block that shows
what it is: blocks in menus, headers, footers, sidebars, notices, adverts, forms and reader comments are out, by the
elements, roles and class names they stand in; so are blocks that are mostly links; blocks long enough and rich enough in stop
words are text. In the second pass what is left, short or poor in stop words, takes the label of its nearest decided
neighbour. Neighbours lie in the same region: where a page marks its article (``article``, ``main`` or such a role), a region
is one such element, and one without any decided block is text; pages that mark none are one region, and open blocks in it
without a decided neighbour are out. Where a page marks its article, what stands elsewhere is out.

What is defined:

* null and empty pages, and pages without text that stays, give an empty text;
* character references are decoded once; white space inside a block (that of Unicode) becomes one space, blocks are trimmed and
  joined by two line breaks; nothing else is dropped, and very long pages are read whole;
* markup cut off by the end of the page ends there; what isn't a tag, like ``a < b``, is text;
* a heading between two decided neighbours at one distance goes with the one below, any other block with the text;
* repeated rows give equal rows; an empty table gives none; other columns are not looked at, and may have any names.
"""

from __future__ import annotations

import html
import re
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import each_text, map_arrow

#: Elements that hold no markup; without their end tag they go on to the end of the page.
RAW = frozenset("script style textarea title xmp".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("noscript template svg math iframe object select canvas audio video button head".split())
#: Elements that begin and end a block.
BREAKING = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements and roles that are no part of an article.
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Parts of class names and ids that say the same.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar masthead footer "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond widget toolbar pagination pager copyright disclaimer".split()
)
#: What heads a page, but inside an article has its title.
HEADER = frozenset(("header",))
#: A name part before which the next ones describe the page and not the element.
DESCRIBING = frozenset("has with no without is hide show js".split())
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with be by this from or an at not but have had they you which were their has one all we can her his if will there "
    "der die das und ist nicht ein eine den von zu mit sich auf für des im dem auch es an als wie bei oder nach aus wird sind noch nur "
    "le la les et est une un des dans que qui pour pas sur au avec par plus ce ne se sont ou mais aux du de en il elle "
    "el los las y que una por con para como más pero sus al lo no su se del son o fue".split()
)

MAX_LINK_SHARE = 0.5
MIN_CHARS = 70
MIN_STOP_SHARE = 0.2

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)(?:>|\Z)"
    r"|<[a-z!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([a-z][-\w:]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block, what of it is links, and where it stands."""

    __slots__ = ("text", "chars", "linked", "outside", "region", "heading", "label")

    def __init__(self, text: str, linked: int, outside: bool, region: int, heading: bool) -> None:
        self.text, self.linked, self.outside, self.region, self.heading = text, linked, outside, region, heading
        self.chars, self.label = len(text), None


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id says that the element is one of ``names``."""
    for name in value.split():
        describing = False
        for part in map(str.lower, _NAME_PART.findall(name)):
            if part in names and not describing:
                return True
            describing = part in DESCRIBING or describing
    return False


def _by_element(name: str) -> str:
    return "in" if name in ("main", "article") else name if name in ("form", "header") else "out" if name in OUTSIDE else ""


def _place(name: str, attributes: str) -> str:
    """'in' for an element that marks the article, 'out' for one that is no part of it, 'form' and 'header' for these, else ''."""
    if not attributes:
        return _by_element(name)
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role, named = given.get("role", "").lower(), f"{given.get('class', '')} {given.get('id', '')}"
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return "out"
    if name in ("html", "body"):
        return ""
    if name == "main" or role == "main":
        return "in"
    if role in OUTSIDE_ROLES or _named(named, OUTSIDE_NAMES):
        return "out"
    if role == "article" or given.get("itemprop", "") == "articleBody":
        return "in"
    return _by_element(name) or ("header" if _named(named, HEADER) else "")


class _Reader:
    """Open elements and the block that is being read."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        #: (name, whether out, region or 0, whether a heading, whether dropped) of the elements that matter
        self.stack: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]
        self.parts: list[str] = []
        self.linked, self.in_link, self.regions = 0, False, 0

    def text(self, text: str) -> None:
        if not self.stack[-1][4]:
            self.parts.append(text)
            if self.in_link:
                self.linked += len(" ".join(html.unescape(text).split()))

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            _, outside, region, heading, _ = self.stack[-1]
            self.found.append(Block(text, self.linked, outside, region, heading))
        self.parts.clear()
        self.linked = 0

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                if not self.stack[k][4]:
                    self.end_block()
                del self.stack[k:]
                return

    def open(self, name: str, attributes: str) -> None:
        top, outside, region, heading, dropped = self.stack[-1]
        if top == "head" and (name in BREAKING or name == "body"):  # its end tag may be left out
            self.stack.pop()
            top, outside, region, heading, dropped = self.stack[-1]
        if dropped or name in DROPPED:
            self.stack.append((name, outside, region, heading, True))
            return
        place = _place(name, attributes)
        if not place and name not in BREAKING:
            return
        if name == top and name in ("p", "li"):  # so may theirs
            self.close(name)
            _, outside, region, heading, _ = self.stack[-1]
        self.end_block()
        if place == "in" and (not outside or top == "form" or name == "main"):
            outside = False
            if not region:
                self.regions += 1
                region = self.regions
        elif place and not (place == "header" and region):
            outside = True
        self.stack.append((name, outside, region, heading or name in HEADINGS, False))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, none of them empty."""
    reader, at = _Reader(), 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if name in BREAKING:
            reader.end_block()
            reader.in_link = False
        elif name == "a":
            reader.in_link = not m["close"]
        elif name == "br":
            reader.text(" ")
        if m["close"]:
            reader.close(name)
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name and name not in VOID and not m["attributes"].endswith("/"):
            reader.open(name, m["attributes"])
    reader.end_block()
    return reader.found


def _first_pass(all_blocks: list[Block]) -> None:
    """Label the blocks that show what they are: True is text, False is not."""
    marked = any(b.region and not b.outside for b in all_blocks)
    for b in all_blocks:
        if b.outside or marked and not b.region or b.linked > MAX_LINK_SHARE * b.chars:
            b.label = False
        elif b.chars >= MIN_CHARS:
            words = _WORD.findall(b.text.lower())
            if sum(map(STOP_WORDS.__contains__, words)) >= MIN_STOP_SHARE * max(1, len(words)):
                b.label = True


def _second_pass(all_blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of their region; a region without one is text if marked."""
    by_region: dict[int, list[Block]] = {}
    for b in all_blocks:
        if not b.outside:
            by_region.setdefault(b.region, []).append(b)
    for region, own in by_region.items():
        labels = [b.label for b in own]
        above, below = [None] * len(own), [None] * len(own)
        last = None
        for k, label in enumerate(labels):
            last = k if label is not None else last
            above[k] = last
        last = None
        for k in range(len(own) - 1, -1, -1):
            last = k if labels[k] is not None else last
            below[k] = last
        for k, b in enumerate(own):
            if b.label is not None:
                continue
            a, z = above[k], below[k]
            if a is None and z is None:
                b.label = region > 0
            elif a is None or z is None:
                b.label = labels[z if a is None else a]
            elif k - a == z - k:
                b.label = labels[z] if b.heading else labels[a] or labels[z]
            else:
                b.label = labels[a if k - a < z - k else z]


def classified(page: str | None) -> list[Block]:
    """All blocks of a page, labelled."""
    found = blocks(page or "")
    _first_pass(found)
    _second_pass(found)
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classified(page) if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars, n_blocks, n_kept."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    names = ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for page in each_text(batch.column(2)):
            found = classified(page)
            kept = [b.text for b in found if b.label]
            texts.append("\n\n".join(kept))
            counts.append((len(texts[-1]), len(found), len(kept)))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *columns], names=names)

    own = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    return map_arrow(own, run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")
