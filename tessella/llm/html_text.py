"""Main text of web pages by tree scoring.

Markup is read into a light tree. Elements that never are main text (menus, page headers, footers, sidebars, forms,
scripts, styles) are left out by name. Each block of text passes points for its length and its commas to the elements
around it: all to the nearest, half to the next, less further out. An element's points are discounted by the share of
its text that is links. The best container is kept, widened to the article or main element around it if it is a good
part of that, with those siblings that score well beside it.

Words of a class, id or role (adverts, notices, comments of readers and the like) only accuse a container, as does being a form,
or a fieldset outside of an article: some pages wrap all they say in one form. The accused
go if enough of the page's text is left without them, as they do on most pages. If not, the names mislead: the largest
accused containers, outermost first, are acquitted until enough is left; comments of readers, adverts and what is mostly
links never are. Containers around an article or main element aren't accused, nor are paragraphs
within one and headings, whose ids are their words, unless as adverts.

Defined results. Null and empty pages, and pages without main text, give an empty text. Character references
are decoded; white space inside a block becomes one space; blocks are trimmed, empty ones left out, and joined
in page order by one newline. Unclosed and misnested elements are closed where HTML would close them. A tag that never
ends is text; a quote that never ends is an ordinary character. Forms of less than ``FORM`` characters are never acquitted.
Points reach ``LEVELS`` containers up. Nothing else is dropped, whatever the length, and a page of any shape
takes time in proportion to its length. Repeated rows are read one by one; other columns are ignored.
"""

from __future__ import annotations

import heapq
import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import ready

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption summary".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = BLOCK - frozenset("tr tbody thead tfoot colgroup caption".split())  # rows of a table stay together
LEFT_OUT = frozenset("head script style noscript template nav header footer aside button select textarea iframe object embed svg math canvas dialog menu title audio video label".split())
# Words of a class, id or role that accuse an element.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion".split())
READERS = frozenset("comment comments disqus replies respond".split())
MARKS = (
    ADVERTS
    | READERS
    | frozenset(
        "banner sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent notice notices alert popup modal overlay share sharing social related "
        "recommended subscribe newsletter signup login search widget pagination pager toolbar skip contentinfo complementary form".split()
    )
)
#: Share of a page's text that must be left for the accused elements to go.
ENOUGH = 0.25
#: Characters of a form that may be a page's text, and containers up that a block's points reach.
FORM, LEVELS = 400, 64
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}

_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_SPECIAL = re.compile(r"""[>"']""")
#: A tag as most are written: no signs of tags within quotes. No match is looked for beyond the next ``<``.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><"']*+)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


HIDDEN, ADVERT, READER, OTHER = 4, 3, 2, 1


def _marked(attributes: str) -> tuple[int, bool]:
    """What attributes accuse an element of (0: nothing); whether they mark it as the main one."""
    bad, main = 0, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            bad = HIDDEN
        elif name == "role" and value.lower() in ("main", "article"):
            main = True
        elif name != "aria-hidden":
            words = set(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if not words.isdisjoint(MARKS):
                bad = max(bad, READER if words & READERS else ADVERT if words & ADVERTS else OTHER)
    return bad, main


class Tags:
    """Where tags end. A tag ends at the first ``>`` outside of quotes; what follows each quote is looked up once for the whole page."""

    def __init__(self, source: str):
        marks = [(m.start(), m[0]) for m in _SPECIAL.finditer(source)]
        self.places = [p for p, _ in marks]
        #: From each mark on, outside of quotes: the place of the tag's end, or -1.
        self.stop = [-1] * (len(marks) + 1)
        after: dict[str, int] = {}
        for k in range(len(marks) - 1, -1, -1):
            place, sign = marks[k]
            self.stop[k] = place if sign == ">" else self.stop[after.get(sign, k) + 1]
            after[sign] = k

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin here; -1 if none does."""
        return self.stop[bisect_left(self.places, at)]


class Page:
    """The tree of one page: for each element its parent, name, what it is accused of, and whether it is left out or a link."""

    def __init__(self, source: str):
        self.parent, self.tag, self.out, self.link, self.main = [-1], [""], [False], [False], [False]
        self.mark = [0]
        self.within = [False]  # an article or main element
        #: Runs of text: element, block number, text.
        self.runs: list[tuple[int, int, str]] = []
        self.block = 0
        self.owner = [0]  # of each block, the innermost block element
        #: Open elements from the root on; of each name, of block elements and of those that end a search, their places in it.
        self.open = [0]
        self.named: dict[str, list[int]] = defaultdict(list)
        self.blocking: list[int] = []
        self.ending: list[int] = []
        self._read(source)

    def _begin(self) -> None:
        self.block += 1
        self.owner.append(self.open[self.blocking[-1]] if self.blocking else 0)

    def _pop(self, size: int) -> None:
        """Close open elements until so many are left."""
        while len(self.open) > size:
            tag = self.tag[self.open.pop()]
            for places in (self.named[tag], self.blocking, self.ending):
                if places and places[-1] == len(self.open):
                    places.pop()

    def _read(self, source: str) -> None:
        tags, at, last = None, 0, source.rfind(">")
        unclosed: set[str] = set()
        while (lt := source.find("<", at)) >= 0:
            begin, sign = lt, source[lt + 1 : lt + 2]
            if sign in ("!", "?") and sign:
                close = "-->" if source.startswith("<!--", lt) else "]]>" if source.startswith("<![CDATA[", lt) else ">"
                inner = lt + {"-->": 4, "]]>": 9, ">": 2}[close]
                stop = source.find(close, inner)
                self._text(source[at:lt])
                if close == "]]>":
                    self._text(html.escape(source[inner : stop if stop >= 0 else len(source)], quote=False))
                at = stop + len(close) if stop >= 0 else len(source)
                continue
            if lt > last:
                break
            plain = _PLAIN.match(source, lt)
            if plain:
                tag, attributes, stop = plain[2].lower(), plain[3], plain.end() - 1
            else:
                tags = tags or Tags(source)
                name = _NAME.match(source, lt + 1 + (sign == "/"))
                stop = tags.end(name.end()) if name else -1
                if stop < 0:  # no tag: the sign is text
                    self._text(source[at : lt + 1])
                    at = lt + 1
                    continue
                tag, attributes = name[0].lower(), source[name.end() : stop]
            self._text(source[at:begin])
            at = stop + 1
            if sign == "/":
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in RAW and tag != "noscript":
                found = None if tag in unclosed else re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at, last + 1)
                if found is not None:
                    at = found.start()
                elif tag == "title":
                    unclosed.add(tag)  # its content is markup, left out with it
                else:
                    return
        self._text(source[at:])

    def _text(self, text: str) -> None:
        here = self.open[-1]
        if text and not self.out[here]:
            self.runs.append((here, self.block, html.unescape(text) if "&" in text else text))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._close_open({"p"}, {"button", "table", "td", "th", "caption"})
        if tag in CLOSES:
            self._close_open(CLOSES[tag], SCOPE.get(tag, {"table"}))
        if tag in ("html", "body", "head") and self.named[tag]:
            return
        if tag == "body" or (tag in BLOCK and tag not in ("html",)):
            self._close_open({"head"}, set())
        here = self.open[-1]
        bad, main = _marked(attributes) if attributes.strip() else (0, False)
        if tag == "br":
            self._text(" ")
            return
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path")):
            if tag in BLOCK:
                self._begin()
            return
        main = main or tag in ("article", "main")
        if tag == "form" or (tag == "fieldset" and not self.within[here]):
            bad = max(bad, OTHER)
        self.parent.append(here)
        self.tag.append(tag)
        left_out = tag in LEFT_OUT and not (tag == "header" and self.within[here])
        self.out.append(self.out[here] or left_out or bad == HIDDEN)
        self.link.append(self.link[here] or tag == "a")
        self.main.append(main)
        spared = main or tag in ("html", "body") or ((self.within[here] or tag in HEADING) and tag in PARAGRAPH and bad != ADVERT)
        self.mark.append(0 if spared else bad)
        self.within.append(self.within[here] or main)
        if main:  # what is around it can't be something else
            node = here
            while node > 0 and self.mark[node]:
                self.mark[node] = 0
                node = self.parent[node]
        place = len(self.open)
        self.open.append(len(self.tag) - 1)
        self.named[tag].append(place)
        if tag in BLOCK:
            self.blocking.append(place)
            if tag not in ("tr", "tbody", "thead", "tfoot") and tag not in PARAGRAPH:
                self.ending.append(place)
            self._begin()

    def _close_open(self, tags: set[str], scope: set[str]) -> None:
        """Close open elements of these names, up to one of the scope's or another container."""
        edge = max((self.named[t][-1] for t in scope if self.named[t]), default=0)
        edge = max(edge, next((p for p in reversed(self.ending) if self.tag[self.open[p]] not in tags), 0))
        found = [places[k] for places in (self.named[t] for t in tags) if (k := bisect_right(places, edge)) < len(places)]
        if found:
            self._pop(min(found))
            self._begin()

    def _close(self, tag: str) -> None:
        places = self.named[tag]
        if tag not in BLOCK:
            if places and places[-1] > (self.blocking[-1] if self.blocking else 0):  # an inline end tag doesn't close blocks
                self._pop(places[-1])
            return
        if places:
            self._pop(places[-1])
        self._begin()

    def blocks(self) -> list[tuple[int, int, str, int]]:
        """(element, block number, text, characters in links) of each block with text, in page order."""
        out: list[tuple[int, int, str, int]] = []
        k, runs = 0, self.runs
        while k < len(runs):
            number, parts, linked = runs[k][1], [], 0
            while k < len(runs) and runs[k][1] == number:
                node, _, text = runs[k]
                parts.append(text)
                if self.link[node]:
                    linked += len(text.strip())
                k += 1
            text = " ".join("".join(parts).split())
            if text:
                out.append((self.owner[number], number, text, min(linked, len(text))))
        return out


def _accused(page: Page, size: list[int], linked: list[int]) -> list[bool]:
    """Which elements go as accused. Sizes are of all text below an element. Every accused element is looked at once."""
    n, mark = len(page.tag), page.mark
    around, inner = [0] * n, {}  # the nearest accused element around each one (0: none), and the accused next inside
    for k in range(1, n):
        up = page.parent[k]
        around[k] = up if mark[up] else around[up]
        if mark[k]:
            inner.setdefault(around[k], []).append(k)
    left = size[0] - sum(size[k] for k in inner.get(0, ()))
    may_stay = lambda k: mark[k] not in (READER, ADVERT) and 2 * linked[k] < size[k] and (page.tag[k] != "form" or size[k] >= FORM)
    heap = [(-size[k], k) for k in inner.get(0, ()) if may_stay(k)]
    heapq.heapify(heap)
    acquitted = set()
    while heap and left < ENOUGH * size[0]:
        _, best = heapq.heappop(heap)
        if size[best] <= left:
            break
        acquitted.add(best)
        left += size[best] - sum(size[k] for k in inner.get(best, ()))
        for k in inner.get(best, ()):
            if may_stay(k):
                heapq.heappush(heap, (-size[k], k))
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[page.parent[k]] or (bool(mark[k]) and k not in acquitted)
    return gone


def main_text(source: str | None) -> str:
    """The page's main text."""
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks()
    if not blocks:
        return ""
    n = len(page.tag)

    def summed() -> tuple[list[int], list[int]]:
        size, linked = [0] * n, [0] * n
        for node, _, text, links in blocks:
            size[node] += len(text)
            linked[node] += links
        for node in range(n - 1, 0, -1):
            size[page.parent[node]] += size[node]
            linked[page.parent[node]] += linked[node]
        return size, linked

    gone = page.out
    if any(page.mark):
        gone = _accused(page, *summed())
        blocks = [b for b in blocks if not gone[b[0]]]
    size, linked = summed()
    points = [0.0] * n
    up = [-1] * n  # the nearest container around each element
    for node in range(1, n):
        around = page.parent[node]
        up[node] = around if page.tag[around] in CONTAINER or around == 0 else up[around]
    for node, _, text, _ in blocks:
        worth = 1 + text.count(",") + min(len(text) / 100, 3)
        if page.tag[node] in PARAGRAPH or (page.tag[node] not in CONTAINER and node):
            node = up[node]
        for level in range(LEVELS):
            points[node] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node = up[node]
            if node < 0:
                break
    score = [p * (1 - (linked[k] / size[k] if size[k] else 0)) for k, p in enumerate(points)]
    best = max(range(n), key=lambda k: (score[k], page.main[k], -k))
    node = best
    while node > 0:
        if page.main[node]:
            if 3 * size[best] >= size[node] and 2 * linked[node] < size[node]:
                best = node
            break
        node = page.parent[node]
    kept = {best}
    if best > 0:
        least = 0.2 * score[best]
        for k in range(1, n):
            if page.parent[k] == page.parent[best] and k != best and not page.out[k] and not gone[k]:
                dense = linked[k] / size[k] if size[k] else 1.0
                if (score[k] >= least and dense < 0.5) or (page.tag[k] in PARAGRAPH and size[k] > 80 and dense < 0.25 and not page.main[best]):
                    kept.add(k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in kept or (page.parent[k] >= 0 and inside[page.parent[k]])
    return "\n".join(text for node, _, text, _ in blocks if inside[node])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    ready(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(narrow.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return narrow.mapInArrow(work, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
