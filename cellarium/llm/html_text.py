"""Main text of HTML pages.

The standard library's parser streams events. Block-level tags end a line; each line has its text, its number of tags
and the elements around it. The text-to-tag ratios are smoothed with a Gaussian, two clusters of the smoothed values
give a threshold. The lines above it, whose own ratios aren't far below it, are content; their article, or else their common container, is kept whole, with the
lists, tables and short lines in it. An article or main element is a prior only: its lines need half of the threshold,
and it is kept with one such line, or if it holds half of the page's text; text outside it is judged as on any other page.
What stands in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by
element, role, class or id, never counts.

Defined results: null or empty html gives an empty text; a page that breaks off gives the text up to there; rows that
repeat give rows that repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_pass, batch_of, table

SIGMA = 1.5
#: A line counts as content only if its own ratio is this part of the threshold at least: smoothing lifts what stands beside text.
OWN = 0.25
#: A line of an article or main element counts as content from this part of the threshold on.
PRIOR = 2.0

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form script style noscript template button select option textarea iframe object svg canvas menu dialog head title audio video input".split())
_ARTICLE = frozenset(("article", "main"))
_HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
_FRAMES = frozenset(("html", "body"))
_RAW = frozenset(("script", "style"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of what isn't main text. The first also count as a part of a longer name.
_PARTS = frozenset(
    "ad ads adv advert advertisement adverts adbox sponsor sponsored promo promotion sidebar navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login sharing disqus widget toolbar pagination pager "
    "comments commentlist replies recommended".split()
)
_HEADS = frozenset("header masthead topbar".split())
_NAMES = _PARTS | _HEADS | frozenset("banner side menu nav footer notice alert search share social related comment respond reply skip".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Lines(HTMLParser):
    """Lines of a page: [text pieces, tags, dropped, region, characters in links]. Regions form a tree by their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # name, dropped, region, in an article
        self.parents = [0]
        self.articles: set[int] = set()
        self.frames = {0}
        self.linked = False
        self._start()

    def _start(self):
        _, dropped, region, _ = self.stack[-1] if self.stack else ("", False, 0, False)
        self.line = [[], 0, dropped, region, 0]
        self.lines.append(self.line)

    def handle_starttag(self, tag, attrs):
        self.line[1] += 1
        if tag == "br":
            self.line[0].append(" ")
        if tag in _VOID:
            if tag == "hr":
                self._start()
            return
        _, dropped, region, article = self.stack[-1] if self.stack else ("", False, 0, False)
        hidden = tag in _DROPPED or tag == "header" and not article or tag not in ("body", "html", *_ARTICLE) and self._named(tag, attrs, article) or tag in _ARTICLE and article and self._named(tag, attrs, article)
        if tag in _INLINE and not hidden and not (self.stack and self.stack[-1][0] in _INLINE):  # what is inside a hidden one ends before it
            self.linked |= tag == "a"
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and any(x[0] == tag for x in self.stack[-1:]):
            self.stack.pop()
            _, dropped, region, article = self.stack[-1] if self.stack else ("", False, 0, False)
        if tag in _ARTICLE and not article and not (dropped or hidden):
            region, article = self._region(region), True
            self.articles.add(region)
        elif not article and tag not in _HOLDERS:
            region = self._region(region)
            if tag in _FRAMES:
                self.frames.add(region)
        self.stack.append((tag, dropped or hidden, region, article))
        self._start()

    def _region(self, parent: int) -> int:
        self.parents.append(parent)
        return len(self.parents) - 1

    @staticmethod
    def _named(tag, attrs, article) -> bool:
        """Whether an element's names say that it isn't main text.

        Paragraphs, headings and inline elements go by whole class names or _PARTS only; their ids are anchors. Inside an
        article, ids count whole, and what is named a header is the article's own."""
        text = tag in _HOLDERS or tag in _INLINE
        for k, v in attrs:
            if not v:
                if k == "hidden":
                    return True
            elif k == "role" and v.lower() in _ROLES or k == "aria-hidden" and v == "true":
                return True
            elif k == "class" or k == "id" and not text:
                for name in v.lower().split():
                    parts = _SPLIT.split(name)
                    if article and not _HEADS.isdisjoint(parts):
                        continue
                    if name in _NAMES or not _PARTS.isdisjoint(parts):
                        return True
                    if not text and not (k == "id" and (article or tag == "section")) and not _NAMES.isdisjoint(parts):
                        return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.line[1] += 1
        if tag == "br":
            self.line[0].append(" ")
        elif tag not in _INLINE:
            self._start()

    def handle_endtag(self, tag):
        self.line[1] += 1
        self.linked &= tag in _INLINE and tag != "a"
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                self._start()
                return
            if tag in ("p", "li", "div", "span") and self.stack[i][0] in ("nav", "aside", "footer", "form", "article", "main", "table"):
                break  # a stray end tag doesn't close the section around it
        if tag == "p":
            self._start()

    def handle_data(self, data):
        if self.cdata_elem is None or self.cdata_elem not in _RAW:
            self.line[0].append(data)
            if self.linked:
                self.line[4] += len("".join(data.split()))


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma) + 1
    x = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    x /= x.sum()
    return np.convolve(np.pad(values, reach, mode="edge"), x, mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between the centres of two clusters of the values."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        a, b = values[values < cut], values[values >= cut]
        if not len(a) or not len(b):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def chosen(parser: _Lines, regions: list[int], size: np.ndarray, linked: np.ndarray, content: np.ndarray) -> list[bool]:
    """Which lines belong to the main text, given their regions, which are mostly links, and which are content.

    From the whole page the search goes down to the only region that has content, as far as there is one. What it ends at
    is an article, or the common container of the content lines; either is kept whole. Only regions without content that
    stand before the first content line or after the last one and are mostly links go from a container: menus without a
    name. A container that has content lines of its own, and isn't the page, keeps these too. Where articles are
    among several regions with content, each region is searched on its own.
    """
    k = len(parser.parents)
    text, links, mass, first, last, own = [0.0] * k, [0.0] * k, [0.0] * k, [len(regions)] * k, [-1] * k, [False] * k
    for i, (r, n, link, good) in enumerate(zip(regions, size, linked, content, strict=True)):
        text[r] += n
        links[r] += n * link
        if good:
            mass[r] += n
            own[r] = True
        first[r], last[r] = min(first[r], i), i
    holds = [r in parser.articles for r in range(k)]
    whole = float(size.sum())
    below: list[list[int]] = [[] for _ in range(k)]
    for r in range(k - 1, 0, -1):  # a region's number is above its parent's
        p = parser.parents[r]
        if r in parser.articles and 2 * text[r] >= whole:
            mass[r] = max(mass[r], 1.0)
        text[p], links[p], mass[p] = text[p] + text[r], links[p] + links[r], mass[p] + mass[r]
        first[p], last[p] = min(first[p], first[r]), max(last[p], last[r])
        holds[p] = holds[p] or holds[r] and mass[r] > 0
        if text[r]:
            below[p].append(r)
    at = np.flatnonzero(content)
    kept, open_, done = set(), [0], []  # regions whose own lines stay; those to search, those to keep whole
    while open_:
        r = open_.pop()
        heavy = [c for c in below[r] if mass[c]]
        if r in parser.articles:
            done.append(r)
        elif not own[r] and len(heavy) == 1:
            open_ += heavy
        elif holds[r]:
            if own[r]:
                kept.add(r)
            open_ += heavy
        else:
            kept.add(r)
            lo, hi = at[np.searchsorted(at, first[r])], at[np.searchsorted(at, last[r], side="right") - 1]
            ends = r in parser.frames or not own[r]
            done += [c for c in below[r] if not (ends and not mass[c] and (last[c] < lo or first[c] > hi) and 2 * links[c] > text[c])]
    while done:
        r = done.pop()
        kept.add(r)
        done += below[r]
    return [r in kept for r in regions]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = [(" ".join("".join(x[0]).split()), *x[1:]) for x in parser.lines if not x[2]]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    raw = size / np.maximum(1, [x[1] for x in lines])
    ratio = smoothed(raw)
    inside = np.array([x[3] in parser.articles for x in lines])
    cut = threshold(ratio)
    content = ratio * np.where(inside, PRIOR, 1.0) >= cut
    if (dense := content & (raw >= OWN * cut)).any():
        content = dense
    linked = np.array([2 * x[4] > len(x[0]) - x[0].count(" ") for x in lines])
    if (content & ~linked).any():  # smoothing lifts a menu beside the text
        content &= ~linked
    keep = chosen(parser, [x[3] for x in lines], size, linked, content)
    return " ".join(x[0] for x, good in zip(lines, keep, strict=True) if good)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield batch_of(_SCHEMA, page_id=b.column(0), url=b.column(1), text=texts, n_chars=list(map(len, texts)))

    return arrow_pass(pages.select(pages[id_col].cast("long"), pages[url_col], pages[html_col]), run, "page_id long, url string, text string, n_chars long")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_main_text": op7_html_main_text}
ORACLE: dict[str, str] = {}
