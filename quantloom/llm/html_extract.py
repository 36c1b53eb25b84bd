"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, clusters.

The standard library's streaming parser turns a page into lines, one a block element.
A line's text-to-tag ratio is its text by the tags that it took, link text at a tenth. Lines
whose markup names something else (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles, hidden parts) have ratio 0. The ratios are smoothed with
a Gaussian among lines of the same kind, and lines above the threshold (the smaller of mean
and standard deviation) form the clusters. The clusters choose the text:

* the region is the innermost element that holds nearly all cluster text, but no deeper
  than the article or main element (with most cluster text) on the way there;
* the clusters' lines of the region are kept, and what the region holds between and beside
  them with a ratio over 0 (short lines, lists of links);
* a paragraph right before or after the region, beside it in its parent, stays if it is
  of a cluster and reaches the threshold by itself; so does the page's last first- or
  second-level heading before the region if the region has none at its start.

A page without clusters has no text.

A class word or a form may also stand on what holds the article (``has-sidebar``, a page in
one form). Where such marks leave under a tenth of the page's text, those whose other words
name the article are no marks, or else the outermost that holds at least half of the text,
and the page is read anew.

Defined cases: null or empty html gives empty text and 0 characters; a page of bare text
is one block; unclosed and stray tags are repaired as the parser meets them; rows without
an id and rows that share one are kept as they are; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_within

SIGMA = 1.0
#: A child that holds this share of its parent's cluster text is entered.
ENTER = 0.9
#: An article or main element with this share of the page's cluster text bounds the region.
SHARE = 0.5
#: Under this share of its text without a mark, a page's outermost marks are judged by what they hold.
UNMARKED = 0.1
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption legend option".split())
#: Elements whose content is never the article.
OTHER = frozenset("script style template noscript head nav footer aside form button select textarea iframe object svg canvas dialog menu audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name something else than the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense adsbygoogle sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs masthead header footer sidebar sidenav widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond form search pagination pager toolbar skip legal copyright disclaimer".split()
)
#: With one of these words a "header" or "form" belongs to the article.
OWN = frozenset("article post entry story content body main".split())
_CLOSES_P = BLOCK - {"option", "caption", "legend"}
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Page(HTMLParser):
    """Lines (text, tags, link characters, element, other) and the element tree."""

    def __init__(self, exempt: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.exempt = exempt
        #: elements marked by a class word or as a form, with whether other words name the article; lines that no other mark covers
        self.soft: dict[int, bool] = {}
        self.hard = [False]
        self.judged: list[bool] = []
        self.parent, self.tag = [-1], ["#page"]
        self.open, self.count = [0], Counter()
        self.other = [False]
        self.links = 0
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self._own = False
        self._text: list[str] = []
        self._tags = self._link_chars = 0
        self._at = 0

    def flush(self) -> None:
        text = " ".join("".join(self._text).split()) if self._text else ""
        if text:
            self.lines.append((text, max(1, self._tags), self._link_chars, self._at, self.other[-1]))
            self.judged.append(not self.hard[-1])
            self._tags = 0
        self._text, self._link_chars = [], 0

    def _is_other(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """0 for what may be the article, 1 for a mark that what it holds may outweigh, 2 for one that stands."""
        if tag in OTHER and tag != "form":
            return 2
        inside = self.count["article"] or self.count["main"]
        if tag == "header" and not inside:
            return 2
        words: set[str] = set()
        for k, v in attrs:
            v = v or ""
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v in ROLES) or (k == "style" and _HIDDEN.search(v)):
                return 2
            if k in ("class", "id"):
                words.update(w.lower() for w in _WORDS.findall(v))
        self._own = bool(words & OWN)
        if tag == "form":
            return 1
        if tag in ("html", "body", "main") or not words:
            return 0
        named = words & NAMED
        if named <= {"header", "legal", "search", "form", "notice", "alert"} and (inside or words & OWN) and tag not in ("div", "section", "ul"):
            return 0
        if named == {"header"} and (inside or words & OWN):
            return 0
        return int(bool(named))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCK:
            self.flush()
            if tag in _CLOSES_P and self.count["p"]:
                self._close("p")
            if tag == "li" and self.count["li"] and self.tag[self.open[-1]] == "li":
                self._close("li")
        elif tag in ("br", "td", "th"):
            self._text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.count[tag] += 1
        mark = self._is_other(tag, attrs)
        if mark == 1:
            if len(self.tag) - 1 in self.exempt:
                mark = 0
            else:
                self.soft[len(self.tag) - 1] = self._own
        is_other = self.other[-1] or mark > 0
        if is_other != self.other[-1] or (mark == 2) > self.hard[-1]:
            self.flush()
        self.open.append(len(self.tag) - 1)
        self.other.append(is_other)
        self.hard.append(self.hard[-1] or mark == 2)
        self._at = self.open[-1]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Closes elements up to the innermost open ``tag``; a paragraph never closes what holds it."""
        while True:
            name = self.tag[self.open[-1]]
            ended = (self.other[-1], self.hard[-1]) != (self.other[-2], self.hard[-2])
            if name in BLOCK or ended:
                self.flush()
            self.open.pop()
            self.other.pop()
            self.hard.pop()
            self.count[name] -= 1
            if name == "a":
                self.links -= 1
            if name == tag:
                break
        self._at = self.open[-1]

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in ("td", "th"):
            self._text.append(" ")
        if tag in BLOCK:
            self.flush()
        if self.count[tag] > 0 and tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self._text.append(data)
        if self.links:
            self._link_chars += len(data)


def smooth(ratio: np.ndarray, kind: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing of each line by those of its kind, with the kernel renormalised."""
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    out = np.zeros(len(ratio))
    for k in (False, True):
        own = (kind == k).astype(float)
        near = np.convolve(own, kernel, "full")[r : r + len(ratio)]
        total = np.convolve(ratio * own, kernel, "full")[r : r + len(ratio)]
        out += own * total / np.maximum(near, 1e-9)
    return out


def clusters(ratio: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, float]:
    """Lines whose smoothed ratio is over 0 and reaches the threshold; and the threshold."""
    s = smooth(ratio, kind)
    least = float(min(s.mean(), s.std()))
    return (s > 0) & (s >= least), least


_LAYOUT = frozenset("#page html body div section center table tbody tr td main article".split())


def _region(page: _Page, mass: list[float]) -> int:
    """The element whose lines are kept, from the cluster text of every element."""
    children: dict[int, list[int]] = {}
    for e in range(1, len(page.tag)):
        if page.tag[e] in BLOCK and mass[e]:
            children.setdefault(page.parent[e], []).append(e)
    named = [e for e in range(len(page.tag)) if page.tag[e] in ("article", "main") and mass[e] >= SHARE * mass[0]]
    best = max(named, key=lambda e: (mass[e], -e), default=None)
    at = 0
    while at != best:
        held = children.get(at, ())
        way = [e for e in held if best is not None and _holds(page, e, best)]
        big = way or [e for e in held if mass[e] >= ENTER * mass[at] and page.tag[e] in _LAYOUT]
        if not big:
            break
        at = big[0]
    return at


def _holds(page: _Page, outer: int, inner: int) -> bool:
    while inner > outer:
        inner = page.parent[inner]
    return inner == outer


def _outweighed(page: _Page) -> set[int]:
    """Of a page that marks leave nearly nothing of: the soft marks that also name the article, else the outermost that hold at least half of it."""
    mass = [0.0] * len(page.tag)
    bare = 0.0
    for (text, _, link, at, other), judged in zip(page.lines, page.judged, strict=True):
        if judged:
            own = len(text) - 0.9 * min(link, len(text))
            mass[at] += own
            bare += 0.0 if other else own
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    if bare >= UNMARKED * mass[0]:
        return set()
    named = {e for e, own in page.soft.items() if own and mass[e] >= UNMARKED * mass[0]}
    if named:
        return named
    large = {e for e in page.soft if mass[e] >= SHARE * mass[0]}

    def within(e: int) -> bool:
        while e > 0:
            e = page.parent[e]
            if e in large:
                return True
        return False

    return {e for e in large if not within(e)}


def _read(html: str) -> _Page:
    exempt: frozenset[int] = frozenset()
    while True:
        page = _Page(exempt)
        page.feed(html)
        page.close()
        page.flush()
        more = _outweighed(page) if page.soft else set()
        if not more:
            return page
        exempt |= more


def extract(html: str) -> str:
    """The article's blocks, joined by an empty line."""
    page = _read(html)
    lines = page.lines
    if not lines:
        return ""
    kind = np.array([x[4] for x in lines])
    ratio = np.array([0.0 if other else (len(text) - 0.9 * min(link, len(text))) / tags for text, tags, link, _, other in lines])
    hot, least = clusters(ratio, kind)
    if not hot.any():
        return ""
    mass = [0.0] * len(page.tag)
    for (text, _, link, at, _), h in zip(lines, hot.tolist(), strict=True):
        if h:
            mass[at] += len(text) - 0.9 * min(link, len(text))
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
    root = _region(page, mass)
    inside = [False] * len(mass)
    inside[root] = True
    for e in range(root + 1, len(mass)):
        inside[e] = inside[page.parent[e]]
    keep = [i for i, x in enumerate(lines) if inside[x[3]] and (hot[i] or ratio[i] > 0)]
    beside = page.parent[root]

    def joins(i: int) -> bool:
        own = lines[i][3]
        return bool(hot[i]) and ratio[i] >= least and (own == beside or (page.parent[own] == beside and page.tag[own] in ("p", "blockquote")))

    for step in (-1, 1):
        i = keep[0] - 1 if step < 0 else keep[-1] + 1
        while 0 <= i < len(lines) and joins(i):
            keep.append(i)
            i += step
    keep.sort()
    if page.tag[lines[keep[0]][3]] not in ("h1", "h2"):
        heading = [i for i in range(keep[0]) if ratio[i] > 0 and page.tag[lines[i][3]] in ("h1", "h2")]
        keep = heading[-1:] + keep
    return "\n\n".join(lines[i][0] for i in keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_within(batches, 8 << 20, 2):
            text = [extract(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
