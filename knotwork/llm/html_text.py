"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser sends its events once through a page. A block tag begins
a new line; a line has its text, its tags, how much of its text stands in links, and
the elements around it. Lines inside menus, page headers and footers, sidebars, notices,
adverts, forms and reader comments (by element, role, or words of class and id) are
boilerplate and have the ratio 0. The ratio of text to tags of the other lines is
smoothed with a Gaussian over neighbouring lines; lines that reach the threshold (one
standard deviation of the smoothed ratios) form clusters, and these choose the region:
the article or main element with most of their text, whole, or, on pages that mark none,
the lines around the clusters in the innermost container of three quarters of it, as far
as the next line that is mostly links. So a short paragraph in the region stays.

A page is read in one piece by one task; nothing is shuffled and nothing grows with
the number of pages.

Defined results: a null or empty page gives an empty text, and so does one without text
outside boilerplate; character references are decoded; white space of any kind inside a
block, a line break element included, becomes one space; equal rows give equal rows; a
page cut short is read as far as it goes, without the tag in which it ends; end tags of elements that aren't open are
passed over; a page without any tag is its own text; null ids and urls are kept, and
columns besides ``page_id``, ``url`` and ``html`` are not looked at.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template head title iframe object embed applet canvas audio video svg math datalist".split())
#: Elements that hold boilerplate.
_BOILERPLATE = frozenset("nav footer aside form dialog menu button select textarea fieldset".split())
#: Elements that begin and end a line.
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Blocks that can hold a region; other blocks are text.
_CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or an id that mark boilerplate.
_MARKS = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar
    navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe
    subscription signup signin login popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus
    respond reply replies toolbar pagination pager copyright disclaimer hidden skip widget""".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG = re.compile(r"<[A-Za-z/!?]")
_HEADING = re.compile(r"h[1-6]$")

#: Width of the Gaussian in lines, the threshold in standard deviations, the share of text that names the innermost
#: container, and the share of link text that makes a line a menu's.
SIGMA, THRESHOLD, INNERMOST, LINKED = 1.0, 1.0, 0.75, 0.5
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


class Lines(HTMLParser):
    """Collects a page's lines: ``lines`` holds (text, tags, link characters, innermost container, boilerplate).
    Containers are numbered as they open, from 1 on; 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.semantic: dict[int, bool] = {}  # containers that are articles or main elements: number to "is an article"
        self.parents = [0]  # of each container
        self.open: list[tuple[str, bool, int]] = []  # name, makes boilerplate, innermost container
        self.counts: dict[str, int] = {}  # open elements by name
        self.silent = self.marked = 0
        self.linked = self.heading = False
        self.text: list[str] = []
        self.tags = self.links = 0

    def line_ends(self) -> None:
        if text := " ".join("".join(self.text).split()):
            inside = self.open[-1][2] if self.open else 0
            kept_title = self.heading and self.marked == self.counts.get("header", 0) and ("article" in self.counts or "main" in self.counts)
            self.lines.append((text, self.tags, self.links, inside, bool(self.marked) and not kept_title))
            self.tags = 0
        self.text.clear()
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self.line_ends()
            self.heading = _HEADING.match(tag) is not None
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.linked = True
        if tag in _VOID or tag not in _BLOCKS and tag not in _SILENT and tag not in _BOILERPLATE:
            return
        if tag not in _CONTAINERS and tag not in _SILENT and tag not in _BOILERPLATE and tag != "header" and not attrs:
            return  # text blocks without attributes need no end: the next block ends them
        inside = self.open[-1][2] if self.open else 0
        marks = tag in _BOILERPLATE or tag == "header" or bool(attrs) and tag not in ("html", "body") and _marked(attrs)
        if tag in _CONTAINERS:
            self.parents.append(inside)
            inside = len(self.parents) - 1
            if not self.marked and not marks and (tag in ("article", "main") or any(k == "role" and v in ("main", "article") for k, v in attrs)):
                self.semantic[inside] = tag == "article"
        self.open.append((tag, marks, inside))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in _SILENT
        self.marked += marks

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self.line_ends()
            self.heading = False
        elif tag == "a":
            self.linked = False
        if not self.counts.get(tag):
            return
        while True:
            name, marks, _ = self.open.pop()
            left = self.counts[name] - 1
            if left:
                self.counts[name] = left
            else:
                del self.counts[name]
            self.silent -= name in _SILENT
            self.marked -= marks
            self.linked = False
            if name == tag:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.linked:
                self.links += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section is passed over up to its ">"."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1


def _marked(attrs: list) -> bool:
    for key, value in attrs:
        if key in ("class", "id"):
            if value and any(w.lower() in _MARKS for w in _WORDS.findall(value)):
                return True
        elif key == "role":
            if value and value.lower() in _ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines; beyond the ends the page has no lines and so no weight."""
    return np.convolve(ratios, _KERNEL)[3:-3] / np.convolve(np.ones(len(ratios)), _KERNEL)[3:-3]


def extract(html: str | None) -> str:
    """The page's main text: its blocks in order, joined by line feeds."""
    if not html:
        return ""
    end = html.rfind(">") + 1  # no tag ends beyond it
    unfinished = _TAG.search(html, end)
    parser = Lines()
    parser.feed(html[: unfinished.start()] if unfinished else html)
    parser.close()
    parser.line_ends()
    lines = parser.lines
    plain = np.array([not line[4] for line in lines], bool)
    if not plain.any():
        return ""
    sizes = np.array([len(line[0]) for line in lines], float)
    ratios = np.where(plain, sizes / np.maximum(1, [line[1] for line in lines]), 0.0)
    smooth = smoothed(ratios)
    seeds = plain & (smooth >= THRESHOLD * smooth.std())
    if not seeds.any():
        seeds = plain
    parents, within = parser.parents, [line[3] for line in lines]
    mass = np.bincount(within, np.where(seeds, sizes, 0.0), len(parents)).tolist()  # text of the clusters in each container
    for number in range(len(parents) - 1, 0, -1):  # inner containers have the larger numbers
        mass[parents[number]] += mass[number]
    if marked := [n for n in parser.semantic if mass[n]]:
        region = max([n for n in marked if parser.semantic[n]] or marked, key=lambda n: (mass[n], -n))
    else:
        region = max(n for n, m in enumerate(mass) if m >= INNERMOST * mass[0])
    held = [region == 0]  # which containers the region holds
    for number in range(1, len(parents)):
        held.append(number == region or held[parents[number]])
    inside = [i for i in np.flatnonzero(plain) if held[within[i]]]
    low, high = 0, len(inside) - 1
    if not marked:
        menu = [lines[i][2] >= LINKED * sizes[i] for i in inside]
        clusters = [k for k, i in enumerate(inside) if seeds[i]]
        low, high = clusters[0], clusters[-1]
        while low and not menu[low - 1]:
            low -= 1
        while high + 1 < len(inside) and not menu[high + 1]:
            high += 1
    return "\n".join(lines[i][0] for i in inside[low : high + 1])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""

    def run(it):
        for batch in it:
            texts = [extract(page.as_py()) for page in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
