"""Main text of HTML pages by text-to-tag ratios (operator 7).

The standard library's parser streams events. Text between block boundaries makes a line; its
ratio is the logarithm of 1 + its characters outside links per tag. Ratios are smoothed by a
Gaussian over neighbouring lines along the document tree: where one region ends and another begins,
lines stand ``GAP`` further apart. Hints then weaken a line's level: by
``KIND`` in elements that are boilerplate by their kind (nav, footer, aside, form, ... or a container
whose class, id or role names a menu, an advert, comments, ...), by ``OUTSIDE`` (the
nearer to it, the more text they hold) outside a page's article and main elements. Two means of the levels give a threshold, ``cut`` of
the way from the low to the high one, that parts the lines into two clusters.

A region is an element that can hold a whole text (article, main, section, div, td, body). Its worth
is the characters of its lines in the high cluster less those of its lines in the low one; the region
of the highest worth is the content. Without an h1 it is widened to a region around it, not the page, that
has one and is worth ``WIDE`` as much. If lines of the low cluster show that it holds more than the content, it is
left for a region inside that has two or more lines of the high cluster, at least ``SHARE`` of the worth and every
h1, unless it has high lines of its own. Then it is widened to the article or main element around it if that is worth anything. It gives all of its lines, short ones and
lists of links too, but those of the low cluster that a hint weakened or, where the region is the page
as a whole, that stand in a list of at least ``LINKS`` lines of link text alone.

Character references are decoded, white space in a line becomes one space, lines are trimmed, empty
ones go, the rest is joined by ``\\n`` in page order. Null, empty and text-free pages, and pages
of nothing but hinted boilerplate, give an empty string. Broken nesting is read as browsers do in the
main: an end tag closes the nearest open element of its name, a block closes an open paragraph.
Nothing is cut, however long. Repeated rows give equal results, an empty table an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of the HTML standard by role, and words that name boilerplate in classes, ids and roles.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript template iframe svg head title textarea select datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH_ENDS = BLOCKS - frozenset(["html", "body", "head"])
REGIONS = frozenset("article main section div td body".split())
NAMED = frozenset("aside details div dl header ol section span table ul".split())  # elements whose names are hints
NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets".split())
OUTER_NAMES = frozenset("banner copyright dropdown footer header login masthead topbar".split())  # hints outside articles only
OWN_NAMES = frozenset("article entry post title".split())  # as in "entry-header": no outer hint
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIGMA, CUT, KIND, OUTSIDE, LINKS, GAP, SHARE, WIDE = 1.0, 0.5, 0.2, 0.5, 3, 1.0, 0.5, 0.9
_WORD = re.compile(r"[a-z0-9]+")


class Line(NamedTuple):
    text: str
    ratio: float
    linked: float  # the share of its characters that are link text
    hinted: bool
    region: int
    article: int  # the region of the article or main element around it, 0 for none
    group: int  # the innermost block element that is no paragraph, for lists of links
    top: bool  # in an h1


class _Lines(HTMLParser):
    """Collects the lines, and for each region the one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.outer = [0]  # region 0 is the page
        self.body = 0  # the body's region
        self.open: list[tuple[str, bool, bool, int, int, int]] = []  # name, skipped, hinted, region, article, group
        self.parts: list[str] = []
        self.tags = self.links = self.link_depth = self.groups = 0

    def state(self) -> tuple[bool, bool, int, int, int]:
        return self.open[-1][1:] if self.open else (False, False, 0, 0, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, hinted, region, article, group = self.state()
            linked = min(1.0, self.links / len(text))
            self.lines.append(Line(text, math.log1p(len(text) * (1 - linked) / max(1, self.tags)), linked, hinted, region, article, group, any(x[0] == "h1" for x in self.open[-3:])))
        self.parts, self.tags, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
            self.link_depth = 0 if tag in REGIONS else self.link_depth
            if tag in PARAGRAPH_ENDS:
                self.leave("p", top_only=True)
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                self.leave(tag, top_only=True)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        self.link_depth += tag == "a"
        named = dict(attrs)
        hidden, role = "hidden" in named, (named.get("role") or "").lower()
        words = set(_WORD.findall(f"{named.get('class') or ''} {named.get('id') or ''}".lower())) if tag in NAMED else set()
        skipped, hinted, region, article, group = self.state()
        if tag not in BLOCKS and tag not in SKIPPED and not words and not role and not hidden:
            return
        before = hinted
        hinted = hinted or tag in BOILERPLATE or hidden or role in ROLES or bool(words & NAMES) or (not article and (tag == "header" or bool(words & OUTER_NAMES and not words & OWN_NAMES)))
        if tag in REGIONS:
            self.outer.append(region)
            region = len(self.outer) - 1
            self.body = region if tag == "body" else self.body
            article = article or (region if tag in ("article", "main") else 0)
        if tag in BLOCKS and tag not in ("p", "li", "dt", "dd", "tr", "td", "th"):
            self.groups += 1
            group = self.groups
        if tag not in BLOCKS and hinted and not before:
            self.flush()
        self.open.append((tag, skipped or tag in SKIPPED, hinted, region, article, group))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def leave(self, tag: str, top_only: bool = False) -> None:
        if top_only:
            if self.open and self.open[-1][0] == tag:
                self.open.pop()
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag not in BLOCKS and self.open[k][2]:
                    self.flush()
                del self.open[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link_depth = max(0, self.link_depth - 1)
        if tag in BLOCKS:
            self.flush()
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.state()[0]:
            self.parts.append(data)
            if self.link_depth:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, place: np.ndarray | None = None) -> np.ndarray:
    """Gaussian means over neighbouring lines, normalised at the ends. place: where the lines stand, ascending by 1 or more; else one after another."""
    place = np.arange(len(ratios)) if place is None else place
    total, weight = ratios.astype(float), np.ones(len(ratios))
    for k in range(1, min(max(1, int(np.ceil(3 * sigma))), len(ratios) - 1) + 1):
        w = np.exp(-0.5 * ((place[k:] - place[:-k]) / sigma) ** 2)
        total[k:] += w * ratios[:-k]
        total[:-k] += w * ratios[k:]
        weight[k:] += w
        weight[:-k] += w
    return total / weight


def two_means(levels: np.ndarray) -> tuple[float, float]:
    """The means of two clusters on a line, found from the extremes; equal if all levels are."""
    low, high = float(levels.min()), float(levels.max())
    while low < high:
        upper = levels > (low + high) / 2
        now = float(levels[~upper].mean()), float(levels[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return low, high


def main_text(html: str | None, sigma: float = SIGMA, cut: float = CUT) -> str:
    """The lines of the content region."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines, outer = parser.lines, parser.outer
    if all(x.hinted for x in lines):
        return ""
    length = sum(len(x.text) for x in lines if not x.hinted)
    share = sum(len(x.text) for x in lines if x.article and not x.hinted) / length
    factor = np.array([(KIND if x.hinted else 1.0) * (1.0 if x.article else 1.0 - (1.0 - OUTSIDE) * share) for x in lines])
    region_of = np.array([x.region for x in lines])
    place = np.arange(len(lines)) + GAP * np.r_[0, np.cumsum(region_of[1:] != region_of[:-1])]
    level = factor * smoothed(np.array([x.ratio for x in lines]), sigma, place)
    low, high = two_means(level)
    content = level >= low + cut * (high - low)
    worth, high_lines, low_lines, tops = ([0] * len(outer) for _ in range(4))
    top_article = {x.region: x.article for x in lines}
    own = {x.region for x, good in zip(lines, content, strict=True) if good or x.top}
    for x, good in zip(lines, content, strict=True):
        worth[x.region] += len(x.text) if good else -len(x.text)
        (high_lines if good else low_lines)[x.region] += 1
        tops[x.region] += x.top and not x.hinted
    inner: dict[int, list[int]] = {}
    for region in range(len(outer) - 1, 0, -1):  # inner regions have higher numbers
        inner.setdefault(outer[region], []).append(region)
        for sums in (worth, high_lines, low_lines, tops):
            sums[outer[region]] += sums[region]
    used = sorted({x.region for x in lines} | {0})
    for region in list(used):
        while region:
            region = outer[region]
            used.append(region)
    best = max(sorted(set(used)), key=lambda r: worth[r])
    up = outer[best]
    while up not in (0, parser.body) and not tops[best] and worth[up] >= WIDE * worth[best]:
        best = up if tops[up] else best
        up = outer[up]
    while best not in own and best in inner:
        into = max(inner[best], key=lambda r: worth[r])
        if low_lines[into] == low_lines[best] and high_lines[into] < high_lines[best]:
            break
        if high_lines[into] < 2 or worth[into] < SHARE * worth[best] or tops[into] < tops[best]:
            break
        best = into
    wide = top_article.get(best) or next((x.article for x in lines if x.article and _inside(best, x.article, outer)), 0)
    best = wide if wide and worth[wide] > 0 else best
    listed: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        listed.setdefault(x.group, []).append(i)
    menus = {g for g, of in listed.items() if best in (0, parser.body) and len(of) >= LINKS and all(lines[i].linked > 0.8 and not content[i] for i in of)}
    return "\n".join(x.text for x, good, f in zip(lines, content, factor, strict=True) if _inside(x.region, best, outer) and (good or (f == 1.0 and x.group not in menus)))


def _inside(region: int, around: int, outer: list[int]) -> bool:
    while region > around:
        region = outer[region]
    return region == around


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA, cut: float = CUT) -> DataFrame:
    """id_col, url_col, text, n_chars (code points) for each row."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.as_py(), sigma, cut) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
