"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; they become lines, one for each block of a page, with its characters (those
in links don't count), its tags and its place in the tree.  The ratio of characters to tags is smoothed over neighbouring
lines (as a logarithm, long lines as if of 300 characters) with a Gaussian.  Names only weigh: lines in elements that by tag, role, class or id look like menus, headers,
footers, sidebars, notices, adverts, forms or reader comments have a small weight.  The threshold is a share of the page's
largest smoothed ratio; the lines above it form the content clusters, as do those above half of it that have several of their
kind beside them, and the clusters choose the region: the outermost ``article`` and ``main`` elements with content if they hold
half of it, or else the smallest container around nearly all of it.  The lines of that region, short ones too, are the text,
but for parts of it that names weigh down and the ratio doesn't lift over the threshold.  A name on an element around the
region silences nothing.  Where the region is the whole page, lines outside the clusters are left out if they are mostly
links, or if they come before the first or after the last cluster, unless headings, lists and other text elements next to it.
Scripts, styles and what isn't shown give no lines at all.

Lines are joined by an empty line, white space inside one is a single space, character references are decoded.
A null or empty page, or one without text, gives an empty text; repeated rows give a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import record, small_batches

# Element names and naming habits of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title button select option textarea label map".split())
LIGHT = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar note".split())
#: Elements that may be the region; a paragraph, heading, list item or cell is a part of one.
CONTAINERS = frozenset("article body center details div fieldset main section".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos banner sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts popup modal overlay comment comments commentlist disqus replies reply respond related recommended share sharing social newsletter subscribe subscription signup login search widget widgets pagination pager skip toolbar masthead topbar site-header page-header".split()
)
#: Parts beside a furniture name that say where, how many or what of it: site-footer, related-posts, ad-slot-3, sidebar_left.
BESIDE = frozenset(
    "site page main primary secondary global blog post posts entry article articles left right top bottom upper lower first last mobile desktop fixed sticky float floating header head foot area bar box block body button buttons card column col container form frame group icon icons inner outer item items leaderboard link links list mpu panel placeholder rail row section skyscraper slot title toggle unit wrap wrapper thread c l o js".split()
)
#: Shares of the page's largest smoothed ratio: from the first on a line belongs to a cluster, from the second on if there are
#: several such lines of its kind in its parent.
PEAK, WEAK, SEVERAL = 0.75, 0.375, 3
SIGMA, REACH, WEIGHT, AROUND = 1.0, 3, 0.02, 0.9
#: Characters beyond which a line counts as a long paragraph, however long.
LONG = 300
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[-_]+")


def furniture(names: str) -> bool:
    """Whether a class or an id is a furniture name as a whole: alone, or with parts that only say where or what of it."""
    for name in names.lower().split():
        if name in FURNITURE:
            return True
        parts = [x for x in PARTS.split(name) if x]
        if any(x in FURNITURE for x in parts) and all(x in FURNITURE or x in BESIDE or x[0].isdigit() for x in parts):
            return True
    return False


class Element(NamedTuple):
    tag: str
    silent: bool  # from here
    number: int


class Line(NamedTuple):
    text: str
    tags: int  # since the line before
    path: tuple[int, ...]
    linked: int  # characters in links


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Element] = []
        self.found: list[Line] = []
        self.kinds: dict[int, str] = {}
        self.light: set[int] = set()  # blocks that are furniture by tag or role
        self.named: dict[int, bool] = {}  # blocks named like furniture: whether they hold main
        self.anchors: dict[int, tuple[int, ...]] = {}  # article elements and the blocks named like furniture around them
        self.text: list[str] = []
        self.tags = self.numbers = self.linked = 0

    def _flush(self) -> None:
        """End a line."""
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.found.append(Line(text, self.tags, tuple(e.number for e in self.stack if e.number), self.linked))
            self.tags = 0
        self.text, self.linked = [], 0

    def marked(self) -> set[int]:
        """Blocks that weigh little.  One named like furniture doesn't if it is around main, or around all articles and most text."""
        size, whole = dict.fromkeys(self.named, 0), sum(len(x.text) for x in self.found)
        for x in self.found:
            for n in x.path:
                if n in size:
                    size[n] += len(x.text)
        around = set(self.named).intersection(*self.anchors.values()) if self.anchors else set()
        return self.light | {n for n, holds in self.named.items() if not holds and not (n in around and 2 * size[n] > whole)}

    def _silent(self) -> bool:
        return bool(self.stack) and self.stack[-1].silent

    def _pop_to(self, i: int) -> None:
        self._flush()
        del self.stack[i:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
            # an open paragraph ends where a block begins
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        if tag in CLOSES:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in CLOSES[tag]:
                    self._pop_to(i)
                    break
                if self.stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        a = {k: v or "" for k, v in attrs}
        inside = any(self.kinds.get(e.number) in ("article", "main") for e in self.stack)
        silent = self._silent() or tag in SILENT or "hidden" in a or a.get("aria-hidden") == "true"
        named = furniture(f"{a.get('class', '')} {a.get('id', '')}")
        light = tag in LIGHT or (tag == "header" and not inside) or (a.get("role", "").lower() in ROLES and tag not in ("html", "body", "article", "main"))
        if not silent and tag not in ("html", "body", "article", "main"):
            # inside a line there is no ratio to weigh
            silent = (tag not in BLOCKS and (named or light)) or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
        number = 0
        if tag in BLOCKS:
            self.numbers += 1
            number = self.numbers
            kind = "main" if a.get("role") == "main" or a.get("itemprop") == "articleBody" else tag
            self.kinds[number] = kind
            if light:
                self.light.add(number)
            if not silent and kind in ("article", "main"):
                over = tuple(e.number for e in self.stack if e.number in self.named)
                if kind == "main":
                    self.named.update(dict.fromkeys(over, True))
                elif not named and self.light.isdisjoint(e.number for e in self.stack):
                    self.anchors[number] = over
            elif named and not silent and tag not in ("html", "body"):
                self.named[number] = False
        self.stack.append(Element(tag, silent, number))

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS:
                    self._pop_to(i)
                else:
                    del self.stack[i:]
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return

    def handle_data(self, data):
        if not self._silent():
            self.text.append(data)
            if any(e.tag == "a" for e in self.stack):
                self.linked += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    kernel = np.array([math.exp(-(i * i) / (2 * SIGMA**2)) for i in range(-REACH, REACH + 1)])
    weight = np.convolve(np.ones(len(ratio)), kernel)[REACH : REACH + len(ratio)]
    return np.convolve(ratio, kernel)[REACH : REACH + len(ratio)] / weight


def main_text(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.close()
    page._flush()
    lines, marked = page.found, page.marked()
    if not lines:
        return ""
    ratio = np.log1p([min(LONG, max(0, len(x.text) - x.linked)) / (1 + x.tags) for x in lines])  # one huge line doesn't hide the others
    weighted = smoothed(ratio) * np.array([1.0 if marked.isdisjoint(x.path) else WEIGHT for x in lines])
    top = weighted.max()
    threshold, weak = min(top, PEAK * top), weighted >= min(top, WEAK * top)
    alike = Counter((x.path[:-1], page.kinds.get(x.path[-1]) if x.path else None) for x, w in zip(lines, weak, strict=True) if w)
    content = (weighted >= threshold) | np.array([bool(w) and bool(x.path) and alike[x.path[:-1], page.kinds[x.path[-1]]] >= SEVERAL for x, w in zip(lines, weak, strict=True)])
    regions = _regions(page, [x for x, c in zip(lines, content, strict=True) if c], [x for x, w in zip(lines, weak, strict=True) if w])
    # parts of the region that names weigh down and the ratio doesn't lift
    sums: dict[int, list[float]] = {}
    for x, v in zip(lines, weighted, strict=True):
        for n in marked.intersection(x.path):
            sums.setdefault(n, []).append(float(v))
    outside = {e for n in regions for x in lines if n in x.path for e in x.path[: x.path.index(n) + 1]}
    dropped = {n for n, v in sums.items() if n not in outside and sum(v) < threshold * len(v)}
    kept = [i for i, x in enumerate(lines) if (not regions or not regions.isdisjoint(x.path)) and dropped.isdisjoint(x.path)]
    if all(page.kinds[n] == "body" for n in regions):
        around = _around(page, lines, np.flatnonzero(content).tolist(), kept)
        kept = [i for i in kept if content[i] or (i in around and 2 * lines[i].linked <= len(lines[i].text))]
    return "\n\n".join(lines[i].text for i in kept)


def _around(page: Lines, lines: list[Line], content: list[int], kept: list[int]) -> range:
    """The stretch from the first to the last cluster and, beside these, what lies next to them in their common parent: text
    elements such as headings and lists, and elements of a kind that the clusters' own lines have there."""
    paths = [lines[i].path for i in content]
    depth = 0
    while all(len(p) > depth + 1 and p[depth] == paths[0][depth] for p in paths):
        depth += 1
    kinds = {page.kinds[p[depth]] for p in paths if len(p) > depth}
    ends = []
    for edge, beyond in ((content[0], [i for i in reversed(kept) if i < content[0]]), (content[-1], [i for i in kept if i > content[-1]])):
        for i in beyond:
            path = lines[i].path
            if path[:depth] != paths[0][:depth] or (len(path) > depth and (kind := page.kinds[path[depth]]) not in kinds and kind in CONTAINERS | LIGHT):
                break
            edge = i
        ends.append(edge)
    return range(ends[0], ends[1] + 1)


def _regions(page: Lines, clusters: list[Line], weak: list[Line]) -> set[int]:
    """Elements whose lines are the main text, by the content found in them; none stands for the whole page."""

    def own(x: Line) -> int | None:
        return next((n for n in x.path if page.kinds[n] in ("article", "main")), None)

    size = [min(LONG, len(x.text)) for x in clusters]
    whole = sum(size)
    named = sum(mass for x, mass in zip(clusters, size, strict=True) if own(x))
    if named and 2 * named >= whole:
        return {n for x in (*clusters, *weak) if (n := own(x))}
    held: dict[int, int] = {}
    for x, mass in zip(clusters, size, strict=True):
        for n in x.path:
            if page.kinds[n] in CONTAINERS:
                held[n] = held.get(n, 0) + mass
    return {max(around)} if (around := [n for n, mass in held.items() if mass >= AROUND * whole]) else set()  # numbers grow inwards


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield record(OUT, (part.column("page_id"), part.column("url"), texts, [len(t) for t in texts]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row per page, nothing shuffled."""
    small_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
