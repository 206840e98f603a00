"""Main text of web pages from streaming parser events.

The parser of the standard library sends tags and text; they are gathered into lines (blocks), each with its number of text
characters and tags.  The text-to-tag ratios along a page are smoothed by a Gaussian and split into two clusters by their
threshold.  The region is where the high cluster's text stands: the article or main elements that hold most of it, else the
innermost container around it; all lines of the region are kept.  Parts that are named like menus or adverts don't
count, unless nearly all text stands in them.  One pass over the pages, no shuffle; the work is linear in a page, however broken
its tags are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

#: Elements whose start or end also ends a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("button canvas datalist head iframe label legend math noembed noframes noscript object option script search select style svg template textarea title".split())
#: Elements that hold no main text, unless all text of the page stands in such parts.
OUTSIDE = frozenset("aside dialog fieldset footer form header menu nav".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an unclosed paragraph ends at.
CLOSES_P = BLOCKS - frozenset("caption dd dt html body legend li option summary tbody td tfoot th thead tr".split())
#: Additions to a name that leave its meaning: ``site-footer``, ``comment-list-2``, but not ``no-sidebar`` or ``comments-open``.
_BEFORE = r"(?:(?:site|global|main|top|bottom|left|right|primary|secondary|sub|user|blog)[_-]+)*"
_AFTER = r"(?:[_-]+(?:area|bar|block|body|box|container|content|depth|form|group|inner|items?|left|links?|list|main|menu|outer|overlay|panel|primary|right|secondary|section|slot|text|thread|title|top|unit|wrap|wrapper|wide|\d+))*"
#: Class, id and role names of reader comments.
COMMENT_NAMES = re.compile(rf"{_BEFORE}(?:(?:post|entry|article|page)[_-]+)?(?:comments?|repl(?:y|ies))(?:[_-]+(?:repl(?:y|ies)|respond))?{_AFTER}", re.I)
#: Class, id and role names of menus, notices, adverts and forms.
OUTSIDE_NAMES = re.compile(rf"{_BEFORE}(?:ads?|advert\w*|aside|banner|breadcrumbs?|complementary|contentinfo|cookies?(?:[_-]+(?:notice|consent|banner))?|consent|discuss\w*|disqus|(?:post[_-]+|entry[_-]+|article[_-]+|page[_-]+)?footer|gdpr|(?:page[_-]+)?header|masthead|menu|modal|(?:post[_-]+|page[_-]+)?nav(?:bar|igation)?|newsletter|notices?|pager|pagination|popup|promo\w*|related(?:[_-]+(?:posts?|articles?|stories))?|respond|(?:social[_-]+)?shar(?:e|ing)(?:[_-]+buttons?)?|sidebar|site-?header|skip(?:[_-]+(?:to|link))?|social|sponsor\w*|subscribe|toolbar|widget){_AFTER}", re.I)
#: Elements that can hold a whole text; others, sections too, are parts of one.
CONTAINERS = ("article", "main", "body", "div", "td")
#: Share of the dense text that a container must hold; what smoothing adds at its edges is less.
MOST_TEXT = 0.95


def named(pattern: re.Pattern[str], names: str) -> bool:
    """Whether a whole name of a list of them matches."""
    return any(pattern.fullmatch(name) for name in names.split())


class Lines(HTMLParser):
    """Gathers the lines of a page and a tree of its containers and outside parts, numbered in page order from the root, 0.

    A part's number and its last descendant's, ``last``, tell what lies in it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int]] = []  # text, tags, whether links hold most of it, part, part around its block
        self.names, self.parents, self.outside, self.last = [""], [0], [False], [0]
        self.open: list[tuple[str, int, bool, bool]] = []  # name, number of its part or -1, whether it hides text, whether it links
        self.count: Counter = Counter()  # open elements by name
        self.blocks: list[tuple[str, int, Counter]] = []  # name and part of each open block, its open inline elements by name
        self.loose: Counter = Counter()  # inline elements open outside of any block
        self.part = self.tags = self.hidden = self.links = self.linking = 0
        self.parts: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            # the block of the line itself, if a container, isn't around it
            own = self.blocks[-1][1] if self.blocks else -1
            around = self.parents[own] if own == self.part and self.names[own] in ("div", "td") else self.part
            self.lines.append((text, self.tags, 2 * self.links > len(text), self.part, around))
            self.tags = 0
        self.links = 0
        self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in CLOSES_P and self.blocks and self.blocks[-1][0] == "p":
            self.leave("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.leave(tag)
        if tag == "a" and self.inline()["a"]:
            self.leave("a")
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = tag in HIDDEN or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        comments = named(COMMENT_NAMES, names)
        marked = comments or named(OUTSIDE_NAMES, names)
        if tag in ("html", "body", "main"):
            out = False
        elif tag == "article":
            out = comments
        else:
            out = marked or tag in OUTSIDE and not (tag == "header" and (self.count["article"] or self.count["main"]))
        if tag not in BLOCKS:  # inline parts are small
            hidden, out = hidden or out, False
        number = -1
        if out or tag in CONTAINERS:
            number = len(self.names)
            for column, value in ((self.names, tag), (self.parents, self.part), (self.outside, out), (self.last, number)):
                column.append(value)
            self.part = number
        given = {k for k, _ in attrs}
        link = tag == "a" and ("href" in given or not given & {"name", "id"})  # else a place to link to
        self.open.append((tag, number, hidden, link))
        self.count[tag] += 1
        if tag in BLOCKS:
            self.blocks.append((tag, number, Counter()))
        else:
            self.inline()[tag] += 1
        self.hidden += hidden
        self.linking += link

    def inline(self) -> Counter:
        """Open inline elements of the innermost block."""
        return self.blocks[-1][2] if self.blocks else self.loose

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def drop(self) -> str:
        name, number, hidden, link = self.open.pop()
        self.count[name] -= 1
        if name in BLOCKS:
            self.blocks.pop()
        else:
            self.inline()[name] -= 1
        self.hidden -= hidden
        self.linking -= link
        if number >= 0:
            self.last[number] = len(self.names) - 1
            self.part = self.parents[number]
        return name

    def leave(self, tag: str) -> None:
        """Close the innermost open ``tag`` and whatever is still open inside it."""
        if tag in BLOCKS:
            self.end_line()
        while self.open and self.drop() != tag:
            pass

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count[tag]:
            return
        if tag in BLOCKS or tag in HIDDEN:
            self.leave(tag)
            return
        if self.inline()[tag]:  # an inline element ends in the block that it started in, and with it those inside it
            self.leave(tag)

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.parts.append(data)
        if self.linking:
            self.links += len(data)

    def finish(self) -> None:
        self.close()
        self.end_line()
        while self.open:
            self.drop()
        self.last[0] = len(self.names) - 1


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian-weighted means along the lines, with weights that add to one at the edges too."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(ratios) == 1:
        return ratios
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The point between two clusters of the values' logarithms: midway between the means that it divides."""
    logs = np.log1p(values)
    cut = float(logs.mean())
    for _ in range(rounds):
        low, high = logs[logs < cut], logs[logs >= cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return math.expm1(cut)


def _sums(own: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums over each part and all inside it; a part's number is greater than its parent's."""
    out = own.tolist()
    for n in range(len(out) - 1, 0, -1):
        out[parents[n]] += out[n]
    return np.array(out)


def _left_out(page: Lines, part: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Which lines lie in outside parts, whatever their size; only if no text without links is left, the largest part is none."""
    sums = _sums(np.bincount(part, mass, len(page.names)), page.parents)
    outside = np.array(page.outside)

    def inside() -> np.ndarray:
        found = outside.tolist()
        for n in range(1, len(found)):
            found[n] = found[n] or found[page.parents[n]]
        return np.array(found)

    out = inside()
    if sums[0] and not mass[~out[part]].any():
        outside[np.where(outside, sums, -1).argmax()] = False
        out = inside()
    return out[part]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Lines of the content region joined by line feeds; empty if there are none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    if not page.lines:
        return ""
    tags, linked, part, around = (np.array(x) for x in list(zip(*page.lines, strict=True))[1:])
    size = np.array([len(t) for t, *_ in page.lines])
    shown = ~_left_out(page, part, size * ~linked)
    if not shown.any():
        return ""
    # lines left out say nothing of the text's ratios
    ratios = smooth(size[shown] / (1 + tags[shown]), sigma)
    dense = shown.copy()
    dense[shown] = ratios >= threshold(ratios) * (1 - 1e-9)
    last = np.array(page.last)
    mass = _sums(np.bincount(part, size * dense, len(last)), page.parents)
    total = mass[0]
    inner = [n for n, name in enumerate(page.names) if name in ("article", "main") and mass[n] > 0]
    if inner:
        depth = {n: k for k, n in enumerate(inner)}
        # the region with most text of the high cluster; of those that hold it all, the innermost
        best = max(inner, key=lambda n: (mass[n], depth[n]))
        chosen = [best]
        if page.names[best] == "article":
            outer = page.parents[best]
            chosen = [n for n in inner if page.names[n] == "article" and page.parents[n] == outer]
        if 2 * sum(mass[n] for n in chosen) > total:
            kept = shown & np.logical_or.reduce([(part >= n) & (part <= last[n]) for n in chosen])
            return "\n".join(page.lines[i][0] for i in np.flatnonzero(kept))
        # most text is elsewhere: where it stands outside of all articles, they don't count
        loose = dense & ~np.logical_or.reduce([(part >= n) & (part <= last[n]) for n in inner])
        if 2 * size[loose].sum() >= total:
            dense = loose
    return container_text(page, dense, shown, linked, part, around)


def container_text(page: Lines, dense: np.ndarray, shown: np.ndarray, linked: np.ndarray, part: np.ndarray, around: np.ndarray) -> str:
    """All lines of the innermost container around nearly all dense text that isn't links; links in front of and behind it go."""
    text = dense & ~linked
    if not text.any():
        return ""
    size = np.array([len(t) for t, *_ in page.lines])
    sums = _sums(np.bincount(around, size * text, len(page.names)), page.parents)
    # those that hold so much lie inside each other
    best = max(n for n in range(len(sums)) if sums[n] >= MOST_TEXT * sums[0] and (n == 0 or page.names[n] in CONTAINERS))
    inside = (around >= best) & (around <= page.last[best])
    at = np.flatnonzero(text & inside)
    place = np.arange(len(part))
    kept = shown & inside & (((place >= at[0]) & (place <= at[-1])) | ~linked)
    return "\n".join(page.lines[i][0] for i in np.flatnonzero(kept))


def _extract(batches: Iterator[pa.RecordBatch], sigma: float) -> Iterator[pa.RecordBatch]:
    for rows in pieces(batches):
        texts = [main_text(h, sigma) for h in rows["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(rows["page_id"], pa.int64()), pa.array(rows["url"], pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row's whole page.

    Character references are decoded, white space inside a line becomes one space, lines follow each other in page order
    with one line feed between them.  Pages whose ``article`` or ``main`` elements hold most high-ratio text give the whole of
    the one that has most of it; others give the whole of the innermost container around their high-ratio lines, but for lines of links in
    front of and behind those.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
    are left out by element and by whole class, id and role names, whatever their size; only where all text stands in such parts,
    the largest of them counts as a wrapper of the text.

    A null, empty or text-free page gives an empty text; a page cut off anywhere is read as far as it goes; nulls in other
    columns, repeated rows and further columns are of no effect.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    return rows.mapInArrow(lambda it: _extract(it, sigma), "page_id bigint, url string, text string, n_chars bigint")
