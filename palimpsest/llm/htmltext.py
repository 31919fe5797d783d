"""Operator 5: HTML extraction from parser events by smoothed text-to-tag ratios."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import bound_batches

#: Elements whose text is never article text. Fixed values.
SKIP = frozenset(
    "script style title noscript template svg iframe object canvas nav footer aside form button select option "
    "textarea dialog menu head audio video map".split()
)
#: Elements that end a line of text. Fixed values.
BREAKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold lines. Fixed values.
HOLDERS = frozenset("article body div html main section table td blockquote".split())
#: Those that a line is said to stand in; quotes and tables are parts of what surrounds them. Fixed values.
REGIONS = HOLDERS - {"blockquote", "table", "td"}
#: Elements in which an open paragraph, item or cell can be closed by the next. Fixed values.
SCOPES = HOLDERS | frozenset("ul ol dl tr nav header footer aside form".split())
#: Elements that stray end tags of what they hold don't leave. Fixed values.
BARRIERS = frozenset("article main body html".split())
SIBLINGS = frozenset("li td th tr dd dt option".split())
HEADINGS = frozenset("h1 h2 h3".split())
TITLES = HEADINGS | {"h4", "h5", "h6"}
#: Characters a tag that count at most, so that long lines don't outweigh others. Fixed value.
LONG = 200
#: Lines before a region in which its headline is looked for.
LEAD = 5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose class or id can say what they are: those that hold blocks. Fixed values.
NAMED = frozenset("div section ul ol dl header details fieldset center table".split())
#: Words of class or id attributes by what they say of such an element: adverts and reader comments never are article text, page
#: furniture is none unless a section has a headline and prose, what else may be a box is none without these. Fixed values.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus respond replies".split())
FURNITURE = frozenset(
    "breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead nav navbar navigation newsletter pagination share sharing sidebar "
    "signup social subscribe subscription toolbar topbar".split()
)
BOXES = frozenset("banner copyright disclaimer menu modal notice notices overlay pager popup promo promotion recommended related reply skip widget".split())
#: Characters outside links that make a line prose. Fixed value.
PROSE = 60
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


class Line(NamedTuple):
    text: str
    tags: int  # tags since the line before
    linked: int  # characters inside links
    holder: int  # region element that it stands in directly, below 0 if that is the page
    whole: int  # outermost article or main around it, or 0
    heading: bool
    title: bool  # a headline of any level


class _Lines(HTMLParser):
    """Lines of text with their tag counts and holders, from start, end and data events as they stream by.

    Every element is pushed and popped once, and open elements are counted by name, so the work is linear in the page
    however deep it is nested and however many elements stay open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # (tag, skipped, first line of a doubtful block)
        self.open: Counter[str] = Counter()
        self.scopes: list[Counter[str]] = [Counter()]  # open elements by name since the last of SCOPES
        self.barriers: list[Counter[str]] = [Counter()]  # the same since the last of BARRIERS
        self.holders, self.wholes = [0], [0]
        self.skipped = 0
        self.ids = 0
        self.lines: list[Line] = []
        self.buffer: list[str] = []
        self.linked = 0
        self.heading = self.title = False
        self.tags = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.holders[-1], self.wholes[-1], self.heading, self.title))
            self.tags = 0
        self.linked = 0

    def _unwanted(self, tag: str, got: dict[str, str | None]) -> bool:
        inside = self.wholes[-1] > 0
        if tag in SKIP or tag == "header" and not inside:
            return True
        if "hidden" in got or (got.get("aria-hidden") or "").lower() == "true" or (got.get("role") or "").lower() in ROLES:
            return True
        return "display:none" in (got.get("style") or "").replace(" ", "").lower()

    def _named(self, tag: str, got: dict[str, str | None]) -> str:
        """What the names of a block say: ``out``, ``doubt`` (its text decides when it ends), or nothing."""
        if tag not in NAMED and not (tag == "p" and got):
            return ""
        words = {w.lower() for w in _WORDS.findall(f"{got.get('class') or ''} {got.get('id') or ''}")}
        if words & ADVERTS:
            return "out" if tag in NAMED or len(words) == 1 else ""
        if tag == "p":
            return ""
        if words & FURNITURE or "header" in words and not self.wholes[-1]:
            return "doubt" if tag == "section" else "out"
        return "doubt" if words & BOXES else ""

    def _push(self, tag: str, skipped: bool, doubt: bool = False) -> None:
        self.stack.append((tag, skipped, len(self.lines) if doubt else -1))
        self.skipped += skipped
        self.open[tag] += 1
        self.barriers[-1][tag] += 1
        self.scopes[-1][tag] += 1
        if tag in BARRIERS:
            self.barriers.append(Counter())
        if tag in SCOPES:
            self.scopes.append(Counter())
        if tag in REGIONS:
            self.ids += 1
            self.holders.append(-self.ids if tag in ("html", "body") else self.ids)
        if tag in ("article", "main"):
            self.wholes.append(self.wholes[-1] or self.ids)

    def _pop_to(self, tag: str) -> None:
        """Close elements up to the innermost open one of that name."""
        while True:
            last, skipped, start = self.stack.pop()
            if start >= 0:
                self._decide(start)
            if last in BARRIERS:
                self.barriers.pop()
            if last in SCOPES:
                self.scopes.pop()
            if last in REGIONS:
                self.holders.pop()
            if last in ("article", "main"):
                self.wholes.pop()
            self.skipped -= skipped
            self.open[last] -= 1
            self.barriers[-1][last] -= 1
            self.scopes[-1][last] -= 1
            if last == tag:
                return

    def _decide(self, start: int) -> None:
        """Drop the lines of a doubtful block that ends here, unless it has a headline and prose."""
        self.end_line()
        own = self.lines[start:]
        if not (any(x.title for x in own) and any(len(x.text) - x.linked >= PROSE for x in own)):
            del self.lines[start:]

    def finish(self) -> None:
        self.end_line()
        for _, _, start in reversed(self.stack):
            if start >= 0:
                self._decide(start)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.buffer.append(" ")
        if tag == "body" and self.open["head"] > 0:
            self._pop_to("head")
        if tag in BREAKS:
            self.end_line()
            # an open paragraph ends at the next block; so does an open item or cell at its next sibling
            if self.scopes[-1]["p"] > 0:
                self._pop_to("p")
            if tag == "tr" and len(self.scopes) > 1 and self.open["tr"] > 0 and self.stack[-1][0] in ("tr", "td", "th"):
                self._pop_to("tr")
            elif tag in SIBLINGS and self.scopes[-1][tag] > 0:
                self._pop_to(tag)
            elif tag in ("td", "th") and self.stack and self.stack[-1][0] in ("td", "th"):
                self._pop_to(self.stack[-1][0])
            self.heading, self.title = tag in HEADINGS, tag in TITLES
        self.tags += 1
        if tag not in VOID:
            got = dict(attrs)
            named = self._named(tag, got)
            self._push(tag, self._unwanted(tag, got) or named == "out", named == "doubt")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BREAKS:
            self.end_line()
            self.heading = self.title = False
        # a stray end tag doesn't close what holds it
        if (self.open if tag in HOLDERS else self.barriers[-1])[tag] > 0:
            self._pop_to(tag)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is a comment up to the next ">"
            return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.buffer.append(data)
            if self.open["a"] > 0:
                self.linked += len(data.split()) and len(" ".join(data.split()))


def _smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(x, kernel, "full")[reach : reach + x.size]
    return total / np.convolve(np.ones(x.size), kernel, "full")[reach : reach + x.size]


def regions(lines: list[Line], sigma: float, cut: float, small: float) -> list[tuple[int, int]]:
    """Runs of lines, as (first, end), that clusters of smoothed text-to-tag ratios make the content of a page.

    Content lines are those whose ratio, smoothed over their neighbours, is above ``cut`` times the length-weighted
    mean. Two of them belong to one cluster unless most of what stands between is links; clusters under ``small`` of
    the largest one go; of the element that the largest one stands in all lines stay that aren't mostly links. A cluster also takes the lines next to it in its holder as far as they aren't mostly links,
    and a headline just before it.
    """
    chars = np.array([len(x.text) for x in lines], float)
    linked = np.minimum([x.linked for x in lines], chars)
    ratio = np.minimum((chars - linked) / np.maximum([x.tags for x in lines], 1), LONG)
    smooth = _smoothed(ratio, sigma)
    good = smooth >= cut * np.average(smooth, weights=np.minimum(chars, LONG))
    said = linked <= 0.5 * chars  # lines that are mostly links can stand within a cluster, but make none
    at = np.flatnonzero(good & said) if (good & said).any() else np.flatnonzero(good)
    all_chars, all_linked = np.append(0, np.cumsum(chars)), np.append(0, np.cumsum(linked))
    between = lambda a, b: all_linked[b] - all_linked[a] > 0.5 * (all_chars[b] - all_chars[a])
    found = [[at[0], at[0] + 1]]
    for i in at[1:]:
        if i > found[-1][1] and between(found[-1][1], i):
            found.append([i, i + 1])
        else:
            found[-1][1] = i + 1
    size = [all_chars[b] - all_chars[a] for a, b in found]
    home = lines[found[int(np.argmax(size))][0]].holder  # what stands beside the largest cluster in its own element stays
    found = [x for x, n in zip(found, size, strict=True) if n >= small * max(size)]
    out: list[tuple[int, int]] = []
    for a, b in found:
        beside = lambda i, edge: 0 <= i < len(lines) and lines[i].holder == lines[edge].holder and linked[i] <= 0.5 * chars[i]
        while beside(a - 1, a):
            a -= 1
        while beside(b, b - 1):
            b += 1
        a = next((i for i in range(a - 1, max(a - 1 - LEAD, -1), -1) if lines[i].heading and not between(i, a)), a)
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((int(a), int(b)))
    covered = {i for a, b in out for i in range(a, b)}
    out += [(i, i + 1) for i in range(len(lines)) if home > 0 and lines[i].holder == home and said[i] and i not in covered]
    return sorted(out)


def main_text(html: str | None, sigma: float = 1.5, cut: float = 0.35, small: float = 0.1) -> str:
    """The article of a page, its blocks joined by line breaks.

    Lines end at block tags. Each has the ratio of its characters outside links to the tags since the line before,
    ``LONG`` at most; the clusters of smoothed ratios (``regions``) are the content. Where at least half of it stands
    in articles and mains, these are the result, with all their lines; else the regions are. Menus, forms, notices,
    adverts, comments and other furniture that elements, roles or class words name never become lines. Null, empty and
    textless pages give an empty text. Formulas stay. An unknown declaration is a comment.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    runs = regions(lines, sigma, cut, small)
    size: Counter[int] = Counter()
    for a, b in runs:
        for x in lines[a:b]:
            size[x.whole] += len(x.text)
    if 2 * (size.total() - size[0]) >= size.total():
        whole = [i for i, x in enumerate(lines) if x.whole and size[x.whole]]
        lead = whole[0] - 1
        headed = any(lines[i].heading for i in whole) or lead < 0 or not lines[lead].heading
        return "\n".join(lines[i].text for i in ([] if headed else [lead]) + whole)
    return "\n".join(x.text for a, b in runs for x in lines[a:b])


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``out``. See ``main_text``; the rest of the row stays as it is.

    Null and empty pages give an empty text, repeated rows the same text, an empty table no rows. Very long and deeply
    nested pages take time in proportion to their length. An extra column named ``out`` is replaced.
    """

    bound_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.withColumn(out, texts(F.col(html)))
