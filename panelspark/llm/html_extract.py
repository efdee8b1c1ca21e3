"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives events. Text between two block tags is a
line, with the number of tags in it. Lines inside menus, headers, footers, sidebars,
notices, adverts, forms, comments of readers, scripts and styles (by tag, role or a
word of class or id) are no candidates. The others have the ratio of their characters
to their tags, smoothed by a Gaussian over neighbouring lines; two clusters around
low and high ratios give a threshold between them.

Lines belong to regions: the outermost ``article`` or ``main`` they stand in, or else
the innermost container. A region with a line in the high cluster is content and is
kept whole, so short paragraphs and headings beside long ones stay. The mark of an
``article`` or ``main`` raises the ratios of its lines by the factor MARK and decides nothing alone: an
article of a few words beside a long story in a plain container is not kept.

White space inside a line becomes one space, lines without text go, and the rest is
joined by one space in page order. Null and empty pages, and pages without a candidate,
give an empty text. Pages are handled one by one where they are read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import words as W

# Fixed values of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("body div section td table ul ol dl blockquote center".split())
NO_TEXT = frozenset("head script style title noscript template svg math iframe object canvas audio video select option datalist".split())
PAGE_PARTS = frozenset("nav menu header footer aside form button textarea fieldset dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer colophon sidebar sidebars widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist disqus reply replies respond discussion".split()
)
# what says that a part is somewhere else on the page, or not at all
NOT_HERE = frozenset("no has with without".split())
#: How much more a line in an article or main element counts.
MARK = 1.5
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# an open element of the key ends where one of these begins
ENDS = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset("body article main section div p nav header footer aside h1 h2 h3 table ul ol form".split()),
}


def left_out(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is no part of the main text, by its tag, role, class or id."""
    if tag in NO_TEXT or tag in PAGE_PARTS:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if value and name == "role" and value.strip().lower() in ROLES:
            return True
        if value and name in ("class", "id"):
            for one in value.split():
                said = {w.lower() for w in WORD.findall(one)}
                if said & HINTS and not said & NOT_HERE:
                    return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, region) of the candidate lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # open elements: tag, whether left out, region, whether the region is an article
        self.open: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
        self.regions = 0
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool]] = []

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                _, _, region, article = self.open[-1]
                self.lines.append((line, self.tags, region, article))
            self.text = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
            while tag in ENDS.get(self.open[-1][0], ()):
                self.open.pop()
            if tag in ENDS["p"]:
                self._close("p", ("td", "th", "div", "article", "section", "li", "button"))
        self.tags += 1
        if tag in VOID:
            return
        _, out, region, article = self.open[-1]
        if not out:
            out = left_out(tag, attrs)
            if tag in ("article", "main") and not article:
                self.regions += 1
                region, article = self.regions, True
            elif tag in CONTAINERS and not article:
                self.regions += 1
                region = self.regions
        self.open.append((tag, out, region, article))

    def _close(self, tag, within=()):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        # a stray end tag of a word or paragraph doesn't end what stands around it
        self._close(tag, ("td", "th", "li", "div", "article", "main", "section", "nav", "body") if tag in INLINE or tag == "p" else ())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.open[-1][1]:
            self.text.append(data)

    def close(self):
        super().close()
        self.flush()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian over neighbours; at the ends, over those that there are."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[radius : radius + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters, found by turns from the lowest and the highest value."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below = values < cut
        if not below.any() or below.all():
            break
        new = float(values[below].mean()), float(values[~below].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None, sigma: float = 1.0) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smooth(np.array([len(text) / max(1, tags) * (MARK if article else 1) for text, tags, _, article in lines], float), sigma)
    cut = threshold(ratio)
    kept = {region for (_, _, region, _), r in zip(lines, ratio.tolist()) if r >= cut}
    return " ".join(text for text, _, region, _ in lines if region in kept)


def extract(df: DataFrame, html_col: str = "html", out: str = "text", sigma: float = 1.0) -> DataFrame:
    """``df`` with the main text of its pages in place of the page; an existing column ``out`` is replaced."""
    kept = [c for c in df.columns if c not in (html_col, out)]
    held_html = W.fresh(df.columns, "_html")
    source = df.select(*kept, F.col(html_col).alias(held_html))

    def run(batches):
        for batch in batches:
            rest = batch.drop_columns([held_html])
            filled = pa.compute.fill_null(batch[held_html], "")
            for a, b, _, _ in W.slices(filled, 4 << 20):
                texts = [main_text(page, sigma) for page in filled.slice(a, b - a).to_pylist()]
                made = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, made], [*rest.schema.names, out])

    return source.mapInArrow(W.tidy(run), source.drop(held_html).schema.add(out, "string"))
