"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser gives tag and text events; from them come lines (the text of a block element)
with the tags seen in them. Lines in menus, footers, adverts and the like are set aside by their elements and by
whole class, id or role words, which say nothing on html, body, main and article. What a word or a form sets aside
comes back if it holds most of the page's text. Over the lines that are left, the ratio of text to tags is smoothed with a Gaussian and split in two by
threshold clustering (two means). The content regions are the articles (or <main>) that hold a line of the upper
cluster; on pages without either, the innermost container with nearly all of the upper cluster's text. A region is
kept whole, its short lines too.

Defined cases: null and empty pages give an empty text; unclosed, crossed and cut-off tags are read as browsers do
for blocks; pages of any length are whole; repeated rows give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import text_slices

SIGMA, RADIUS = 1.0, 2
#: Share of the upper cluster's text that a container must have to be looked into further.
HOLDS = 0.7

#: Fixed values of HTML: elements without content, those that begin a block, and those never part of a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noframes noscript object script select style svg template textarea title".split())
#: Elements around the text itself, of whatever class.
WHOLE = frozenset("html body main article".split())
CONTAINER = frozenset("article body div main section td".split())
#: Words in class, id or role that mark what is not the article's text; the last few only outside an article.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
OUTER_HINTS = frozenset("header masthead topbar contentinfo complementary".split())
#: An open <p> ends where one of these begins; these end their like.
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_ENDS_LIKE = frozenset("li dt dd tr td th option p".split())
_SCOPE = frozenset("ul ol dl table article section div main body".split())


@dataclass
class Element:
    tag: str
    #: Number of the element among the page's containers, or of the nearest one around it.
    container: int
    boilerplate: bool
    in_article: bool
    #: Numbers of the parts, set aside for now, that it is in, and whether it begins one.
    asides: tuple[int, ...] = ()
    begins: bool = False


@dataclass
class Line:
    text: str
    tags: int
    container: int
    boilerplate: bool
    asides: tuple[int, ...]


class Lines(HTMLParser):
    """Events of a page, gathered into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", 0, False, False)]
        #: Of each container: the one around it, its tag.
        self.around, self.kinds = [-1], [""]
        self.lines: list[Line] = []
        self.asides = 0
        self.text: list[str] = []
        self.tags = 0

    def flush_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, top.container, top.boilerplate, top.asides))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush_line()
        if tag in _ENDS_P:
            self._end_open("p")
        if tag in _ENDS_LIKE:
            self._end_open(tag)
        if tag == "br":
            self.text.append(" ")  # a line break is white space inside its block
        if tag in VOID:
            return
        around = self.stack[-1]
        article = around.in_article or tag in ("article", "main")
        off = around.boilerplate or tag in NEVER and tag != "form" or tag == "header" and not article or self._hidden(attrs)
        begins = not off and (tag == "form" or tag not in WHOLE and self._hinted(attrs, article))
        # What changes the fate of text parts lines, whatever the element.
        if off != around.boilerplate or begins:
            self.flush_line()
        asides = around.asides
        if begins:
            asides = (*asides, self.asides)
            self.asides += 1
        container = around.container
        if tag in CONTAINER:
            container = len(self.around)
            self.around.append(around.container)
            self.kinds.append("article" if tag in ("article", "main") or ("role", "main") in attrs else tag)
        self.stack.append(Element(tag, container, off, article, asides, begins))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    @staticmethod
    def _hinted(attrs: list[tuple[str, str | None]], article: bool) -> bool:
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                words = set(value.lower().split())
                if words & HINTS or not article and words & OUTER_HINTS:
                    return True
        return False

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)

    def _end_open(self, tag: str) -> None:
        """End an open element of this tag, if no other scope began since."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if self.stack[i].tag in _SCOPE:
                return

    def _pop_to(self, i: int) -> None:
        if any(e.tag in BLOCK or e.boilerplate or e.begins for e in self.stack[i:]):
            self.flush_line()
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush_line()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if tag not in BLOCK and self.stack[i].tag in _SCOPE:
                return  # an inline end without a beginning in this block

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; ends are weighed by what there is."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    middle = slice(RADIUS, RADIUS + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values are above the threshold between the two means; all, if there is but one value."""
    low, high = float(values.min()), float(values.max())
    if low == high:
        return np.ones(len(values), bool)
    for _ in range(50):
        upper = values > (low + high) / 2
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return upper


def read_lines(html: str) -> Lines:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush_line()
    return parser


def main_text(html: str) -> str:
    """The page's main text: its blocks, joined by newlines."""
    page = read_lines(html)
    lines = _left(page)
    if not lines:
        return ""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    content = upper_cluster(smoothed(ratio))
    regions = _regions(page, lines, content)
    return "\n".join(x.text for x in lines if _inside(page, x.container, regions))


def _left(page: Lines) -> list[Line]:
    """Lines that aren't set aside, or only in parts that hold most of the text."""
    lines = [x for x in page.lines if not x.boilerplate]
    held = [0] * page.asides
    for x in lines:
        for a in x.asides:
            held[a] += len(x.text)
    total = sum(len(x.text) for x in lines)
    return [x for x in lines if all(2 * held[a] > total for a in x.asides)]


def _inside(page: Lines, container: int, regions: set[int]) -> bool:
    while container >= 0:
        if container in regions:
            return True
        container = page.around[container]
    return False


def _regions(page: Lines, lines: list[Line], content: np.ndarray) -> set[int]:
    """Containers that make up the content."""
    outer: dict[int, int] = {}  # the outermost article around each container
    for c, around in enumerate(page.around):
        found = outer.get(around, -1) if around >= 0 else -1
        outer[c] = found if found >= 0 else c if page.kinds[c] == "article" else -1
    size: dict[int, list[int]] = {}
    for x, is_content in zip(lines, content.tolist()):
        if (a := outer[x.container]) >= 0:
            slot = size.setdefault(a, [0, 0])
            slot[0] += len(x.text)
            slot[1] += len(x.text) * is_content
    if size:
        return {a for a, (_, n) in size.items() if n} or {max(size, key=lambda a: size[a][0])}
    held = [0] * len(page.around)
    for x, is_content in zip(lines, content.tolist()):
        c = x.container if is_content else -1
        while c >= 0:
            held[c] += len(x.text)
            c = page.around[c]
    region = 0
    while True:
        below = [c for c, around in enumerate(page.around) if around == region]
        best = max(below, key=held.__getitem__, default=-1)
        if best < 0 or held[best] < HOLDS * held[0]:
            return {region}
        region = best


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "html"):
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir):
    from clausegrid.llm.common import prepare, table

    return extract_pages(table(prepare(spark), sf_dir, "pages"))
