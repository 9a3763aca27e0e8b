"""HTML extraction (4): text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser gives events; a line is a block (what stands between block-level
tags). A line's ratio is its characters to its tags. Ratios are smoothed by a Gaussian over
neighbouring lines, and lines at or over a threshold (a share of the ratios' standard deviation)
form the content clusters. A cluster takes in all lines that stand directly in the containers that
it touches, so that short paragraphs of an article stay; an article or main element is a container
like any other. A container that only its neighbours' ratios lift over the threshold is touched if
its lines are at or over it on average. Lines inside elements that name themselves menu, header,
footer, sidebar, notice, advert, form or comment have no ratio and never count; an inline element
of this kind (a script or an advert inside a sentence) goes without splitting the block around it.

Cases: null, empty or text-free html gives an empty string. Broken markup never fails: open
elements end with the element around them, stray end tags are ignored. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and the words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
SCOPE = frozenset("button iframe object select svg template".split())
CONTAINER = frozenset("article body div main section table html td".split())
HINTS = frozenset(
    "ad ads adbox adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies discussion disqus footer footnav form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification popup promo promoted promotion sidebar sidenav signup skyscraper sponsor sponsored subscribe".split()
)
#: Elements that a start tag of the key ends when they are open.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"[a-z]+")


def hinted(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> bool:
    """Whether the element names itself as something other than content. An article's own header is content."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and value and tag not in ("html", "body"):
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                words = WORDS.findall(token)
                if token.startswith("no-") or not words:
                    continue
                if any(w in HINTS and not (article and w == "header") for w in (words[0], words[-1])):
                    return True
    return False


class Open(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    seen: bool
    container: int
    article: bool
    gap: bool  # inside an inline element that isn't content: its text goes, the line around it goes on


OUTSIDE = Open("", True, 0, False, False)


class LineParser(HTMLParser):
    """Lines as (text, tags, container, seen)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.blank = True  # no text but white space in this line so far
        self.tags = self.containers = 0
        self.at_text = OUTSIDE

    def state(self) -> Open:
        return self.open[-1] if self.open else OUTSIDE

    def end_line(self) -> None:
        if self.state().gap:
            return
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.at_text.container, self.at_text.seen))
            self.tags = 0
        self.text, self.blank = [], True

    def close_to(self, depth: int) -> None:
        """Closes open elements; a line ends with a block among them."""
        if any(x.tag in BLOCK for x in self.open[depth:]):
            self.end_line()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.end_line()
        if tag == "br" and not self.state().gap:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in ENDS:
            for depth in range(len(self.open) - 1, -1, -1):
                name = self.open[depth].tag
                if name in ENDS[tag]:
                    self.close_to(depth)
                    break
                if name in CONTAINER or name in ("ul", "ol", "dl", "select", "blockquote", "figure", "nav", "form"):
                    break
        elif tag in BLOCK and self.open and any(x.tag == "p" for x in self.open[-4:]):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth].tag == "p":
                    self.close_to(depth)
                    break
                if self.open[depth].tag in BLOCK or self.open[depth].tag in SCOPE:
                    break
        around = self.state()
        container, article = around.container, around.article
        if tag in ("article", "main"):
            article = article or not any(x.tag == "article" and not x.seen for x in self.open)
        if tag in CONTAINER:
            self.containers += 1
            container = self.containers
        content = tag not in UNSEEN and not (tag == "header" and not article) and not hinted(tag, attrs, article)
        gap = around.gap or (around.seen and not content and tag not in BLOCK)
        self.open.append(Open(tag, around.seen and content, container, article, gap))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, the slash has no meaning

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self.close_to(depth)
                return
            if self.open[depth].tag in ("article", "table") and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        state = self.state()
        if state.gap:
            return
        if self.blank:
            self.at_text = state
            self.blank = not data.strip()
        self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)


def smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        parts = [(w, values[i + d]) for d, w in zip(range(-reach, reach + 1), kernel, strict=True) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in parts) / sum(w for w, _ in parts))
    return out


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(x[0] for x in _clustered(parser.lines, sigma, share))


def _clustered(lines: list, sigma: float, share: float) -> list:
    ratios = [len(x[0]) / max(1, x[1]) if x[3] else 0.0 for x in lines]
    if not any(ratios):
        return []
    smoothed = smooth(ratios, sigma)
    mean = sum(smoothed) / len(smoothed)
    threshold = share * math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    reached: dict[int, list[float]] = {}
    touched = set()
    for x, r, s in zip(lines, ratios, smoothed, strict=True):
        if r:
            reached.setdefault(x[2], []).append(s)
            if min(r, s) >= threshold:
                touched.add(x[2])
    touched |= {c for c, values in reached.items() if sum(values) >= threshold * len(values)}
    return [x for x in lines if x[3] and x[2] in touched]


def extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        html = batch.pop("__html")
        batch["__text"] = [main_text(x if isinstance(x, str) else None) for x in html]
        yield batch


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """The columns `keep` with the main text in `out`."""
    rows = pages.select(*(F.col(c) for c in keep), F.col(html_col).alias("__html"))
    kept = rows.select(*keep).schema.add("__text", "string")
    return rows.mapInPandas(extract_batches, kept).withColumnRenamed("__text", out)
