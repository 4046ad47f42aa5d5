"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of tags and words. Words score by where they stand (innermost block, link, zone of the page), tags
score below zero; the weights are log odds fitted on labelled pages, which are pages that mark their article themselves.
One linear scan finds the contiguous region of the largest sum. Elements that are no article text by their name or class
(menus, forms, adverts, notices, reader comments) score nothing, so they neither break a region nor carry it, and are
left out of it. Tags are read as browsers do: a quote opens a value only after an equals sign, an attribute value may
hold anything, raw text ends at its own end tag in any case. Every step is linear in the page: elements are closed
through the positions of the open ones by name, and zones, blocks and links are kept on stacks of their own.

Defined results: a null or empty html and a page without positive words give an empty text; unclosed elements end where
their parent does; a tag or comment that never ends takes the rest of the page; repeated rows each have their row; ties
go to the first region; a null id or url stays null; an empty table gives an empty result; other columns are not read.
The fit reads those pages whose hashed id falls into a share of about `sample` in all; without any labelled page among
them, fixed weights are used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.text import batches
from lociq.session import pick

# Element names and class words of HTML in use.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ZONES = frozenset("nav footer header aside form head".split())
NEVER = frozenset("nav aside form footer menu dialog head noscript template svg math object select button canvas audio video".split())
NOT_TEXT = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar aside related cookie cookies consent notice popup modal newsletter subscribe share social menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus footer copyright pagination pager skip widget".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
DEFAULTS = {"|p|": 1.5, "|h1|": 1.0, "|h2|": 1.0, "|h3|": 1.0, "|blockquote|": 1.0, "|pre|": 0.5, "|li|": 0.2, "|li|a": -1.0, "|p|a": 0.3, "|div|": 0.1, "|section|": 0.1, "|article|": 0.5, "|td|": 0.1}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*)?))?""")
_PART = re.compile(r"[a-z]+")
_KEPT = frozenset(("body", "html", "article", "main"))


class Page:
    """The tokens of a page: tags, and texts with their number of words, feature and whether they may be article text."""

    def __init__(self, html: str):
        self.items: list[tuple[str, str, int, bool, bool]] = []  # kind or text, feature, words, allowed, inside an article
        self.texts: dict[int, str] = {}
        self._stack: list[tuple[str, bool, bool]] = []
        self._at: dict[str, list[int]] = {}  # where each name is open
        self._zones: list[str] = []
        self._blocks: list[str] = []
        self._kept: list[int] = []
        self._never = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, text = 0, 0
        while (lt := html.find("<", at)) >= 0:
            mark = html[lt + 1 : lt + 2]
            if mark in ("!", "?") or (mark == "/" and not _NAME.match(html, lt + 2)):
                if html.startswith("<!--", lt):
                    end = html.find("-->", lt + 2)
                    stop = len(html) if end < 0 else end + 3
                else:
                    stop = html.find(">", lt) + 1 or len(html)
                self._text(html[text:lt])
                at = text = stop
                continue
            m = _NAME.match(html, lt + 1 + (mark == "/"))
            if not m:
                at = lt + 1  # a bare sign
                continue
            self._text(html[text:lt])
            name, at, words, closed = m[0].lower(), m.end(), set(), False
            while at < len(html) and html[at] != ">":
                a = _ATTRIBUTE.match(html, at)
                if a.end() == at:
                    at += 1
                    continue
                if (a[1] or "").lower() in ("class", "id", "role"):
                    words |= set(_PART.findall((a[2] or a[3] or a[4] or "").lower()))
                at = a.end()
            if at >= len(html):
                return  # the tag never ends
            closed = html[at - 1] == "/"
            at = text = at + 1
            if mark == "/":
                self._close(name)
            elif name in RAW and not closed:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                self._tag(name)
                if not end:
                    return
                at = text = html.find(">", end.end()) + 1 or len(html)
            else:
                self._open(name, words, closed)
        self._text(html[text:])

    def _tag(self, name: str) -> None:
        self.items.append(("tag", name, 0, not self._never, self._within()))

    def _within(self) -> bool:
        return bool(self._at.get("article") or self._at.get("main"))

    def _pop(self) -> None:
        name, never, zone = self._stack.pop()
        self._at[name].pop()
        self._never -= never
        if zone:
            self._zones.pop()
        for names, kind in ((self._blocks, BLOCKS), (self._kept, _KEPT)):
            if name in kind:
                names.pop()

    def _open(self, name: str, words: set[str], closed: bool) -> None:
        for inner, enders in CLOSES.items():
            if name in enders and self._stack and self._stack[-1][0] == inner:
                self._pop()
        if name == "body" and self._at.get("head"):
            self._close("head")
        self._tag(name)
        if name not in VOID and not closed:
            zone = name in ZONES and not (name == "header" and self._within())  # an article has a header of its own
            never = (name in NEVER or bool(words & NOT_TEXT) or (name == "header" and zone)) and name not in _KEPT
            self._at.setdefault(name, []).append(len(self._stack))
            if zone:
                self._zones.append(name)
            if name in BLOCKS:
                self._blocks.append(name)
            if name in _KEPT:
                self._kept.append(len(self._stack))
            self._stack.append((name, never, zone))
            self._never += never

    def _close(self, name: str) -> None:
        at = self._at.get(name)
        if at and (name in _KEPT or not self._kept or at[-1] > self._kept[-1]):
            depth = at[-1]
            while len(self._stack) > depth:
                self._pop()
        self._tag("/" + name)

    def _text(self, text: str) -> None:
        if text:
            where = f"{self._zones[-1] if self._zones else ''}|{self._blocks[-1] if self._blocks else ''}|{'a' if self._at.get('a') else ''}"
            self.texts[len(self.items)] = text
            self.items.append(("text", where, len(text.split()), not self._never, self._within()))

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """The first of the contiguous ranges of items with the largest sum."""
        best, span, total, begin = 0.0, (0, 0), 0.0, 0
        for i, (kind, what, n, allowed, _) in enumerate(self.items):
            if allowed:
                total += word_weight(weights, what) * n if kind == "text" else tag_weight(weights, what)
            if total > best:
                best, span = total, (begin, i + 1)
            elif total <= 0:
                total, begin = 0.0, i + 1
        return span

    def text(self, weights: dict[str, float]) -> str:
        blocks, now = [], []
        lo, hi = self.region(weights)
        for i in range(lo, hi):
            kind, what, _, allowed, _ = self.items[i]
            if kind == "text":
                if allowed:
                    now.append(self.texts[i])
            elif what.lstrip("/") in BLOCKS:
                blocks.append(now)
                now = []
            elif what == "br":
                now.append(" ")
        said = (" ".join(unescape("".join(b)).split()) for b in [*blocks, now])
        return "\n\n".join(b for b in said if b)


def word_weight(weights: dict[str, float], feature: str) -> float:
    if feature in weights:
        return weights[feature]
    zone, _, rest = feature.partition("|")
    return -1.0 if zone else DEFAULTS.get(f"|{rest}", -0.3)


def tag_weight(weights: dict[str, float], tag: str) -> float:
    return min(weights.get("<" + tag.lstrip("/"), -0.2), -0.05)


def fit(pages: DataFrame, sample: int = 2000, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """Log odds of standing inside an article, by feature of words and by tag, from the labelled pages of a share of about
    `sample` pages, chosen by hashed id: nothing but counts leaves the tasks."""
    rows = pick(pages, id_col, html_col).toDF("id", "html")
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("html").rlike("(?i)<(article|main)[ >]"))
    schema = pa.schema([("feature", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in it:
            for html in b.column(0).to_pylist():
                for kind, what, n, allowed, within in Page(html).items:
                    if not allowed:
                        continue
                    key = what if kind == "text" else "<" + (w if (w := what.lstrip("/")) in BLOCKS | VOID | RAW | {"a", "b", "i", "em", "strong", "span"} else "?")
                    seen.setdefault(key, [0, 0])[not within] += n if kind == "text" else 1
        yield from batches(((k, x, y) for k, (x, y) in seen.items()), schema)

    sums = rows.select("html").mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("x"), F.sum("outside").alias("y"))
    return {f: max(-3.0, min(3.0, log((x + 1) / (y + 1)))) for f, x, y in sums.collect()}  # features are block names by zone: a few hundred at most


def extract(pages: DataFrame, weights: dict[str, float] | None = None, sample: int = 2000) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    known = fit(pages, sample) if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in it:
                for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    text = Page(html).text(known) if html else ""
                    yield page_id, url, text, len(text)

        yield from batches(rows(), schema, 500)

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
