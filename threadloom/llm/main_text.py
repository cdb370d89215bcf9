"""Main text of web pages by removing what a site repeats.

Every container element's subtree is hashed, whatever its tag or class says. The
hashes are counted per host in Spark, and a subtree that recurs on many pages of
a host is part of its template and deleted. Pages are told apart by the text the
rules below leave of them: copies of one article count once. Near copies are
told by the smallest hashes of their words' triples: a subtree is no
template if fewer than half of its pages differ in it. So neither makes an article
a template, nor does a subtree that holds half of that text ever become one.
Only then marks are used. Elements whose tag, role or class says what they are
(menus, headers, footers, sidebars, notices, adverts, forms, comments) go, and if
a page marks its article, text outside of it goes. An article inside such an
element goes with it, unless it holds more than the rest of a page without any
other article (a class named after a layout, broken markup). A class names what it
says as a whole or as a part of a compound, not after "has" or "no"; where no
article is marked, an element that only its class names and that holds more than
half of what the page has left is its text, whatever the class says.

What is left is cut into blocks at block elements; character references are
decoded, white space inside a block becomes one space, blocks are joined by a
line feed in page order.

Null and empty pages have an empty text. Broken markup is read as far as it
goes: a paragraph ends where the next block begins, stray end tags are passed
over, an unclosed element ends with its parent. Pages without a host take part
in no site. Repeated rows are all returned; pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.urls import with_parts
from threadloom.session import written

#: A template recurs on at least so many pages of its host that differ in their own text.
MIN_PAGES = 5

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas math audio video select textarea button form nav footer "
    "aside menu dialog title".split())
CONTAINERS = frozenset("div section nav header footer aside form ul ol menu table figure center fieldset".split())
#: Elements that an equal or a sibling element ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
FENCES = frozenset("article main section div table ul ol dl body html td th".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

# Words in a class or id that name what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice popup modal overlay newsletter subscribe signup paywall sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended widget pagination "
    "comment comments respond reply replies disqus".split())
COMMENT_NAMES = frozenset("comment comments respond reply replies disqus".split())
# Words that begin the name of a state, not of a part.
STATES = frozenset("has no not with without is show hide hidden js".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S)
_attribute = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_words = re.compile(r"[a-z0-9]+").findall
_raw_end = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


class _Element:
    __slots__ = ("tag", "first", "marks", "dropped", "named", "header", "main", "heading", "holds_main", "in_main", "chars", "classed")

    def __init__(self, tag: str, first: int, in_main: bool):
        self.tag, self.first, self.in_main = tag, first, in_main
        self.marks: list[bytes] = []
        self.dropped = self.named = self.header = self.main = self.heading = self.holds_main = self.classed = False
        self.chars = 0


class Page:
    """One parse: ``segments`` (block, text), which are kept, and the subtrees that may be templates."""

    def __init__(self, html: str):
        self.segments: list[tuple[int, str]] = []
        self.gone: list[tuple[int, int]] = []  # first and last segment of what marks drop
        self.inside: list[bool] = []  # in the article
        self.under: tuple[list, list] = ([], [])  # what holds an article and a class or form drops, or a tag or role
        self.classed: list[tuple[int, int]] = []  # what only a class drops, without an article
        self.subtrees: list[tuple[int, int, int, int]] = []  # hash, first and last segment, characters
        self.block = 0
        self.stack = [_Element("#page", 0, False)]
        self.open: dict[str, int] = {}
        self._read(html)
        while len(self.stack) > 1:
            self._close()
        kept = self._sums(not d for d in self._dropped([]))
        half = self._lengths(kept)
        self.subtrees = [s for s in self.subtrees if 2 * s[3] < half[-1] or kept[s[1]] == kept[s[2]]]

    def _sums(self, flags: Iterable) -> list[int]:
        return [0, *accumulate(map(int, flags))]

    def _lengths(self, kept: list[int]) -> list[int]:
        """Characters left before each segment, from the running number of segments left."""
        return [0, *accumulate(len(t) if b > a else 0 for (_, t), a, b in zip(self.segments, kept, kept[1:]))]

    def _covered(self, spans: Iterable[tuple[int, int]]) -> list[bool]:
        """Which segments lie in a span."""
        change = [0] * (len(self.segments) + 1)
        for first, last in spans:
            change[first] += 1
            change[last] -= 1
        return [n > 0 for n in accumulate(change[:-1])]

    def _dropped(self, templates: list[tuple[int, int]]) -> list[bool]:
        """What the templates drop, and the marks of the rest."""
        drop = self._covered([*self.gone, *templates])
        under = [2 if t else int(c) for c, t in zip(self._covered(self.under[0]), self._covered(self.under[1]))]
        if self.classed:
            drop = self._without_classed(drop)
        size = [0, 0, 0]  # left by ``under``
        marked = False
        for (_, text), gone, inside, level in zip(self.segments, drop, self.inside, under):
            if not gone:
                size[level] += len(text.strip())
                marked |= inside and not level
        most = 0
        if not marked:
            if size[1] > size[0]:
                most = 1
            elif not size[0] and size[2]:
                most = 2
        drop = [d or u > most for d, u in zip(drop, under)]
        if any(i and not d for i, d in zip(self.inside, drop)):
            drop = [d or not i for d, i in zip(drop, self.inside)]
        return drop

    def _without_classed(self, drop: list[bool]) -> list[bool]:
        """``drop`` and what a class drops, but for elements that hold more than half of the text that is left."""
        if any(i and not d for i, d in zip(self.inside, drop)):
            gone = self._covered(self.classed)
        else:
            here = [0, *accumulate(0 if d else len(t.strip()) for (_, t), d in zip(self.segments, drop))]
            gone = self._covered(s for s in self.classed if 2 * (here[s[1]] - here[s[0]]) <= here[-1])
        return [d or g for d, g in zip(drop, gone)]

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while True:
            m = _token.search(html, at) if at <= last else None
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            tag = name.lower()
            if m.group(1) or m.group(4):
                self._end(tag)
                continue
            attributes = m.group(3) or m.group(6) or ""
            if tag in RAW:
                end = _raw_end[tag].search(html, at)
                at = end.end() if end else len(html)
                continue
            self._start(tag, attributes)

    def _text(self, text: str) -> None:
        if not text or text.isspace() and not self.segments:
            return
        if "&" in text:
            text = unescape(text)
        top = self.stack[-1]
        top.marks.append(text.strip().encode("utf-8", "surrogatepass"))
        top.chars += len(text)
        self.segments.append((self.block, text))
        self.inside.append(top.in_main)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.block += 1
            self._end_implied("p", ("p",))
            if tag in SIBLINGS:
                self._end_implied(tag, SIBLINGS[tag])
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        element = _Element(tag, len(self.segments), self.stack[-1].in_main)
        names: set[str] = set()
        role = ""
        if attributes:
            for m in _attribute.finditer(attributes):
                value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
                if m.group(1).lower() == "role":
                    role = value.strip()
                else:
                    for word in value.split():
                        parts = _words(word)
                        if parts and parts[0] not in STATES:
                            names.update(parts)
            element.marks.append(" ".join(sorted(names)).encode("utf-8", "surrogatepass"))
        about_comments = bool(names & COMMENT_NAMES)
        if (tag in ("article", "main") or role in ("main", "article")) and not about_comments:
            element.main = element.holds_main = element.in_main = True
        elif tag not in ("html", "body"):
            element.header = tag == "header" or "header" in names
            element.dropped = tag in DROPPED or role in ROLES or bool(names & NAMES) or about_comments
            element.named = tag == "form" or not (tag in DROPPED or role in ROLES)
            element.classed = element.dropped and not (tag in DROPPED or role in ROLES or about_comments)
        if tag in ("h1", "h2"):
            element.heading = True
        self.stack.append(element)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end_implied(self, tag: str, ended: tuple[str, ...]) -> None:
        """Close the nearest open element of ``ended``, not beyond a fence of another kind."""
        if not any(self.open.get(t) for t in ended):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in ended:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i].tag in FENCES and not (tag == "tr" and self.stack[i].tag in ("td", "th")):
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self._close()
                return
            if self.stack[i].main and tag not in ("body", "html"):
                return  # a stray end tag does not close the article

    def _close(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        parent = self.stack[-1]
        if e.tag in BLOCKS:
            self.block += 1
        first, last = e.first, len(self.segments)
        dropped = e.dropped or (e.header and not (e.in_main and e.heading))
        if dropped and e.classed and not e.in_main and not e.holds_main and last > first:
            self.classed.append((first, last))
        elif dropped and (e.in_main or not e.holds_main):
            self.gone.append((first, last))
        elif dropped:
            self.under[0 if e.named else 1].append((first, last))
        body = b"\x1f".join([e.tag.encode("utf-8", "surrogatepass"), *e.marks])
        mark = xxhash.xxh3_64_intdigest(body)
        if last > first and not e.main and e.tag in CONTAINERS:
            self.subtrees.append((mark - (1 << 63), first, last, e.chars))
        parent.marks.append(mark.to_bytes(8, "big"))
        parent.chars += e.chars
        parent.holds_main |= e.holds_main
        parent.heading |= e.heading

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks that are left without the subtrees of ``templates``."""
        drop = self._dropped([s[1:3] for s in self.subtrees if s[0] in templates])
        blocks: dict[int, list[str]] = {}
        for (block, text), gone in zip(self.segments, drop):
            if not gone:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


def _parsed(df: DataFrame) -> DataFrame:
    """Host, key of host and page, hash of the text by the rules alone, and the hashes of the subtrees that may be templates."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kinds, marks = [], [], []
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                left = page.text()
                own.append(xxhash.xxh3_64_intdigest(left.encode("utf-8", "surrogatepass")) - (1 << 63))
                kinds.append(sketch(left))
                marks.append(sorted({s[0] for s in page.subtrees}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("key"), pa.array(own, pa.int64()), pa.array(kinds, pa.int64()),
                 pa.array(marks, pa.list_(pa.int64()))], ["host", "key", "own", "kind", "marks"])

    return df.select("host", "key", "html").mapInArrow(parse, "host string, key binary, own long, kind long, marks array<long>")


def sketch(text: str) -> int:
    """The smallest of three hashes of three words in a row: mostly equal for near copies, which share most such triples."""
    words = text.split()
    triples = (" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 2)))
    made = [xxhash.xxh3_128_intdigest(t) for t in triples]
    least = [min((h >> shift) & (1 << 42) - 1 for h in made) for shift in (0, 42, 84)]
    return xxhash.xxh3_64_intdigest(repr(least).encode()) - (1 << 63)


def _templates(pages: DataFrame, min_pages: int) -> DataFrame:
    """(host, mark) of the subtrees that recur on many pages of their host that differ in their own text."""
    seen = pages.select("host", "own", "kind", F.explode("marks").alias("mark")).distinct()
    often = seen.groupBy("host", "mark", "kind").agg(F.count(F.lit(1)).alias("pages"))
    often = often.groupBy("host", "mark").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("kinds"))
    return often.filter((F.col("kinds") >= min_pages) & (2 * F.col("kinds") >= F.col("pages"))).select("host", "mark")


def _cleared(df: DataFrame) -> DataFrame:
    """The text without the subtrees in ``gone``."""
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html or "").text(set(gone or ())) for html, gone in
                     zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return df.mapInArrow(clear, "page_id long, url string, text string")


def extract(
    df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(page_id, url, text) of every row. Pages are parsed twice, as a copy of them costs more disk."""
    named = with_parts(df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"),
                                 F.col(f"`{html}`").alias("html")))
    # What goes depends on host and page alone.
    key = F.unhex(F.md5(F.concat_ws("\n", "u.host", "html")))
    pages = named.select("page_id", "url", "html", F.col("u.host").alias("host"), key.alias("key"))
    parsed = written(_parsed(pages.filter("host <> ''")), "pages")
    templates = _templates(parsed, min_pages)
    marks = parsed.groupBy("host", "key").agg(F.first("marks").alias("marks")).select("host", "key", F.explode("marks").alias("mark"))
    gone = marks.join(templates, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("gone"))  # at most a page's own subtrees
    return _cleared(pages.join(gone, "key", "left").select("page_id", "url", "html", "gone"))


def report(df: DataFrame, **options) -> DataFrame:
    """Main text and its length in code points, for every row."""
    return extract(df, **options).withColumn("n_chars", F.length("text").cast("long"))
