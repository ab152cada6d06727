"""Main text of web pages: what a site repeats is found by hashes of element subtrees and taken out.

A task reads each page once and hashes the tags and texts of every element's
subtree, paragraphs, list items, menus and footers included. Spark counts the
hashes per host, over pages of different content (copies of a page count once),
and subtrees on ``MIN_PAGES`` such pages of a host are deleted, however many
pages the host has. Nothing inside of an article is deleted so.

Parts that a host shows on one page only cannot recur. They are left out by tag
and role (menus, page headers and footers, sidebars, forms) or by class, and
where a page names its article, only that is read. Inside of an article or main
part only a class that consists of such words as a whole counts, so that
``share-price`` or a list of class ``menu`` stay.

Defined results: null or empty html has an empty text; pages without a readable
host form one host; equal pages get equal texts; broken markup is read as far as
it can be, and a ``<`` that opens no tag is text; after a tag whose quotes never
end, tags of that page end at their first ``>``; a page of any length or depth
takes time and memory in proportion to its length; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmine.llm.batches import Kernel, annotate, quoted
from reviewmine.sources.shared import materialize

MIN_PAGES = 3  # pages of different content that make a subtree of theirs a part of the site

OPENING = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
# up to the > that is not inside of quotes
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
RAW = {
    tag: re.compile(rf"</{tag}\s*+>", re.I)
    for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
}
ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
NO_CHARACTER = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")  # beyond all code points
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th tr caption figcaption summary".split())
CONTAINERS = frozenset(
    "address center details div dl fieldset figure header hgroup ol section table tbody tfoot thead ul".split()
)
SKIPPED = frozenset(
    "aside audio button canvas dialog embed footer form head math menu nav object optgroup option select svg video".split()
)
ARTICLES = frozenset("article main".split())
INLINE = frozenset("audio button canvas embed math object select svg video".split())  # skipped without ending a block
BLOCKS = PROSE | CONTAINERS | (SKIPPED - INLINE) | ARTICLES | frozenset("html body".split())
VOID = frozenset("area base br col hr img input link meta param source track wbr embed".split())
SIBLINGS = {
    "li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "table tr"), "th": ("td th", "table tr"), "thead": ("tr td th", "table"),
    "tbody": ("thead tbody tr td th", "table"), "tfoot": ("tbody tr td th", "table"),
}
UNCLOSED = frozenset("nav header head form ul ol p".split())  # an article that starts inside of these ends them

AROUND = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login
    sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar
    share sharing social related recommended comment comments disqus respond reply replies widget copyright search""".split()
)
ASIDE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
INSIDE = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsored cookie cookies consent gdpr notice newsletter
    sidebar breadcrumb breadcrumbs pagination comment comments disqus""".split()
)
NEUTRAL = frozenset("area bar block box card container inner item items list section slot unit wrapper".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
NAMED = ("class", "id")
WITHOUT = frozenset("has with no without".split())  # a class such as has-sidebar is about something else


def hash64(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    return entities.unescape(NO_CHARACTER.sub("\ufffd", ZEROS.sub(r"&#\1", text)))


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``("", text, "")``, ``("<", tag, attributes)`` and ``("/", tag, "")``, each character looked at a few times."""
    place, at, last, quotes = 0, html.find("<"), html.rfind(">"), True
    while at >= 0:
        found, end = None, -1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
        elif at < last and (found := OPENING.match(html, at)):
            rest = REST.match(html, found.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else html.index(">", found.end()) + 1
        elif at < last and html[at + 1] in "!?/":
            end = html.index(">", at) + 1
        if end < 0:
            at = html.find("<", at + 1)
            continue
        yield "", html[place:at], ""
        if found:
            tag = found[2].lower()
            if tag in RAW and not found[1]:
                close = RAW[tag].search(html, end)
                end = close.end() if close else len(html)
            else:
                yield found[1] or "<", tag, html[found.end() : end - 1]
        place, at = end, html.find("<", end)
    yield "", html[place:], ""


@dataclass(slots=True)
class Element:
    """An open element."""

    tag: str
    first: int  # block
    level: int = 0  # 2 inside of an article, 1 inside of main
    outer: int = 0  # depth of the outermost skipped element around it, or of itself; 0 if there is none
    parts: list[str] = field(default_factory=list)
    before: list[str] | None = None  # text of the block that a skipped inline element stands in


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id."""
    found = []
    for name in NAMED:
        for one in attributes.get(name, "").split():
            words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())
            if words and words[0] not in WITHOUT:
                found.append(set(words))
    return found


def _wholly(names: Iterable[set[str]], listed: frozenset[str]) -> bool:
    """Whether some name has a listed word and no others but neutral ones."""
    return any(words & listed and words <= listed | NEUTRAL for words in names)


def _beside(tag: str, attributes: dict[str, str], level: int) -> bool:
    """Whether an element is never main text."""
    if tag in ("html", "body", "main"):
        return False
    if tag in SKIPPED or (tag == "header" and not level):
        return True
    if not attributes:
        return False
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return True
    names = _names(attributes)
    if tag == "article":
        return _wholly(names, ASIDE)
    if role in ROLES:
        return True
    if level:
        return _wholly(names, INSIDE)
    return any(words & AROUND or "header" in words for words in names)


class Page:
    """One page: its blocks of text and its elements, hashed.

    ``blocks`` are ``(text, level, skipped)``; ``elements`` are ``(hash, tag,
    level, first block, end)`` of all that have text. ``open`` has the open
    elements, ``depths`` the depths of those of each tag, and ``solid`` of those
    that a paragraph around them stays open for.
    """

    def __init__(self, html: str):
        self.open = [Element("", 0)]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.solid = [0]
        self.text: list[str] = []
        self.blocks: list[tuple[str, int, bool]] = []
        self.elements: list[tuple[int, str, int, int, int]] = []
        for kind, value, more in tokens(html):
            if kind == "<":
                self._start(value, more)
            elif kind:
                self._end(value)
            elif value:
                self.text.append(unescape(value))
        self._close_to(1)
        self._cut()

    def _cut(self) -> None:
        """Ends a block."""
        if self.text:
            if words := " ".join("".join(self.text).split()):
                at = self.open[-1]
                self.blocks.append((words, at.level, bool(at.outer)))
                at.parts.append(words)
            self.text.clear()

    def _push(self, element: Element) -> None:
        self.depths[element.tag].append(len(self.open))
        if element.tag != "p" and (element.tag in BLOCKS or element.tag in INLINE):
            self.solid.append(len(self.open))
        self.open.append(element)

    def _close(self) -> None:
        self._cut()
        done = self.open.pop()
        self.depths[done.tag].pop()
        if self.solid[-1] == len(self.open):
            self.solid.pop()
        if done.parts:
            value = hash64(done.tag + "\0" + "\1".join(done.parts))
            self.elements.append((value, done.tag, done.level, done.first, len(self.blocks)))
            self.open[-1].parts.append(f"\2{value}")
        if done.before is not None:
            self.text = done.before

    def _deepest(self, tags: str) -> int:
        """Depth of the innermost open element of some tags; 0 if there is none."""
        return max((self.depths[tag][-1] for tag in tags.split() if self.depths[tag]), default=0)

    def _close_to(self, depth: int) -> None:
        """Closes the element at a depth and all inside of it."""
        while len(self.open) > depth:
            self._close()

    def _end_paragraph(self) -> None:
        depth = self._deepest("p")
        if depth > self.solid[-1]:
            self._close_to(depth)

    def _start(self, tag: str, more: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._end_paragraph()
                self._cut()
            return
        attributes = _attributes(more) if more and not more.isspace() else {}
        block = tag in BLOCKS
        if block:
            self._end_paragraph()
            if tag in SIBLINGS:
                same, stop = SIBLINGS[tag]
                while (depth := self._deepest(same)) > self._deepest(stop):
                    self._close_to(depth)
            outer = self.open[-1].outer
            if tag in ("body", *ARTICLES) and outer and self.open[outer].tag in UNCLOSED:
                self._close_to(outer)
            self._cut()
        around = self.open[-1]
        beside = _beside(tag, attributes, around.level)
        if block or beside or around.outer:
            level = 2 if tag == "article" else 1 if tag == "main" or attributes.get("role") in ("main", "article") else 0
            outer = around.outer or (len(self.open) if beside else 0)
            element = Element(tag, len(self.blocks), max(level, around.level), outer)
            if not block:
                element.before, self.text = self.text, []
            self._push(element)

    def _end(self, tag: str) -> None:
        if depth := self._deepest(tag):
            self._close_to(depth)
        elif tag in BLOCKS:
            self._cut()

    def read(self, rules: bool = True) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The blocks to keep, and ``(hash, first, end)`` of the elements that may be parts of the site, by these blocks.

        Without ``rules`` all blocks are kept, so that only the count decides.
        """
        best = max((level for _, level, skipped in self.blocks if not skipped), default=0) if rules else 0
        kept = [not rules or (level >= best and not skipped) for _, level, skipped in self.blocks]
        number = [0, *accumulate(map(int, kept))]
        parts = []
        for value, tag, level, first, end in self.elements:
            first, end = number[first], number[end]
            if tag not in ("html", "body", "main") and (best < 2 or (level < 2 and first == end)):
                parts.append((value, first, end))
        return [text for (text, _, _), keep in zip(self.blocks, kept, strict=True) if keep], parts


def _kernel(rules: bool) -> Kernel:
    def kernel(pages: list) -> list:
        columns: tuple = ([], [], [], [])
        for page in pages:
            blocks, parts = Page(page or "").read(rules)
            inside = [{"part": part, "first": a, "end": b} for part, a, b in parts if a < b]
            single = list({part for part, _, _ in parts})
            for column, value in zip(columns, (blocks, single, inside, hash64("\n".join(blocks))), strict=True):
                column.append(value)
        return list(columns)

    return kernel


FIELDS = "blocks array<string>, parts array<bigint>, inside array<struct<part:bigint,first:int,end:int>>, content bigint"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def templates(parts: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, part)`` of the subtrees that recur, from rows ``(host, content, parts)``."""
    single = parts.select("host", "content", F.explode("parts").alias("part")).distinct()
    counts = single.groupBy("host", "part").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_pages).select("host", "part")


def _left(firsts: Sequence[int], ends: Sequence[int], total: int) -> list[dict[str, int]]:
    """The runs of blocks outside of some ranges, as places from 1 and lengths."""
    runs, place = [], 0
    for first, end in sorted(zip(firsts, ends, strict=True)):
        if first > place:
            runs.append({"start": place + 1, "length": int(first) - place})
        place = max(place, int(end))
    if total > place:
        runs.append({"start": place + 1, "length": total - place})
    return runs


RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))


@F.pandas_udf(RUNS)
def left_runs(firsts: pd.Series, ends: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([_left(*row) for row in zip(firsts, ends, total.tolist(), strict=True)], dtype=object)


def main_text(
    pages: DataFrame,
    html: str = "html",
    url: str = "url",
    carry: Sequence[str] | None = None,
    min_pages: int = MIN_PAGES,
    rules: bool = True,
) -> DataFrame:
    """``(row, text)`` for every page: the blocks of its main text, joined by line breaks.

    Without ``rules`` only recurring subtrees are left out.
    """
    host = F.coalesce(F.lower(F.regexp_extract(quoted(url).cast("string"), HOST, 1)), F.lit(""))
    names = pages.columns if carry is None else carry
    source = pages.select(host.alias("host"), quoted(html).alias("html"), F.struct(*map(quoted, names)).alias("row"))
    rows = annotate(source, lambda: _kernel(rules), FIELDS, "html", carry=["host", "row"])
    place = F.monotonically_increasing_id().alias("place")
    rows = materialize(rows.select(place, F.col("row.host").alias("host"), F.col("row.row").alias("row"), "out"))
    parts = rows.select("host", F.col("out.content").alias("content"), F.col("out.parts").alias("parts"))
    recurring = materialize(templates(parts, min_pages))
    inside = rows.select("place", "host", F.size("out.blocks").alias("total"), F.inline("out.inside"))
    found = inside.join(recurring, ["host", "part"]).groupBy("place", "total")
    ranges = found.agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    runs = materialize(ranges.select("place", left_runs("ranges.first", "ranges.end", "total").alias("runs")))
    left = F.flatten(F.transform("runs", lambda run: F.slice("out.blocks", run["start"], run["length"])))
    blocks = F.when(F.col("runs").isNull(), F.col("out.blocks")).otherwise(left)
    return rows.join(runs, "place", "left").select("row", F.array_join(blocks, "\n").alias("text"))
