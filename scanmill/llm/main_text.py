"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of text pieces and tags. Words add a weight by the element that holds them, tags subtract one by
their name and class; one linear scan finds the contiguous run of the largest sum. Weights are log odds of standing inside
the content, counted on labelled pages: those that mark their content by an article or main element, at most `max_pages`
of them with the smallest hashes of their ids. Menus, adverts, forms and the like inside the run are left out; they are
known by tag, or by a class, id or role all of whose parts are such words ("cookie-notice", not "no-sidebar"). The page itself,
article and main are never left out, nor is a header, form or marked element that holds most of the page's words, unless an article, main
or first heading stands outside it and none inside.

Defined cases: a null or empty page, or one where no run has a positive sum, gives an empty text; unclosed tags and comments end where
the page ends; without labelled pages every word adds 1 and every tag takes 1; other columns pass through unread.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.words import pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:(?P<end></(?P=raw)\s*>)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_KIND = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 table section article main aside nav footer header form blockquote pre".split()), "li": frozenset(["li"])}
_BOILERPLATE_TAGS = frozenset("head title nav aside footer header form button dialog menu".split())
_BOILERPLATE_WORD = r"(?:ad|ads|advert\w*?|banner|sponsor\w*?|promo\w*?|nav|navigation|menu|breadcrumbs?|header|footer|sidebar|cookies?|consent|notice|newsletter|subscribe|share|social|related|comments?|respond|popup|modal|search)"
_BOILERPLATE_KIND = re.compile(rf"(?:^|\s){_BOILERPLATE_WORD}(?:[_-]+{_BOILERPLATE_WORD})*(?:$|\s)", re.IGNORECASE)
_NEVER = frozenset(["html", "body", "main", "article"])
#: What can stand round a whole page: a form or header, and any element marked only by its class, id or role.
_WRAPS = frozenset(["form", "header"])


@dataclass
class Item:
    """A text piece (name is the element that holds it) or a tag."""

    name: str
    text: str | None
    boilerplate: bool
    marked: bool  # inside an article or main element
    block: bool = False  # a tag that ends a block


@dataclass(slots=True)
class _Open:
    """An open tag. What depends on the tags round it is carried along, so that no tag or text walks the stack."""

    tag: str
    name: str
    element: int
    marked: bool
    holder: str  # name of the nearest open element that words count for: a link, or one that is not inline
    block: int  # place in the stack of the nearest open element that is not inline


def _goes_on(m: re.Match[str]) -> bool:
    """Whether a comment or raw element lacks its end."""
    if m[0].startswith("<!--"):
        return not m[0].endswith("-->") or len(m[0]) < 7
    return m["raw"] is not None and m["end"] is None


def items(page: str) -> list[Item]:
    out: list[Item] = []
    stack = [_Open("", "", 0, False, "", 0)]  # the first is the page
    opened: Counter[str] = Counter()
    elements = [_Element(0, False, False)]
    of: list[int] = []  # the element that decides about each item
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            top = stack[-1]
            out.append(Item(top.holder, piece, False, top.marked))
            of.append(top.element)
            elements[top.element].words += len(piece.split())

    def close(place: int) -> None:
        opened.subtract(x.tag for x in stack[place:])
        del stack[place:]

    # Behind the last ">" no tag can end; to look for one there from each "<" would not be linear.
    last = page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, last):
        text(page[at : m.start()])
        at = len(page) if m.end() == last and _goes_on(m) else m.end()
        tag = m["name"]
        if tag is None:
            continue
        tag = tag.lower()
        top = stack[-1]
        if m["close"]:
            if opened[tag] > 0:
                found = len(stack) - 1
                while stack[found].tag != tag:
                    found -= 1
                name = stack[found].name
                close(found)
            else:
                name = tag
            out.append(Item("/" + name, None, False, top.marked, tag not in _INLINE))
            of.append(top.element)
            continue
        while tag in _CLOSED_BY.get(stack[stack[-1].block].tag, ()):
            close(stack[-1].block)
        top = stack[-1]
        kind = " ".join(next(filter(None, g), "") for g in _KIND.findall(m["attrs"]))
        name = f"{tag}.{kind.lower().strip()}" if kind.strip() else tag
        bad = tag not in _NEVER and (tag in _BOILERPLATE_TAGS or bool(_BOILERPLATE_KIND.search(kind)))
        good = top.marked or tag in ("article", "main")
        own = len(elements)
        elements.append(_Element(top.element, bad, tag in _WRAPS or tag not in _BOILERPLATE_TAGS, int(tag in ("article", "main", "h1"))))
        out.append(Item(name, None, False, good, tag not in _INLINE))
        of.append(own)
        if tag not in _VOID and not m["attrs"].endswith("/"):
            inline = tag in _INLINE
            opened[tag] += 1
            stack.append(_Open(tag, name, own, good, top.holder if inline and tag != "a" else name, top.block if inline else len(stack)))
    comment = page.find("<!--", max(at, last))
    text(page[at:] if comment < 0 else page[at:comment])
    left_out = _left_out(elements)
    for item, e in zip(out, of, strict=True):
        item.boilerplate = left_out[e]
    return out


@dataclass
class _Element:
    """Counts are of the element itself, then of all it holds."""

    parent: int
    bad: bool
    wraps: bool
    marks: int = 0  # article, main and h1
    words: int = 0


def _left_out(elements: list[_Element]) -> list[bool]:
    for e in elements[:0:-1]:
        elements[e.parent].words += e.words
        elements[e.parent].marks += e.marks
    page, out = elements[0], [False]
    for e in elements[1:]:
        whole = e.wraps and 2 * e.words > page.words and (e.marks > 0 or page.marks == 0)
        out.append(out[e.parent] or e.bad and not whole)
    return out


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, item: Item) -> float:
        if item.text is None:
            return self.tags.get(item.name, -1.0)
        return self.words.get(item.name, 1.0) * len(item.text.split())


def learn(counts: list[tuple[str, bool, int, int]]) -> Weights:
    """From (name, is a tag, times inside the content, times outside): log odds, words of unknown elements 1, tags below 0."""
    out = Weights()
    for is_tag in (False, True):
        rows = [r for r in counts if r[1] == is_tag]
        inside, outside = sum(r[2] for r in rows) + 1, sum(r[3] for r in rows) + 1
        for name, _, a, b in rows:
            odds = math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside)
            if is_tag:
                out.tags[name] = min(-0.1, max(-8.0, odds))
            else:
                out.words[name] = min(4.0, max(-4.0, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum, the first and shortest of equals; (0, 0) without one."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    all_items = items(page)
    start, end = best_run([weights.of(x) for x in all_items])
    blocks, block = [], []
    for x in all_items[start:end]:
        if x.text is None:
            if x.block:
                blocks.append(block)
                block = []
            elif x.name == "br":
                block.append(" ")
        elif not x.boilerplate:
            block.append(html.unescape(x.text))
    blocks.append(block)
    return "\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def train(pages: DataFrame, max_pages: int = 2000) -> Weights:
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select("page_id", F.xxhash64("html").alias("h"))
    sample = marked.orderBy(F.xxhash64("page_id"), "page_id", "h").limit(max_pages).select("page_id").distinct()  # at most max_pages ids
    labelled = pages.select("page_id", "html").join(F.broadcast(sample), "page_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in pieces(batches, "html"):
            for page in batch.column("html").to_pylist():
                for x in items(page or ""):
                    seen[x.name, x.text is None, x.marked and not x.boilerplate] += 1 if x.text is None else len(x.text.split())
        rows = [(n, t, c if i else 0, 0 if i else c) for (n, t, i), c in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], k) for k in _KINDS], names=["name", "tag", "inside", "outside"])

    counted = labelled.mapInArrow(count, "name string, tag boolean, inside long, outside long")
    return learn(sorted(tuple(r) for r in counted.groupBy("name", "tag").agg(F.sum("inside"), F.sum("outside")).collect()))


_KINDS = (pa.string(), pa.bool_(), pa.int64(), pa.int64())


def main_text(pages: DataFrame, max_pages: int = 2000) -> DataFrame:
    """(page_id, url, text) for each row of `pages`."""
    weights = pages.sparkSession.sparkContext.broadcast(train(pages, max_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [extract(p, weights.value) if p else "" for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
