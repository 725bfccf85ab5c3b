"""The article of a web page: the best-scoring stretch of its words and tags.

Words score positive and tags negative, by weights counted on pages that mark their article. One linear
scan finds the stretch with the largest sum; it grows to the element that holds it.
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
from pyspark.sql import types as T

from sourcelore.llm.common import column, packed

#: Bound of the sample of labelled pages, by hash of their id.
SAMPLE = 2000
#: Fixed values of HTML.
RAW = {"script", "style", "template", "noscript", "iframe", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
#: Roots of other markup languages, in which any tag may close itself, and what these do not show.
FOREIGN, FOREIGN_RAW = {"svg", "math"}, {"desc", "metadata"}
FORM = {"form", "button", "select", "textarea", "input", "label", "fieldset", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mstyle", "munder",
    "mover", "munderover", "mpadded", "mphantom", "menclose", "mfenced", "merror", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "tspan", "annotation", "annotation-xml",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKED = {"article", "main"}
ROLE_OF_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "head": "head", "title": "head"}
ROLE_OF_ARIA = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside",
    "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "alertdialog": "notice",
}
#: Elements of a form that may be wrapped around a whole page.
WRAPPING = {"form", "fieldset"}
#: Names of classes and ids that tell what an element is.
ROLE_OF_NAME = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar",
    "footer": "footer copyright colophon",
    "aside": "sidebar aside widget related recommended recommendations share sharing social",
    "notice": "notice notices cookie cookies consent gdpr banner alert popup modal overlay disclaimer newsletter subscribe subscription paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion",
    "comment": "comment comments disqus respond replies reply",
    "form": "form login signup search",
}
_NAMED = {name: role for role, names in ROLE_OF_NAME.items() for name in names.split()}
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: First words of names that say what an element has, not what it is.
_HAVING = {"has", "have", "with", "without", "no", "not", "hide", "show", "is", "and", "content", "page", "layout", "body"}
_SPLIT_NAME = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    role: str | None
    marked: bool
    #: The element's own role, and whether it is one that a mere wrapper may have.
    own: str | None = None
    soft: bool = False
    #: A heading in a marked element.
    title: bool = False
    first: int = 0
    last: int = 0
    depth: int = 0


@dataclass
class Page:
    """What the scan sees: (feature, text, element, starts_block) in page order; text is None for tags."""

    items: list[tuple[str, str | None, Element]] = field(default_factory=list)
    breaks: set[int] = field(default_factory=set)


def _tag_end(text: str, start: int) -> int:
    """Just behind the tag that begins here; a quote that never closes is no quote."""
    at = start
    while stop := _TAG_STOP.search(text, at):
        if stop[0] == ">":
            return stop.end()
        close = text.find(stop[0], stop.end())
        if close < 0:
            end = text.find(">", stop.end())
            return end + 1 if end >= 0 else len(text)
        at = close + 1
    return len(text)


def _named_role(value: str) -> str | None:
    """Role by a class or id: by a whole name, or a compound whose last word is one ('cookie-banner', not 'sidebar-wrap')."""
    for name in value.split():
        if name.lower() in _NAMED:
            return _NAMED[name.lower()]
        words = [w.lower() for w in _SPLIT_NAME.split(name) if w]
        if words and words[-1] in _NAMED and not _HAVING.intersection(words[:-1]):
            return _NAMED[words[-1]]
    return None


def _role(tag: str, attributes: str) -> tuple[str | None, bool]:
    """Role of an element by its tag and attributes, and whether a wrapper may have it."""
    if tag in FORM:
        return "form", tag in WRAPPING
    if tag in ROLE_OF_TAG:
        return ROLE_OF_TAG[tag], False
    if tag in MARKED or tag in ("html", "body") or not attributes:
        return None, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLE_OF_ARIA:
            return ROLE_OF_ARIA[value.lower()], True
        if name in ("class", "id"):
            role = _named_role(value)
            if role:
                return role, True
    return None, False


def _settle_roles(elements: list[Element]) -> None:
    """Roles from those of the elements themselves; an element stands behind its parent in the list."""
    for e in elements:
        e.role = None if e.title and e.parent.role == "header" else e.own or e.parent.role


def _unwrap(page: Page, elements: list[Element]) -> None:
    """Take the role from wrappers: from what holds the marked article, or most of the plain words of a page without one.

    If some marked element with words has no role, it is the article and all roles stay. Comments may well be longer than
    what they comment on, so they are unwrapped for a marked article only.
    """
    words: dict[int, int] = {}
    for feature, text, element in page.items:
        if text is not None and feature == "word:plain":
            words[id(element)] = words.get(id(element), 0) + len(text.split())
    # Words of an element that would be plain without the roles of possible wrappers around it.
    held: dict[int, int] = {}
    hard: dict[int, bool] = {}
    for e in elements:
        hard[id(e)] = not (e.title and e.parent.own == "header") and (bool(e.own and not e.soft) or hard.get(id(e.parent), False))
    for e in reversed(elements):
        mine = held.get(id(e), 0) + (0 if hard[id(e)] else words.get(id(e), 0))
        held[id(e)] = mine
        held[id(e.parent)] = held.get(id(e.parent), 0) + mine
    marked = [e for e in elements if e.marked and held[id(e)]]
    if any(e.role is None for e in marked):
        return
    if marked:
        at = max(marked, key=lambda e: held[id(e)])
        while at is not None:
            if at.soft:
                at.own = None
            at = at.parent
    else:
        total = words.get(id(elements[0].parent), 0) + sum(0 if hard[id(e)] else words.get(id(e), 0) for e in elements)
        for e in elements:
            if e.soft and e.own != "comment" and 2 * held[id(e)] > total:
                e.own = None
    _settle_roles(elements)


def parsed(text: str) -> Page:
    """Tokens of a page, well-formed or not.

    Comments, scripts, styles and the like leave nothing; so does what a page shows only in place of something
    (noscript, the inside of objects and media) and the sources of formulas. Words of formulas and drawings stay.
    """
    page, root = Page(), Element("", None, None, False)
    stack, at, size = [root], 0, len(text)
    elements: list[Element] = []
    foreign = 0

    def words(raw: str) -> None:
        here = stack[-1]
        plain = html.unescape(raw)
        if plain:
            page.items.append(("word:link" if any(e.tag == "a" for e in stack[-4:]) else "word:plain", plain, here))

    def tag_item(name: str, element: Element) -> None:
        if name not in INLINE:
            page.breaks.add(len(page.items))
        if foreign:
            return  # the shapes of a drawing say nothing of the page
        page.items.append((f"tag:{name}" if name.isascii() and name.isalnum() and len(name) < 12 else "tag:other", None, element))

    def pop(to: int) -> None:
        nonlocal foreign
        while len(stack) > to:
            gone = stack.pop()
            gone.last = len(page.items)
            foreign -= gone.tag in FOREIGN

    while at < size:
        mark = text.find("<", at)
        if mark < 0:
            words(text[at:])
            break
        if mark > at:
            words(text[at:mark])
        if text.startswith("<!--", mark):
            end = text.find("-->", mark + 4)
            at = end + 3 if end >= 0 else size
            continue
        if text.startswith(("<!", "<?"), mark):
            end = text.find(">", mark)
            at = end + 1 if end >= 0 else size
            continue
        closing = text.startswith("</", mark)
        named = _TAG_NAME.match(text, mark + 1 + closing)
        if not named:
            words("<")
            at = mark + 1
            continue
        tag = named[0].lower()
        at = _tag_end(text, named.end())
        if at == size and text[-1:] != ">":
            break  # cut off within a tag
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # An inline end tag closes nothing beyond its block.
            if depth and not (tag in INLINE and any(e.tag not in INLINE for e in stack[depth + 1 :])):
                tag_item(tag, stack[depth])
                pop(depth)
            else:
                tag_item(tag, stack[-1])
            continue
        if tag not in INLINE:
            # A new block ends an open paragraph, an item an open item.
            ends = {"p"} | ({tag} if tag in ("li", "tr", "td", "th", "dt", "dd", "option") else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        attributes = text[named.end() : at - 1]
        parent = stack[-1]
        own, soft = _role(tag, attributes)
        element = Element(tag, parent, None, tag in MARKED, own, soft, tag in HEADINGS and any(e.marked for e in stack), len(page.items), depth=parent.depth + 1)
        elements.append(element)
        tag_item(tag, element)
        itself = attributes.endswith("/") and (foreign or tag in FOREIGN)
        if itself:
            element.last = len(page.items)
        elif tag in RAW or (foreign and tag in FOREIGN_RAW):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            at = _tag_end(text, end.end()) if end else size
        elif tag not in VOID:
            stack.append(element)
            foreign += tag in FOREIGN
    pop(0)
    _settle_roles(elements)
    if any(e.soft for e in elements):
        _unwrap(page, elements)
    page.items = [(f"word:{e.role}" if words is not None and e.role else feature, words, e) for feature, words, e in page.items]
    return page


@dataclass
class Weights:
    """Log-odds of a feature to be inside an article; plain words are held above zero, tags below it."""

    of: dict[str, float] = field(default_factory=dict)

    @classmethod
    def counted(cls, inside: dict[str, int], outside: dict[str, int]) -> Weights:
        names = set(inside) | set(outside)
        all_in, all_out = sum(inside.values()) + len(names), sum(outside.values()) + len(names)
        return cls({n: math.log((inside.get(n, 0) + 1) / all_in) - math.log((outside.get(n, 0) + 1) / all_out) for n in names})

    def score(self, feature: str, text: str | None) -> float:
        if text is None:
            return min(self.of.get(feature, -1.0), -0.05)
        number = len(text.split())
        if feature == "word:plain":
            return number * max(self.of.get(feature, 1.0), 0.5)
        return number * min(self.of.get(feature, -1.0), -0.05 if feature != "word:link" else 0.25)


def best_stretch(page: Page, weights: Weights) -> tuple[int, int]:
    """First and last item of the stretch with the largest sum (0, -1 if no sum is positive)."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, (feature, text, _) in enumerate(page.items):
        if total <= 0:
            total, start = 0.0, i
        total += weights.score(feature, text)
        if total > best:
            best, found = total, (start, i)
    return found


def extracted(text: str | None, weights: Weights) -> str:
    """Blocks of the article, joined by an empty line."""
    page = parsed(text or "")
    first, last = best_stretch(page, weights)
    if last < first:
        return ""
    # Grow to the smallest element that holds both ends, unless that is the page itself.
    a, b = page.items[first][2], page.items[last][2]
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    holder = a
    while holder.tag in INLINE or holder.tag == "p":
        holder = holder.parent
    marked = holder
    while marked is not None and not marked.marked:
        marked = marked.parent
    holder = marked or holder
    if holder.tag not in ("", "html", "body"):
        first, last = holder.first, holder.last - 1
    blocks, here = [], []

    def close() -> None:
        block = _BLANK.sub(" ", "".join(here)).strip()
        if block:
            blocks.append(block)
        here.clear()

    for i in range(first, last + 1):
        feature, words, element = page.items[i]
        if i in page.breaks:
            close()
        if words is not None:
            if element.role is None:
                here.append(words)
        elif feature == "tag:br":
            here.append(" ")
    close()
    return "\n\n".join(blocks)


def label_counts(text: str) -> tuple[Counter, Counter]:
    """Features inside and outside the marked article, empty for a page that marks none."""
    page = parsed(text)
    inside, outside = Counter(), Counter()
    for feature, words, element in page.items:
        at = element
        while at is not None and not at.marked:
            at = at.parent
        (outside if at is None or element.role else inside)[feature] += 1 if words is None else len(words.split())
    return (inside, outside) if inside else (Counter(), Counter())


def trained(pages: DataFrame, id_name: str = "page_id", html_name: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` pages that mark their article; without any, words score 1 and tags -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column("html").to_pylist():
                a, b = label_counts(text or "")
                inside += a
                outside += b
        names = sorted(set(inside) | set(outside))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())],
            names=["feature", "inside", "outside"],
        )

    marked = F.regexp_like(column(html_name), F.lit("(?i)<(article|main)[\\s>]"))
    named = pages.select(column(id_name).alias("id"), column(html_name).alias("html")).where(marked & F.col("id").isNotNull())
    chosen = named.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    texts = named.join(F.broadcast(chosen), "id")
    counts = texts.select("html").mapInArrow(count, "feature string, inside long, outside long")
    # Known tags and kinds of words only: a few hundred rows.
    rows = counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(500).collect()
    if not rows:
        return Weights()
    return Weights.counted({r["feature"]: r["inside"] for r in rows}, {r["feature"]: r["outside"] for r in rows})


def articles(pages: DataFrame, weights: Weights, html_name: str = "html") -> DataFrame:
    """The rows (as struct ``row``) with ``text``: the article of the whole page, empty if there is none.

    Null pages count as empty. Character references are decoded, white space inside a block becomes one space, blocks
    are trimmed and joined in page order by two line ends.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                made = [extracted(text, weights) for text in part.column("row").field(html_name).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(made, pa.string())], names=["row", "text"])

    rows = pages.select(packed(pages).alias("row"))
    return rows.mapInArrow(convert, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))


def article_report(pages: DataFrame) -> DataFrame:
    """Per page, repeated rows included: page_id, url, text, n_chars (code points)."""
    found = articles(pages.select(*[column(c).alias(c) for c in ("page_id", "url", "html")]), trained(pages))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
