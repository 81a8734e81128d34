"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of block elements from the root (names with class or
id). Per path the blocks' text length, punctuation and link text are added up; a path's length ratio is its text
per block, its punctuation ratio the marks per block. Both ratios are smoothed twice: a path's are averaged with
those of its container (a heading counts with its paragraphs), and neighbouring paths in page order lend each
other a little. The two are fused into one score, less what is link text and times what the path's elements say: an
article counts more, and a name with a word for adverts, notices, comments or forms counts less.

Parts whose name says nothing else (a form, ``comments``, ``ad-slot``) are never content, however long, as long as
some sentence of the page stands outside all of them. Where none does, the name is about the layout (a wrapper
``sidebar-right``) or the part is the page: the outermost one with the most text is opened, until a sentence is
outside. Other names (``social-history``, ``reply``) lower a score in the same cases. No name says anything about an article
below it.

Paths that reach `SHARE` of the page's best score are content. So is all else in an article or main element with
such a path, but for named parts that do not reach it themselves, and outside articles what lies in a container
that holds such a path and is mostly not link text: cells, captions, quotes and short sections stay with their
text. A page whose content lies in the body itself keeps all that lies there, lists, cells and quotes included.
Menus, footers, asides and hidden elements are never content. The text is the blocks in page order.

A page is one row and is handled where it lies: no shuffle, memory of one page at a time.

Edge cases: a null, empty or text-free page gives an empty text. Unclosed elements end with their container, end
tags without a start are ignored, and a tag or comment that the page's end cuts off is markup. Repeated rows give
repeated results. Extra columns are kept; those named like a result column are replaced by it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import free_name, map_arrow

#: Share of the page's best path score that makes a path content.
SHARE = 0.15
#: Weight of the containers before and after a container in page order.
NEIGHBOUR = 0.05
ARTICLE_BOOST = 20.0
#: What a hint in an element's name leaves of a score, outside articles and inside, where it is mostly a topic.
HINTED, HINTED_INSIDE = 0.02, 0.2
#: Characters from which a block with a punctuation mark reads as a sentence; an article's are taken as they are.
SENTENCE = 25
#: Share of link text from which a path below a content container is not taken along.
LINKED = 0.5

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")

_words = lambda text: frozenset(text.split())
_RAW = _words("script style noscript template textarea title xmp iframe noembed noframes")
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_BLOCK = _words("""html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody
    tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset details
    summary hgroup center dialog menu search select option button svg object audio video canvas""")
_CONTAINER = _words("html body article main section div td center figure blockquote")
#: Elements that never hold main text, and element names and class or id parts that hint at such elements.
_NEVER = _words("head nav footer aside dialog menu search select option button svg object audio video canvas")
_HINT_NAMES = _words("form fieldset")
_HINTS = _words("""ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie
    cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription
    signup social share sharing related recommended recommendations sidebar widget menu navbar navigation nav
    breadcrumb breadcrumbs pagination pager footer comment comments disqus respond reply replies discussion login
    search searchform form skip toolbar paywall""")
_PAGE_HINTS = _words("header masthead topbar")
#: Hints that are as likely the topic of a section: alone they lower a score, but decide nothing.
_TOPICS = _words("notice notices reply replies respond discussion related social share alert notification menu search login")
#: Words that say nothing about what a part is.
_NEUTRAL = _words("""list area section box block wrapper wrap container item body thread slot unit bar inner outer links
    link text top bottom left right row col column group panel title head id js the""")
#: A start tag that ends an open element of these names in the same container.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
         "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th", "p")}
_KEEPS_P_OPEN = _words("html body head")


class _Open:
    """An open block element: its path, its containers' paths, and what it says about its text.

    ``hints`` are the elements around it with a hint in their name, from the last article on, and ``named`` those of
    them whose name says nothing else; ``scope`` is the path of the nearest article, or of the nearest element with a
    hint inside it. ``flat`` elements lie in the page itself, in no section or the like.
    """

    __slots__ = ("name", "path", "container", "around", "never", "article", "hints", "named", "scope", "flat")

    def __init__(self, name: str, attributes: str, parent: _Open | None):
        found = {a.lower(): (b or c or d) for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        label = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        parts = {p.lower() for p in _PART.findall(label)}
        self.name = name
        starts = name in ("article", "main") or "main" in label.split()
        self.article = bool(parent and parent.article) or starts
        outside = not self.article
        self.never = bool(
            parent and parent.never or name in _NEVER or outside and name == "header"
            or "hidden" in found or found.get("aria-hidden") == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower())
        hint = not starts and name not in ("html", "body") and bool(
            name in _HINT_NAMES or parts & _HINTS or outside and parts & _PAGE_HINTS)
        known = _HINTS | _PAGE_HINTS
        tokens = [{p.lower() for p in _PART.findall(token)} for token in label.split()] if hint else []
        named = hint and (name in _HINT_NAMES or any(t & known - _TOPICS and t <= known | _NEUTRAL for t in tokens))
        self.path = (f"{parent.path if parent else ''}/{name}" + (f".{label.split()[0]}" if label.split() else "")
                     + "*" * starts + "!" * hint)
        self.container = self.path if name in _CONTAINER or hint or parent is None else parent.container
        # Containers whose text may take this element's along: not beyond a hint, and not the page itself.
        self.around = () if parent is None or starts or hint or name in ("html", "body") else parent.around
        if self.container == self.path and name not in ("", "html", "body"):
            self.around += (self.path,)
        self.hints = () if starts or parent is None else parent.hints
        self.named = () if starts or parent is None else parent.named
        if hint:
            self.hints += (self.path,)
        if named:
            self.named += (self.path,)
        self.flat = parent is None or parent.flat and name not in ("div", "section", "center", "article", "main")
        self.scope = self.path if starts or hint and self.article else parent.scope if parent else None


def blocks(page: str) -> list[tuple[_Open, str, int]]:
    """(element, text, characters of link text) of each block of a page, in page order."""
    root = _Open("", "", None)
    stack, out = [root], []
    text: list[str] = []
    links, link_chars, at = 0, 0, 0

    def close() -> None:
        nonlocal text, link_chars
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            out.append((stack[-1], words, min(link_chars, len(words))))
        text, link_chars = [], 0

    def add(part: str) -> None:
        nonlocal link_chars
        if part:
            text.append(part)
            if links:
                link_chars += len(part)

    while found := _MARKUP.search(page, at):
        add(page[at:found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if found["end"]:
            if name == "a":
                links = 0
            elif name in _BLOCK and any(o.name == name for o in stack):
                close()
                while stack.pop().name != name:
                    pass
                links = 0
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif name == "br":
            add(" ")
        elif name == "a":
            links = 1
        elif name == "hr":
            close()
        elif name in _BLOCK:
            close()
            links = 0
            ends = _ENDS.get(name, () if name in _KEEPS_P_OPEN else ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in ends:
                    del stack[k:]
                elif stack[k].name in _CONTAINER or stack[k].name in ("ul", "ol", "dl", "table"):
                    break
            stack.append(_Open(name, found["rest"] or "", stack[-1]))
    add(page[at:])
    close()
    return out


class _Sums:
    """Blocks, characters, link characters and punctuation marks of a path or container."""

    __slots__ = ("n", "chars", "linked", "marks")

    def __init__(self):
        self.n = self.chars = self.linked = self.marks = 0

    def add(self, chars: int, linked: int, marks: int) -> None:
        self.n += 1
        self.chars += chars
        self.linked += linked
        self.marks += marks


def _smoothed(values: list[float]) -> list[float]:
    """Each value with a little of the ones before and after it."""
    padded = [0.0, *values, 0.0]
    return [v + NEIGHBOUR * (padded[i] + padded[i + 2]) for i, v in enumerate(values)]


def _opened(found: list[tuple[_Open, str, int]], kind: str) -> set[str]:
    """Named parts that don't count as such: outside all others no sentence, or text of an article, is left."""
    opened: set[str] = set()
    sentences = [(getattr(element, kind), len(text)) for element, text, linked in found
                 if 2 * linked < len(text) and (element.article or len(text) >= SENTENCE and _MARKS.search(text))]
    while sentences:
        outermost: dict[str, int] = {}
        for around, size in sentences:
            part = next((h for h in around if h not in opened), None)
            if part is None:
                return opened
            outermost[part] = outermost.get(part, 0) + size
        opened.add(max(outermost, key=outermost.get))
    return opened


def main_text(page: str) -> tuple[str, int]:
    """The main text of a page and its number of blocks."""
    found = [b for b in blocks(page) if not b[0].never]
    opened = _opened(found, "named")
    found = [b for b in found if opened.issuperset(b[0].named)]
    opened = _opened(found, "hints")
    # Paths in page order, each with an element that has it.
    paths: dict[str, tuple[_Open, _Sums]] = {}
    containers: dict[str, _Sums] = {}
    for element, text, linked in found:
        sums = len(text), linked, len(_MARKS.findall(text))
        paths.setdefault(element.path, (element, _Sums()))[1].add(*sums)
        containers.setdefault(element.container, _Sums()).add(*sums)
    pairs = [(own, containers[element.container]) for element, own in paths.values()]
    lengths = _smoothed([(own.chars / own.n + near.chars / near.n) / 2 for own, near in pairs])
    marks = _smoothed([(own.marks / own.n + near.marks / near.n) / 2 for own, near in pairs])
    scores = {}
    for (path, (element, own)), length, mark in zip(paths.items(), lengths, marks):
        factor = ARTICLE_BOOST if element.article else 1.0
        if not opened.issuperset(element.hints):
            factor *= HINTED_INSIDE if element.article else HINTED
        scores[path] = factor * length * (1 + mark) * (1 - own.linked / own.chars)
    least = SHARE * max(scores.values(), default=0)
    content = {path for path, score in scores.items() if score >= least and score > 0}
    scopes = {paths[path][0].scope for path in content} - {None}
    held = {paths[path][0].container for path in content}
    flat = bool(content) and all(paths[path][0].flat and paths[path][0].scope is None for path in content)
    for path, (element, own) in paths.items():
        if flat and element.flat and own.linked < LINKED * own.chars:
            content.add(path)
        if element.scope in scopes or element.scope is None and own.linked < LINKED * own.chars and held.intersection(element.around):
            content.add(path)
    kept = [text for element, text, _ in found if element.path in content]
    return "\n".join(kept), len(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text, n_chars and n_blocks."""
    made = ("text", "n_chars", "n_blocks")
    kept = [c for c in pages.columns if c.lower() != html_col.lower() and c.lower() not in made]
    source = free_name(pages, "html_read")
    wide = pages.select(*kept, F.col(html_col).cast("string").alias(source))
    schema = wide.drop(source).schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()),
                 pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                names=[*batch.schema.names[:-1], *made])

    return map_arrow(wide, run, schema)
