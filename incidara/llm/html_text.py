"""HTML extraction by line-block distribution.

A page is cut at its tags (``br`` too) into lines, one for each block element.  Containers that never hold the
article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) are stripped
with all they hold.  What is left is a sequence of lines, each with a weight: its length, and what its
element says of it.  A line's block is the sum of weights in the window that begins at it.  Text begins at
surge points, where a block reaches a threshold with a line that is no mere fragment or is a heading, and ends at dive points,
where the block falls below half the threshold or a line has no weight.  All such runs are kept; runs with at
most a window of lines between them are one, with these lines.

Element names are evidence for the points: on a page with an ``article`` (else a ``main``, else a container that
names itself the article's body), lines inside gain the threshold, so that short paragraphs and short
articles stay whole, and lines outside lose their weight: there the result is what these elements hold.  The evidence fails where a run outside
has over ``OUTWEIGHED`` times their text (teasers marked as articles); then, as without such elements, lengths alone
decide.  A page none of whose blocks surges is one run.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidara.shipping import shipped

#: Lines in a window, and characters at which a block surges.
WINDOW = 3
SURGE = 80
#: How many times the text of the page's article a run of lines outside must have to outweigh it.
OUTWEIGHED = 4

#: Elements whose content is never text.
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "title")
#: Elements that hold no part of the article.
_OUTSIDE = frozenset(("nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"))
#: Elements that stand within a line; all others end it.
_INLINE = frozenset(
    (
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
        "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    )
)
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements that a start tag of the same kind, or the end of their parent, closes.
_LOOSE = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "colgroup"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class, id or role that mark a container as outside the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|footer|masthead|"
    r"site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|disqus|replies|respond|related|recommend\w*|share|sharing|social|widget|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Outside an article also these whole names.
_EDGE_NAMES = re.compile(r"(?:^|\s)(?:header|foot|top|bottom)(?:\s|$)", re.IGNORECASE)
#: Names of a container that holds the article.
_BODY_NAMES = re.compile(
    r"(?:^|\s)(?:main|article|(?:article|post|entry|story|main|page)[_-]?(?:body|content|text)|content[_-]?(?:body|main)?)(?:\s|$)", re.IGNORECASE
)
#: How near a line is to the article: in such an element, in a container of such a name.
IN_ARTICLE, IN_BODY = 2, 1
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)"
    r"|</?[a-zA-Z][^<>]*+>",  # quantifiers never give back: no tag is tried in two ways
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _is_outside(name: str, attributes: str, inside: bool) -> bool:
    if name in _OUTSIDE or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "article", "main", "p", "br"):
        return False
    if _HIDDEN.search(attributes):
        return True
    names = [" ".join(found[1:]).strip() for found in _NAMED.findall(attributes)]
    return any(_NAMES.search(n) or (not inside and _EDGE_NAMES.search(n)) for n in names)


def _level(name: str, attributes: str) -> int:
    if name == "article":
        return IN_ARTICLE
    if name == "main" or (attributes and name in ("div", "section", "td") and any(_BODY_NAMES.search(" ".join(f[1:]).strip()) for f in _NAMED.findall(attributes))):
        return IN_BODY
    return 0


class Line(NamedTuple):
    """A line of text, how near to the article it stands, and whether it is a heading."""

    text: str
    level: int
    heading: bool


class _Open:
    """The open elements of a page.  Opening is constant work and so, for each element opened, is closing."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int]] = []  # name, whether it is an excluded container, its level
        self.places: dict[str, list[int]] = {}  # of the open elements of a name
        self.excluded: list[int] = []  # places of excluded containers
        self.blocks: list[int] = []  # places of elements that end a line
        self.levels = [0, 0, 0]  # open containers of bodies (1) and of articles (2)

    def push(self, name: str, excluded: bool, level: int) -> None:
        at = len(self.stack)
        self.stack.append((name, excluded, level))
        self.places.setdefault(name, []).append(at)
        if excluded:
            self.excluded.append(at)
        if name not in _INLINE:
            self.blocks.append(at)
        self.levels[level] += 1

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            name, excluded, level = self.stack.pop()
            self.places[name].pop()
            if excluded:
                self.excluded.pop()
            if name not in _INLINE:
                self.blocks.pop()
            self.levels[level] -= 1

    def end(self, name: str) -> None:
        """Close the nearest element of a name and what it left open; not from inside an excluded container."""
        places = self.places.get(name)
        if places and (name in ("body", "html") or not self.excluded or places[-1] >= self.excluded[-1]):
            self.close_from(places[-1])

    @property
    def level(self) -> int:
        return IN_ARTICLE if self.levels[IN_ARTICLE] else IN_BODY if self.levels[IN_BODY] else 0


def page_lines(page: str) -> list[Line]:
    """Lines of text outside the excluded containers; time is in proportion to the page, whatever its tags."""
    lines: list[Line] = []
    parts: list[str] = []
    tags = _Open()
    met = heading = False  # an article or its container has begun; the line is in a heading

    def end_line() -> None:
        nonlocal heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, tags.level, heading))
            parts.clear()
        heading = False

    at = 0
    for tag in _TAG.finditer(page):
        if tag.start() > at and not tags.excluded:
            parts.append(page[at : tag.start()])
        at = tag.end()
        if tag[3] is None:
            continue
        name, attributes = tag[3].lower(), tag[4]
        if name not in _INLINE:
            end_line()
        if name in _VOID:
            continue
        if tag[2]:
            tags.end(name)
            continue
        if attributes.endswith("/") and name not in _INLINE:
            continue
        if name in ("article", "main") and tags.excluded and not met:  # a container before it was never closed
            tags.close_from(tags.excluded[0])
        if name in _LOOSE and tags.blocks and tags.stack[tags.blocks[-1]][0] == name:
            tags.close_from(tags.blocks[-1])
        excluded = _is_outside(name, attributes, tags.levels[IN_ARTICLE] > 0)
        if excluded:
            end_line()
        level = 0 if excluded or tags.excluded else _level(name, attributes)
        met |= level > 0
        heading = heading or name in _HEADINGS
        tags.push(name, excluded, level)
    if at < len(page) and not tags.excluded:
        parts.append(page[at:])
    end_line()
    return lines


def _surges(own: list[int], headings: list[bool], window: int, surge: int) -> list[tuple[int, int]]:
    """Runs between surge and dive points of lines with these weights."""
    sums = [0, *itertools.accumulate(own)]
    blocks = [sums[min(i + window, len(own))] - sums[i] for i in range(len(own))]
    runs: list[tuple[int, int]] = []
    begin = None
    for i, block in enumerate([*blocks, 0]):
        if begin is None:
            if i < len(own) and block >= surge and (own[i] >= surge // 4 or (headings[i] and own[i])):
                begin = i
        elif i == len(own) or not own[i] or (block < surge // 2 and own[i] < surge // 4):
            if runs and begin - runs[-1][1] <= window and all(own[runs[-1][1] : begin]):
                begin = runs.pop()[0]
            runs.append((begin, i))
            begin = None
    return runs


def weights(lines: list[Line], window: int = WINDOW, surge: int = SURGE, outweighed: int = OUTWEIGHED) -> list[int]:
    """Length of each line, and on a page with a container of the article what the line's place adds or takes.

    Lines outside have no weight, unless a run of them alone is so much longer than all that the containers hold that these
    cannot be the article: then places count for nothing.
    """
    lengths = [len(line.text) for line in lines]
    nearest = max((line.level for line in lines), default=0)
    if not nearest:
        return lengths
    inside = [line.level == nearest for line in lines]
    held = sum(itertools.compress(lengths, inside))
    others = [0 if held_in else n for n, held_in in zip(lengths, inside, strict=True)]
    runs = _surges(others, [line.heading for line in lines], window, surge)
    if any(sum(others[begin:end]) > outweighed * held for begin, end in runs):
        return lengths
    return [n + surge if held_in else 0 for n, held_in in zip(lengths, inside, strict=True)]


def text_runs(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Surge and dive points of the text: first lines, and the ones after the last."""
    return _surges(weights(lines, window, surge), [line.heading for line in lines], window, surge)


def extract(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of one page: its lines joined by newlines."""
    lines = page_lines(page)
    runs = text_runs(lines, window, surge) or [(0, len(lines))]
    return "\n".join(line.text for begin, end in runs for line in lines[begin:end])


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``.

    Null html counts as empty and gives empty text; null ids and urls stay null.  Each repeated row is extracted
    for itself.  Other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", window, surge) for page in batch.column("html")]
            out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    kind = pages.select("page_id").schema[0].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return shipped(rows).mapInArrow(scan, f"page_id {kind}, url string, text string, n_chars long")
