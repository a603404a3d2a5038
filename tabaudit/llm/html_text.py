"""Main text of web pages from parser events: text-to-tag ratios, smoothing and clustering.

The standard library's parser streams events.  They are gathered into *lines*: the text between two block
boundaries, with the number of tags in it and the elements that enclose it.  Lines in elements
that are no article text by their kind (menus, footers, scripts) are marked as boilerplate.  So are those in forms and
in elements with certain words in their class, id or role (adverts, notices, comments, sidebars), but only where
these hold a minor share of the text around them: an element with most of it is a wrapper ("no-sidebar", a form
around the whole page) and only its inner elements are judged.  Marks of this kind never leave a page without text.

For the others the ratio of text to tags is smoothed with a Gaussian over neighbouring lines and split into two
clusters by the threshold between their means.  The upper cluster gives the content regions.  The
element that holds most of their text is the article, and all its unmarked lines are
returned, also short ones between regions.  It is widened to the elements around it (titles, leads, further parts)
while what they add is not mostly links; the body adds lines of its own and lines whose ratio reaches the threshold before
smoothing, as smoothing lifts a notice beside a long paragraph.  Where no element encloses the regions, the lines from the first
region to the last one are returned, without those that are mostly links, and so are the lines before and after them
that stand directly in the same element as most of the regions (titles, short paragraphs), up to one that does not.

White space inside a line becomes one space and lines are joined by a line break.  Null or empty pages
and pages without text give an empty text.  Nothing is cut.  Repeated rows give equal texts.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabaudit.functions.columns import col
from tabaudit.llm.frames import decoded, id_type, sliced, text_bytes

SIGMA = 1.0
RADIUS = 2

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var".split()
)
# Elements that never hold article text; a header does where it belongs to an article.
_NEVER = frozenset(
    "aside button canvas datalist footer head iframe menu nav noscript object script select style svg template"
    " textarea title".split()
)
_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist"
    " consent contentinfo cookie cookies copyright disclaimer discussion disqus dialog footer gdpr legal menu modal nav navbar"
    " navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended"
    " related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription teaser toolbar topbar widget alert complementary".split()
)
_HEADERS = frozenset("header masthead".split())
_CONTAINERS = frozenset("article main section div td body center".split())
_CLOSED_BY_BLOCKS = frozenset(["p"])
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _names(value: str | None) -> set[str]:
    parts = re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", value or "")
    return {p.lower() for p in parts if p}


# Kinds of marks: none, a form or a word inside a longer name, a name of such words alone, an element's kind.
_NONE, _WEAK, _STRONG, _SURE = range(4)


class Line:
    __slots__ = ("text", "tags", "link_chars", "containers", "marked", "named")

    def __init__(self, text: str, tags: int, link_chars: int, containers: tuple[int, ...], marked: bool, named: tuple[int, ...]) -> None:
        self.text, self.tags, self.link_chars = text, tags, link_chars
        self.containers, self.marked, self.named = containers, marked, named

    @property
    def plain(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.link_chars)

    @property
    def ratio(self) -> float:
        return self.plain / max(1, self.tags)

    @property
    def linked(self) -> bool:
        return 2 * self.link_chars > len(self.text)


class Named:
    """An element marked by its name: its ``group`` is that of its like inside the same marked element (``scope``)."""

    __slots__ = ("scope", "strong", "group")

    def __init__(self, scope: int, strong: bool, group: tuple) -> None:
        self.scope, self.strong, self.group = scope, strong, group


class _Events(HTMLParser):
    """Gather lines; ``kinds`` has the tag of each container number, ``named`` the elements marked by name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self.named: list[Named] = []
        self.inside: list[int] = []  # open elements marked by name
        self.open: list[tuple[str, int, int | None]] = []  # tag, mark, container
        self.boilerplate = self.articles = self.links = 0
        self.pieces: list[str] = []
        self.tags = self.link_chars = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            containers = tuple(c for _, _, c in self.open if c is not None)
            self.lines.append(Line(text, self.tags, self.link_chars, containers, self.boilerplate > 0, tuple(self.inside)))
        self.pieces, self.tags, self.link_chars = [], 0, 0

    def _mark(self, tag: str, attributes: list[tuple[str, str | None]]) -> int:
        if tag in _NEVER:
            return _SURE
        values = [v or "" for k, v in attributes if k in ("class", "id", "role")]
        if tag in ("html", "body", "article", "main"):
            values = [] if tag != "article" else [v for v in values if _names(v) & {"comment", "comments"}]
            if values:
                return _SURE
        named = set().union(*map(_names, values), set())
        if tag == "header":
            return _NONE if self.articles else _SURE
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attributes):
            return _STRONG
        # A header's name counts only outside articles, and there as that of other boilerplate.
        words = _WORDS if self.articles else _WORDS | _HEADERS
        if named & _HEADERS and self.articles or not named & words and tag != "form":
            return _NONE
        parts = [_names(part) for value in values for part in value.split()]
        return _STRONG if any(p and p <= words for p in parts) else _WEAK

    def _pop(self) -> None:
        tag, mark, _ = self.open.pop()
        self.boilerplate -= mark == _SURE
        if mark in (_WEAK, _STRONG):
            self.inside.pop()
        self.articles -= tag in ("article", "main")
        self.links -= tag == "a"

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._end_line()
            if self.open and self.open[-1][0] in _CLOSED_BY_BLOCKS | _SIBLINGS.get(tag, set()):
                self._pop()
            else:
                # inline elements that were left open do not reach over the end of their paragraph
                at = len(self.open)
                while at and self.open[at - 1][0] in _INLINE:
                    at -= 1
                if at and at < len(self.open) and self.open[at - 1][0] == "p":
                    while len(self.open) >= at:
                        self._pop()
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        if tag in _VOID:
            return
        container = None
        if tag in _CONTAINERS:
            container = len(self.kinds)
            self.kinds.append(tag)
        mark = self._mark(tag, attributes)
        self.open.append((tag, mark, container))
        self.boilerplate += mark == _SURE
        if mark in (_WEAK, _STRONG):
            scope = self.inside[-1] if self.inside else -1
            names = tuple(sorted((k, v or "") for k, v in attributes if k in ("class", "role")))
            self.inside.append(len(self.named))
            self.named.append(Named(scope, mark == _STRONG, (scope, tag, mark, names)))
        self.articles += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        if tag in _VOID or all(t != tag for t, _, _ in self.open):
            return
        if tag in _INLINE and any(t in _BLOCKS for t, _, _ in self.open[self._last(tag) :]):
            return  # it was closed with its block
        while self.open:
            done = self.open[-1][0] == tag
            self._pop()
            if done:
                break

    def _last(self, tag: str) -> int:
        return max(i for i, (t, _, _) in enumerate(self.open) if t == tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.pieces.append(data)
        if self.links:
            self.link_chars += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def parse(page: str) -> tuple[list[Line], list[str]]:
    events = _Events()
    events.feed(page)
    events.finish()
    _mark_named(events)
    return events.lines, events.kinds


def _mark_named(events: _Events) -> None:
    """Mark the lines of elements with boilerplate names, but for elements that hold most of the text around them.

    A name of such words alone ("comments") must hold nine tenths to be a wrapper.  Forms and longer names
    ("has-comments") are wrappers if those of one scope hold more than half of what is left, and each that holds a tenth
    is one then.  Neither is where an ``article`` outside has a quarter of its text.
    """
    lines = [line for line in events.lines if not line.marked]
    held: dict[int | tuple, int] = defaultdict(int)
    in_articles = 0
    articles: dict[int | tuple, int] = defaultdict(int)
    for line in lines:
        held[-1] += line.plain
        inside = {n for n in line.named} | {events.named[n].group for n in line.named}
        for n in inside:
            held[n] += line.plain
        if any(events.kinds[c] == "article" for c in line.containers):
            in_articles += line.plain
            for n in inside:
                articles[n] += line.plain
    wrappers = {-1}

    def elsewhere(group: tuple) -> bool:
        outside = in_articles - articles[group]
        return outside > 0 and 4 * outside >= held[group]

    by_scope: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for n, element in enumerate(events.named):
        by_scope[element.scope][element.group].append(n)
    for scope in sorted(by_scope):  # outer elements have lower numbers
        if scope not in wrappers:
            continue
        groups, total = by_scope[scope], held[scope]
        weak = []
        left = total
        for group, members in groups.items():
            if not events.named[members[0]].strong:
                weak.append(group)
            elif 10 * held[group] > 9 * total and not elsewhere(group):
                wrappers.update(members)
            else:
                left -= held[group]
        if 2 * sum(held[group] for group in weak) > left:
            for group in weak:
                if 10 * held[group] >= left and not elsewhere(group):
                    wrappers.update(groups[group])
    marked = [any(n not in wrappers for n in line.named) for line in lines]
    if not all(marked):
        for line, mark in zip(lines, marked):
            line.marked = mark


def smoothed(ratios: list[float]) -> np.ndarray:
    """Gaussian over neighbouring lines; at the ends the weights that exist count."""
    values = np.array(ratios, float)
    weights = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    total = np.convolve(values, weights, "full")[RADIUS : RADIUS + len(values)]
    return total / np.convolve(np.ones(len(values)), weights, "full")[RADIUS : RADIUS + len(values)]


def split_at(values: np.ndarray) -> float:
    """The threshold halfway between the means of the values below and above it."""
    threshold = float(values.mean())
    for _ in range(100):
        low, high = values[values < threshold], values[values >= threshold]
        moved = float(((low.mean() if len(low) else threshold) + (high.mean() if len(high) else threshold)) / 2)
        if math.isclose(moved, threshold, rel_tol=1e-9):
            break
        threshold = moved
    return threshold


def _article(lines: list[Line], kinds: list[str], in_region: list[bool]) -> int | None:
    """The element that holds the regions: an article or main with half their text, or the innermost with most of it."""
    held: dict[int, int] = defaultdict(int)
    total = 0
    for line, chosen in zip(lines, in_region):
        if chosen:
            total += len(line.text)
            for container in line.containers:
                held[container] += len(line.text)
    named = [c for c in held if kinds[c] in ("article", "main") and 2 * held[c] >= total]
    if named:
        return max(named, key=lambda c: (kinds[c] == "article", held[c], c))
    most = [c for c in held if kinds[c] != "body" and 10 * held[c] >= 8 * total]
    return max(most) if most else None  # inner elements have higher numbers


def _grown(lines: list[Line], in_region: list[bool]) -> list[Line]:
    """Lines from the first region to the last, and on both sides those directly in the element of most of them."""
    direct: dict[int, int] = defaultdict(int)
    for line, chosen in zip(lines, in_region):
        if chosen:
            direct[line.containers[-1] if line.containers else -1] += len(line.text)
    home = max(direct, key=lambda c: (direct[c], -c))
    first, last = in_region.index(True), len(in_region) - in_region[::-1].index(True)

    def at_home(line: Line) -> bool:
        return not line.linked and (line.containers[-1] if line.containers else -1) == home

    while first and at_home(lines[first - 1]):
        first -= 1
    while last < len(lines) and at_home(lines[last]):
        last += 1
    return [line for line in lines[first:last] if not line.linked]


def _widened(article: int, lines: list[Line], kinds: list[str], dense: list[bool]) -> list[Line]:
    """The article's lines with those that the elements around it add, up to an element that adds mostly links.

    The body adds its own lines and dense ones only, and other articles with linked lines are teasers.
    """
    chosen = [article in line.containers for line in lines]
    path = next(line.containers for line, c in zip(lines, chosen) if c)
    inner = path.index(article)
    teasers = {
        c for k, line in enumerate(lines) if not chosen[k] and line.linked
        for c in line.containers if kinds[c] == "article" and c not in path[: inner + 1]
    }
    for at in range(inner - 1, -1, -1):
        around = path[at]
        if kinds[article] == "main":
            break
        added = [k for k, line in enumerate(lines) if not chosen[k] and around in line.containers and not teasers & set(line.containers)]
        if sum(lines[k].link_chars for k in added) > sum(lines[k].plain for k in added):
            break
        for k in added:
            own = kinds[around] != "body" or dense[k] or lines[k].containers[-1] == around
            chosen[k] = own and not lines[k].linked
        article = around
    return [line for line, c in zip(lines, chosen) if c]


def main_text(page: str) -> str:
    lines, kinds = parse(page)
    lines = [line for line in lines if not line.marked]
    if not lines:
        return ""
    values = smoothed([line.ratio for line in lines])
    threshold = split_at(values)
    in_region = [bool(v >= threshold) for v in values]
    article = _article(lines, kinds, in_region)
    if article is not None:
        dense = [line.ratio >= threshold for line in lines]
        chosen = _widened(article, lines, kinds, dense)
    else:
        chosen = _grown(lines, in_region)
    return "\n".join(line.text for line in chosen)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(decoded(h)) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            columns.append(pa.array([len(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {id_type(pages, id_column)}, url string, text string, n_chars long"
    return pages.select(col(id_column), col(url_column).cast("string"), text_bytes(html_column)).mapInArrow(run, schema)
