"""Main text of web pages: streaming parser events, text-to-tag ratios per line, smoothing and a threshold.

The standard library's event parser runs once over a page. Events build lines: a line ends at every block
element and at ``<br>``. Subtrees whose element cannot be article text (scripts, menus, forms, ...) or is hidden
never reach a line. Each line has a ratio of its characters to its tags (links count twice). The ratios are smoothed
with a Gaussian kernel and split by 2-means into content and the rest. The region is the innermost container that
holds nearly all content characters; it never goes below an ``<article>``. Inside an article every line counts, so
short paragraphs stay; in other regions lines of links are dropped.

A class, id or role that names another part (``ad``, ``sidebar``, ...) cuts nothing: it puts the lines of its element
in doubt. A line in doubt has its ratio lowered to a quarter, is kept only where that still reaches the border of the
other lines, and does not decide on the region, however much text its element holds. A name does not count on ``<main>``,
``<body>`` and ``<html>``, on ``<article>`` unless it says comment or reply, and on an element that holds the main part or
the first heading. The main part is the ``<article>``, or else the ``<main>``, with the most text outside named
elements, if it has a tenth of the page's. Where all text is in doubt, the outermost named element with the most text is
trusted (one whose name only ends in such a word, like ``content-with-sidebar``, before others), and so on inwards until
a line is. Of containers with equal text the first is chosen.

Containers and names point to those around them and are numbered in page order, so what lies inside one is a range of
numbers and sums run from the last to the first: work grows with the length of a page, not with its depth.

End tags that HTML lets an author leave out (``p``, ``li``, ``dt``, ``dd``, ``td``, ``th``, ``tr``, ``option``, ...) are
implied where the standard implies them.

Pages are independent rows: no shuffle, and one page at a time in memory.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set(
    "html body article main section div nav header footer aside form ul ol dl menu table blockquote details figure "
    "head script style noscript template button select textarea iframe svg object dialog fieldset canvas".split()
)
NEVER = set(
    "head script style noscript template nav footer aside form button select textarea iframe svg object dialog "
    "fieldset menu canvas".split()
)
#: Names in class, id or role that put a part in doubt.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs masthead topbar header footer cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login search comment comments "
    "commentlist reply replies discussion disqus respond share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager copyright contentinfo complementary form".split()
)
#: Elements whose own names do not count, and the names that count on an article.
NAMELESS = {"html", "body", "main"}
REMARKS = {"comment", "comments", "reply", "replies"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What the ratio of a line in doubt is multiplied by, and the share of the page's text that a main part has at least.
DOUBT = 0.25
MAIN_SHARE = 0.1

#: For a start tag: the open elements it ends, and the elements beyond which it ends nothing.
IMPLIED: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, CONTAINERS - {"div"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, CONTAINERS - {"div"})),
    **dict.fromkeys(("td", "th"), ({"td", "th", "caption"}, {"table", "template", "tr"})),
    "tr": ({"tr", "caption"}, {"table", "template"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption"}, {"table", "template"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, CONTAINERS)),
}
ENDS_P = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
P_SCOPE = set("html table caption td th button object template".split())
#: For an end tag: the open elements beyond which it ends nothing.
ENDS = {"li": CONTAINERS - {"div"}, "dt": CONTAINERS - {"div"}, "dd": CONTAINERS - {"div"},
        **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), {"table", "template"})}


def _named(value: str, names: set[str] = NAMES) -> int:
    """2 if a class, id or role names a part that may not be the article (``ad``, ``ad-top``), 1 if it only ends so
    (``site-footer``, ``content-with-sidebar``), else 0."""
    found = 0
    for name in value.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and parts[0] not in ("has", "with", "no"):
            found = max(found, 2 if parts[0] in names else parts[-1] in names)
    return found


class _Open:
    """The stack of open elements, which finds the innermost of any names at once."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, int, bool, int]] = []  # element, container number, excluded, innermost name
        self.places: dict[str, list[int]] = {}

    def push(self, element: tuple[str, int, bool, int]) -> None:
        self.places.setdefault(element[0], []).append(len(self.elements))
        self.elements.append(element)

    def innermost(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.elements) > place:
            self.places[self.elements.pop()[0]].pop()


class _Lines(HTMLParser):
    """Collects lines as [text, tags, characters in links, container, block element, innermost name].

    ``parents`` has the number of the container around each container, ``kinds`` its element; ``names`` has the name around
    each name, the container that its element is (0 if it is none), and how sure the name is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = _Open()
        self.parents, self.kinds = [-1], [""]
        self.names: list[tuple[int, int, int]] = [(-1, 0, 0)]
        self.lines: list[list] = []
        self.headed: set[int] = set()
        self.first_heading: int | None = None
        self.block = ""
        self.links = 0
        self._new()

    def _new(self) -> None:
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def _inner(self) -> tuple[str, int, bool, int]:
        return self.open.elements[-1] if self.open.elements else ("", 0, False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, number, _, name = self._inner()
            if self.block in HEADINGS and self.first_heading is None:
                self.first_heading = len(self.lines)
            self.lines.append([text, self.tags, self.linked, number, self.block, name])
        self._new()

    def _excluded(self, tag: str, values: dict) -> bool:
        if tag in NEVER:
            return True
        if tag == "header":
            return self.open.innermost({"article", "main"}) < 0
        if "hidden" in values or (values.get("aria-hidden") or "").lower() == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", values.get("style") or "", re.I))

    def _end(self, tags: set[str], beyond: set[str]) -> None:
        """Ends the innermost open element of ``tags`` and all inside it, unless one of ``beyond`` lies between."""
        place = self.open.innermost(tags)
        if place < 0 or self.open.innermost(beyond) > place:
            return
        outer = self.open.elements[place - 1] if place else ("", 0, False, 0)
        if self._inner()[2]:
            self._new()
        elif self._inner()[3] != outer[3]:
            self.flush()
        self.open.cut(place)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
            self.block = tag
            if tag in ENDS_P:
                self._end({"p"}, P_SCOPE)
            if tag in IMPLIED:
                self._end(*IMPLIED[tag])
        else:
            self.tags += 1
        if tag == "a":
            self.links += 1
            self.tags += 1
        if tag in VOID:
            return
        _, number, excluded, name = self._inner()
        sure = 0
        if not excluded:
            values = dict(attrs)
            excluded = self._excluded(tag, values)
            if not excluded and tag not in NAMELESS:
                names = REMARKS if tag == "article" else NAMES
                sure = max(_named(values.get(k) or "", names) for k in ("class", "id", "role"))
            if (excluded or sure) and tag not in BLOCKS:
                self.flush()
        if tag in CONTAINERS:
            self.parents.append(number)
            self.kinds.append(tag)
            number = len(self.parents) - 1
        if sure:
            self.names.append((name, number if tag in CONTAINERS else 0, sure))
            name = len(self.names) - 1
        self.open.push((tag, number, excluded, name))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.block = ""
        if tag == "a" and self.links:
            self.links -= 1
        self._end({tag}, set() if tag in CONTAINERS else ENDS.get(tag, CONTAINERS))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self._inner()[2]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    radius = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[low - i + radius : high - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of ``values`` (2-means on one axis); with no spread, below all."""
    low, high = min(values), max(values)
    if high <= low * 1.5 + 1e-9:
        return low
    for _ in range(50):
        border = (low + high) / 2
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _last_inside(parents: list[int]) -> list[int]:
    """Per number the last one inside it; what lies inside n are the numbers from n to that."""
    last = list(range(len(parents)))
    for n in range(len(parents) - 1, 0, -1):
        last[parents[n]] = max(last[parents[n]], last[n])
    return last


def _summed(own: list[int], parents: list[int]) -> list[int]:
    """Own weights with those of everything inside."""
    total = list(own)
    for n in range(len(parents) - 1, 0, -1):
        total[parents[n]] += total[n]
    return total


def _doubtful(parser: _Lines) -> list[bool]:
    """Whether each line lies in an element whose name counts."""
    lines, around = parser.lines, [n[0] for n in parser.names]
    if len(around) == 1:
        return [False] * len(lines)
    weights = [max(0, len(line[0]) - line[2]) for line in lines]
    last = _last_inside(parser.parents)

    own = [0] * len(parser.parents)
    for line, weight in zip(lines, weights):
        if not line[5]:
            own[line[3]] += weight
    plain = _summed(own, parser.parents)
    part = 0
    for tag in ("article", "main"):
        largest = max((n for n, kind in enumerate(parser.kinds) if kind == tag), key=lambda n: (plain[n], -n), default=0)
        if largest and plain[largest] and plain[largest] >= MAIN_SHARE * sum(weights):
            part = largest
            break
    heading = -1 if parser.first_heading is None else lines[parser.first_heading][5]
    holds_heading = set()
    while heading > 0:
        holds_heading.add(heading)
        heading = around[heading]

    counts = [False] * len(around)
    for n, (_, container, _) in enumerate(parser.names):
        counts[n] = n > 0 and not (container and container <= part <= last[container]) and n not in holds_heading
    own, there = [0] * len(around), [0] * len(around)
    for line, weight in zip(lines, weights):
        own[line[5]] += weight
        there[line[5]] += 1
    text, held = _summed(own, around), _summed(there, around)
    inside, outermost, inner = [False] * len(around), [], [[] for _ in around]
    for n in range(1, len(around)):
        if counts[n] and held[n]:
            inner[around[n]].append(n)
            if not inside[around[n]]:
                outermost.append(n)
        inside[n] = counts[n] or inside[around[n]]
    if not all(inside[line[5]] for line in lines):
        return [inside[line[5]] for line in lines]
    # All is in doubt: names are trusted from the outermost inwards, until a line is.
    trusted = min(outermost, key=lambda n: (parser.names[n][2], -text[n], n))
    counts[trusted] = False
    while not there[trusted] and inner[trusted]:
        trusted = min(inner[trusted], key=lambda n: (parser.names[n][2], -text[n], n))
        counts[trusted] = False
    for n in range(1, len(around)):
        inside[n] = counts[n] or inside[around[n]]
    return [inside[line[5]] for line in lines]


def _menus(lines: list[list]) -> set[int]:
    """Numbers of the lines in runs of two or more list items that hold nothing but links."""
    found: set[int] = set()
    run: list[int] = []
    for i, (text, _, linked, _, block, _) in enumerate([*lines, ["", 0, 0, 0, "", 0]]):
        if block == "li" and linked >= 0.9 * len(text):
            run.append(i)
        else:
            if len(run) > 1:
                found.update(run)
            run = []
    return found


def main_text(html: str | None) -> str:
    """Main text of one page; empty for NULL, for an empty page and for a page without text."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"</?[A-Za-z]|<!|</$", html[cut:]):
        html = html[:cut]  # the page breaks off inside a tag
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""

    parents, kinds, last = parser.parents, parser.kinds, _last_inside(parser.parents)
    doubts = _doubtful(parser)
    menus: set[int] = set()
    for doubt in (False, True):
        numbers = [i for i, d in enumerate(doubts) if d == doubt]
        menus.update(numbers[i] for i in _menus([parser.lines[i] for i in numbers]))
    rest = [i for i in range(len(doubts)) if i not in menus]
    lines, doubts = ([x[i] for i in rest] for x in (parser.lines, doubts))
    if not lines:
        return ""
    plain = [len(text) / (1 + tags) for text, tags, *_ in lines]
    ratios = [DOUBT * r for r in smoothed(plain)] if any(doubts) else []
    sure = [i for i, d in enumerate(doubts) if not d]
    if not sure:
        sure, doubts = list(range(len(lines))), [False] * len(lines)
    trusted = dict(zip(sure, smoothed([plain[i] for i in sure])))
    border = threshold(list(trusted.values()))
    content = [(ratios[i] if d else trusted[i]) >= border for i, d in enumerate(doubts)]

    own = [0] * len(parents)
    for line, chosen, doubt in zip(lines, content, doubts):
        if chosen and not doubt:
            own[line[3]] += len(line[0])
    weight = _summed(own, parents)
    best = [0] * len(parents)
    for n in range(len(parents) - 1, 0, -1):
        outer = parents[n]
        if not best[outer] or weight[n] >= weight[best[outer]]:
            best[outer] = n
    region = 0
    while kinds[region] != "article" and best[region]:
        inner = best[region]
        if weight[inner] < (0.5 if kinds[inner] in ("article", "main", "body", "html") else 0.9) * max(weight[region], 1):
            break
        region = inner
    whole = kinds[region] in ("article", "main")
    few_links = region != 0 and kinds[region] not in ("html", "body")
    kept = [
        line[0] for line, chosen, doubt in zip(lines, content, doubts)
        if region <= line[3] <= last[region] and (chosen or not doubt and (
            whole or few_links and line[2] < 0.5 * len(line[0])))
    ]
    return " ".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, ``text`` (never NULL) and ``n_chars`` (its code points).

    NULL html gives an empty text; NULL keys, NULL urls and repeated rows are kept as they are. Other columns
    are not read, so their names cannot clash. Nothing is cut off: long pages are parsed whole.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    out = pages.select(F.col(key).alias(key), F.col(url).alias(url), texts(F.coalesce(html, F.lit(""))).alias("text"))
    return out.select(key, url, "text", F.length("text").cast("long").alias("n_chars"))
