"""Main text of web pages by the distribution of text over lines.

1. Markup is stripped: each block of a page becomes a line, character references are
   decoded, white space becomes one space. Scripts, styles, templates, comments and what is
   hidden give nothing.
2. A line counts with its characters outside links, times a weight. The weight starts at
   1, is doubled inside article and main elements, and falls to as little as 1/64 inside
   elements whose kind, role, class or id speaks of menus, page headers, footers, sidebars,
   notices, adverts, forms or reader comments. Of a class or id it is the share of such words
   that counts: ``related-work`` lowers the weight less than ``related``. Weights multiply
   from the outside to the inside. No name settles anything alone: what counts is the weight
   beside that of the densest text.
3. Weighted lengths are summed over windows of ``window`` lines. Text surges where a
   window's sum becomes positive and dives where it is zero again. Stretches between surge
   and dive are kept if one of their windows has ``least`` characters; if none has, the
   densest is kept.
4. The home of a stretch is the innermost container with two thirds of its weighted text, or
   the article or main element around that. Lines at home stay, with the link-only lines
   before, between and behind them (reference lists, links to a full report), and thinner
   stretches; so do the lines right before it in the containers around it (titles). Text of other containers in
   the stretch stays if a window of its own lines has ``least`` characters; beside an article
   it takes a quarter of the article's densest window. Lines with less than a quarter of the
   weight of the densest line go. Of several articles those with a quarter of the largest
   one's text stay.

The text is whole, in page order, joined by an empty line. Limits: notices and other
short text that nothing marks stay if they are in the same container as the text, or have
``least`` characters within ``window`` lines.

Rules: null and empty pages, and pages without text, give an empty string; so does text that
is all links. A tag may hold ``>`` in quoted values of any length; a quote that is never closed
does not count, and a tag that is never closed is text. Every page is handled alone, with no
limit on its length; repeated pages give equal texts; an empty table gives an empty table;
other columns stay out of the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import ship_package

WINDOW, LEAST = 3, 200
LOWEST = 64

# fixed values: names of HTML elements and the words that sites use in classes and ids
_SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "select", "option", "button"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CONTAINERS = set(
    "html body div section article main nav header footer aside form fieldset ul ol dl menu table thead tbody tfoot figure details dialog center".split()
)
_PARTS = set("ul ol dl table thead tbody tfoot figure details center".split())  # belong to the container around them
_NEVER = {"nav", "footer", "aside", "form", "fieldset", "menu", "dialog", "head"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted menu nav navbar navigation"
    " breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert infobar popup modal newsletter subscribe subscription"
    " signup social share sharing related recommended recommendations comment comments commentlist discussion discussions thread disqus respond reply"
    " replies feedback widget widgets toolbar pagination pager search login masthead topbar copyright disclaimer legal imprint terms privacy skip teaser"
    " outbrain taboola header".split()
)
# say where or how something stands, not what it is
_FRAME = set(
    "list lists box block wrap wrap wrapper container section area item items site page top bottom left right inner outer bar row col column grid"
    " links link group panel module component region zone slot view list link text info the and of for to a b js is".split()
)
_STRONG = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "sponsored", "teaser", "reply"}
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>\"']*)([^>]*)>")
_QUOTE_OR_END = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKS = {"class", "id", "role", "hidden", "style", "aria-hidden"}
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


def _weight(tag: str, attributes: str) -> tuple[float, bool]:
    """How an element shifts the weight of its text (0: it cannot be seen), and whether it is a header."""
    weight = 1 / LOWEST if tag in _NEVER else 1.0
    header = tag == "header"
    if not attributes or not attributes.strip():
        return weight, header
    names: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key not in _MARKS:
            continue
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" and tag != "a":
            return 0.0, header
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 0.0, header
        elif key == "role":
            if value.lower() in _ROLES:
                weight = 1 / LOWEST
        else:
            for part in value.split():
                names.update(x.lower() for x in _NAME.findall(part))
    if tag in ("html", "body", "main") or names & {"has", "with"}:
        return weight, header
    found = names & (_STRONG if tag == "article" else _WORDS)
    if found == {"header"}:
        return weight, True
    if not found:
        return weight, header
    others = {name for name in names - _WORDS - _FRAME if len(name) > 1 and not name.isdigit()}
    return min(weight, LOWEST ** (-len(found) / (len(found) + len(others)))), header


def _tag_end(html: str, at: int, open_ended: set[int]) -> int:
    """Place of the ``>`` after a tag's quoted values, or -1 if the page ends first.

    A quote opens a value only after ``=``. open_ended: quotes known to lead to the end of
    the page, so that all tags of a page together take one pass.
    """
    seen = []
    while found := _QUOTE_OR_END.search(html, at):
        place = found.start()
        if html[place] == ">":
            return place
        before = place - 1
        while html[before].isspace():
            before -= 1
        if html[before] != "=":
            at = place + 1
            continue
        if place in open_ended:
            break
        seen.append(place)
        at = html.find(html[place], place + 1) + 1
        if not at:
            break
    open_ended.update(seen)
    return -1


class Place:
    """A container below the body, and the one around it."""

    __slots__ = ("around", "depth", "article")

    def __init__(self, around: Place | None, article: bool) -> None:
        self.around, self.depth = around, around.depth + 1 if around else 1
        # the outermost article or main element that it is, or is in
        self.article: Place | None = around.article if around and around.article else self if article else None

    def holds(self, place: Place | None) -> bool:
        while place and place.depth > self.depth:
            place = place.around
        return place is self


class Line(NamedTuple):
    text: str
    own: int  # characters outside links
    weight: float
    place: Place | None


def lines_of(html: str) -> list[Line]:
    """All blocks of a page that have text."""
    lines: list[Line] = []
    stack: list[tuple[str, float, bool, Place | None]] = []  # name, weight, inside a header, container
    pieces: list[str] = []
    linked: list[bool] = []
    link = heading = False
    block = 1.0

    def close() -> None:
        nonlocal block, heading
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = " ".join("".join(p for p, a in zip(pieces, linked) if not a).split())
                _, weight, header, place = stack[-1] if stack else ("", 1.0, False, None)
                inside = place is not None and place.article is not None
                weight *= block * (2 if inside else 1) * (1 / LOWEST if header and not (inside and heading) else 1)
                if weight:
                    lines.append(Line(text, len(own), weight, place))
            pieces.clear()
            linked.clear()
        block, heading = 1.0, False

    def text(value: str) -> None:
        if value:
            pieces.append(unescape(value))
            linked.append(link)

    open_ended: set[int] = set()
    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        if start > at:
            text(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = size if end < 0 else end + 1
            continue
        found = _PLAIN_TAG.match(html, start)
        if not found:
            text("<")
            at = start + 1
            continue
        at, closing, name, attributes = found.end(), bool(found[1]), found[2].lower(), found[3]
        double, single = attributes.count('"'), attributes.count("'")
        if double % 2 or single % 2 or double and single:
            end = _tag_end(html, found.end(2), open_ended)
            if end >= at:
                at, attributes = end + 1, html[found.end(2) : end]
        if name in _SILENT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name == "a":
            link = not closing
            continue
        if name in ("br", "td", "th", "img", "wbr"):
            text("" if name == "wbr" else " ")
            continue
        if name in _INLINE:
            continue
        close()
        link = False if name in _CONTAINERS else link
        if name in _VOID:
            continue
        if name in _CONTAINERS or name == "head":
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
            else:
                _, weight, header, place = stack[-1] if stack else ("", 1.0, False, None)
                own, own_header = _weight(name, attributes)
                article = name in ("article", "main") and weight * own == 1
                place = place if name in _PARTS or name in ("html", "head", "body") else Place(place, article)
                stack.append((name, weight * own, header or own_header, place))
        elif not closing:
            block = _weight(name, attributes)[0]
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return lines


def _densest(lengths: list[float], window: int) -> float:
    """The largest sum of a window."""
    return max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0.0)


def _stretches(lengths: list[float], window: int) -> list[tuple[int, int, float]]:
    """From surge to dive: first line, line after the last, largest window."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    found = []
    at = 0
    while at < n:
        if not sums[at]:
            at += 1
            continue
        end = at
        while end < n and sums[end]:
            end += 1
        found.append((at, end, max(sums[at:end])))
        at = end
    return found


def _home(lines: list[Line], lengths: list[float]) -> Place | None:
    """Innermost container with two thirds of the text, or the article around it; None is the body."""
    held: dict[Place, float] = {}
    for line, length in zip(lines, lengths):
        if line.place:
            held[line.place] = held.get(line.place, 0.0) + length
    waiting: dict[int, list[Place]] = {}
    for place in held:
        waiting.setdefault(place.depth, []).append(place)
    need = 2 * sum(lengths) / 3
    for depth in range(max(waiting, default=0), 0, -1):
        for place in waiting.get(depth, ()):
            if held[place] >= need:
                return place.article or place
            around = place.around
            if around:
                if around not in held:
                    held[around] = 0.0
                    waiting.setdefault(around.depth, []).append(around)
                held[around] += held[place]
    return None


def _kept(lines: list[Line], lengths: list[float], first: int, end: int, window: int, least: float) -> tuple[list[int], Place | None]:
    """Lines that a stretch brings: its own, and link-only ones of its home; and that home."""
    inside = range(first, end)
    densest = max(inside, key=lambda i: lengths[i])
    level = lines[densest].weight / 4
    home = _home(lines[first:end], lengths[first:end])
    at_home = lambda i: home is None and lines[i].place is None or home is not None and home.holds(lines[i].place)
    own: dict[Place | None, list[float]] = {}
    for i in inside:
        own.setdefault(lines[i].place, []).append(lengths[i])
    article = home is not None and home.article is home
    need = max(least, _densest(lengths[first:end], window) / 4) if article else least
    dense = {place for place, some in own.items() if _densest(some, window) >= need} | {lines[densest].place}
    begin = next((i for i in inside if at_home(i)), first)
    found = []
    for i in inside:
        line = lines[i]
        title = home is not None and begin - window <= i < begin and line.own and (line.place is None or line.place.holds(home))
        around = home is not None and line.place is not None and line.place.holds(home)
        if line.weight >= level and (at_home(i) or line.place in dense or title or around):
            found.append(i)
    if home is None:  # link-only lines of the body: behind the stretch only, as menus come before
        at = end
        while at < len(lines) and not lines[at].own:
            found += [at] if at_home(at) and lines[at].weight >= level else []
            at += 1
    return found, home


def _lives(place: Place | None, homes: set[Place], known: dict[Place | None, bool]) -> bool:
    """Whether a container is one of the homes or in one; known: answers so far."""
    passed = []
    while place not in known:
        if place in homes:
            known[place] = True
            break
        passed.append(place)
        place = place.around
    for other in passed:
        known[other] = known[place]
    return known[place]


def main_text(html: str | None, window: int = WINDOW, least: float = LEAST) -> str:
    lines = lines_of(html or "")
    lengths = [line.own * line.weight for line in lines]
    stretches = _stretches(lengths, window)
    if not stretches:
        return ""
    best = max(dense for _, _, dense in stretches)
    found: set[int] = set()
    homes: set[Place] = set()
    for first, end, dense in stretches:
        if dense >= min(least, best):
            some, home = _kept(lines, lengths, first, end, window, least)
            found.update(some)
            homes.update([home] if home else [])
    # links and thinner stretches at home
    known: dict[Place | None, bool] = {None: False}
    found.update(i for i, line in enumerate(lines) if _lives(line.place, homes, known))
    level = max(lines[i].weight for i in found) / 4
    articles: dict[Place | None, float] = {}
    for i in found:
        article = lines[i].place.article if lines[i].place else None
        articles[article] = articles.get(article, 0.0) + lengths[i]
    most = max((size for article, size in articles.items() if article), default=0.0)
    small = {article for article, size in articles.items() if article and 4 * size < most}
    return "\n\n".join(
        line.text for i, line in enumerate(lines)
        if i in found and line.weight >= level and not (line.place and line.place.article in small)
    )


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value) for value in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
