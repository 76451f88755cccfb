"""Tolerant HTML reading on the standard library parser, for what has no column form.

A small per-page helper: the class around a pager link whose parent is not the tag
before it, and the SQL table function ``html_rows``. Listing rows do not need it; tests
hold them against it. The table function reads pages of plain tags by one pattern; a page with
anything that the pattern does not know goes to the standard library's parser as a whole.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

from folioscan import fixed_values as fixed, schemas
from folioscan.functions.markup import MIN_CELLS

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CELLS = ("td", "th")
_SECTIONS = ("tbody", "thead", "tfoot")
# A start tag closes these open elements, searched up to the nearest table.
_CLOSES = {"td": _CELLS, "th": _CELLS, "tr": ("tr",), **{s: _SECTIONS for s in _SECTIONS}}
_ACTIVE = frozenset((*_CLOSES, "a"))  # their start tags do more than open an element

# Markup that is read in one way whatever stands around it, and the text behind it; anything else is a '<' alone.
_S = r"[ \t\n\r\f]"
_NAME = r"[a-zA-Z][-a-zA-Z0-9_:]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`/]++)"""
_ATTRIBUTES = rf"(?:{_S}++{_NAME}(?:{_S}*+={_S}*+{_VALUE})?+)*+"
_RAW_TEXT = "script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext"
_PLAIN = re.compile(
    rf"(?:<(?:(?!(?i:{_RAW_TEXT})[\s/>])({_NAME})({_ATTRIBUTES}){_S}*+(/?)>|/({_NAME}){_S}*+>"
    rf"|!--[^->][^-]*+-->|!\[(?!CDATA)[^>]*+>|!(?i:doctype)[^>]*+>"
    rf"|((?i:script|style)){_ATTRIBUTES}{_S}*+>(?:[^<]++|<(?![/!]))*+</(?i:\5){_S}*+>)|(<))([^<]*+)"
)
_ATTRIBUTE = re.compile(rf"{_S}++({_NAME})(?:{_S}*+={_S}*+({_VALUE}))?+")


def _barrier(tag: str) -> tuple[str, ...]:
    """Open elements that an end tag does not reach past."""
    return () if tag == "table" else ("table",) if tag in _CLOSES else ("table", *_CELLS)


def _link(values: dict) -> dict:
    return {
        "href": values["href"],
        "entry_name": values.get(fixed.ENTRY_NAME_ATTRIBUTE, ""),
        "link_name": values.get(fixed.LINK_NAME_ATTRIBUTE, ""),
    }


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object, dict]] = []  # tag, collected item, attributes
        self.rows: list[list[dict]] = []
        self.body_seen = False
        self.pager: list[tuple[bool, dict, dict]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Any marked section ends at the next '>', whatever its keyword."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data: str) -> None:
        """Declarations hold no text."""

    # open elements
    def _inside(self, name: str) -> list:
        """Items of the open elements of that name; only the first table body has any."""
        return [item for tag, item, _ in self.open if tag == name and item is not None]

    def _close(self, names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in names:
                del self.open[i:]
                return
            if tag in barrier:
                return

    def handle_starttag(self, tag: str, attributes) -> None:
        values: dict = {}
        for name, value in attributes:
            values.setdefault(name, value or "")
        if tag in _CLOSES:
            self._close(_CLOSES[tag], ("table",))
        item = None
        if tag == "tbody" and not self.body_seen:
            self.body_seen, item = True, "first"
        elif tag == "tr" and self._inside("tbody"):
            item = []
            self.rows.append(item)
        elif tag == "td" and self._inside("tr"):
            item = {"texts": [], "links": []}
            for row in self._inside("tr"):
                row.append(item)
        elif tag == "a":
            self._anchor(values)
        if tag not in _VOID:
            self.open.append((tag, item, values))

    def _anchor(self, values: dict) -> None:
        if "href" in values:
            link = _link(values)
            for cell in self._inside("td"):
                cell["links"].append(link)
        parent = self.open[-1][2] if self.open else {}
        self.pager.append((values.get("rel") == "next", values, parent))

    def handle_endtag(self, tag: str) -> None:
        self._close((tag,), _barrier(tag))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        for cell in self._inside("td"):
            cell["texts"].append(data.strip())


class _PlainPage:
    """The rows of ``_Page``, for pages of markup that ``_PLAIN`` knows."""

    def __init__(self) -> None:
        self.open: list[tuple[str, list | None]] = []  # tag, open items of its kind if it has one
        self.rows: list[list[dict]] = []
        self.body_seen = False
        self.inside: dict[str, list] = {"tbody": [], "tr": [], "td": []}

    def _close(self, names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in names:
                while len(self.open) > i:
                    items = self.open.pop()[1]
                    if items is not None:
                        items.pop()
                return
            if tag in barrier:
                return

    def _start(self, tag: str, attributes: str) -> None:
        items = None
        if tag in _CLOSES:
            self._close(_CLOSES[tag], ("table",))
            if tag == "td" and self.inside["tr"]:
                items = self.inside["td"]
                items.append({"texts": [], "links": []})
                for row in self.inside["tr"]:
                    row.append(items[-1])
            elif tag == "tr" and self.inside["tbody"]:
                items = self.inside["tr"]
                items.append([])
                self.rows.append(items[-1])
            elif tag == "tbody" and not self.body_seen:
                self.body_seen, items = True, self.inside["tbody"]
                items.append("first")
        elif self.inside["td"]:
            self._anchor(attributes)
        self.open.append((tag, items))

    def _anchor(self, attributes: str) -> None:
        values: dict = {}
        for name, value in _ATTRIBUTE.findall(attributes):
            inner = value[1:-1] if value[:1] in ("'", '"') else value
            values.setdefault(name.lower(), unescape(inner) if "&" in inner else inner)
        if "href" in values:
            link = _link(values)
            for cell in self.inside["td"]:
                cell["links"].append(link)

    def read(self, html: str) -> bool:
        """Whether all markup of the page is known; if not, nothing of it counts."""
        open_, cells = self.open, self.inside["td"]
        for start, attributes, empty, end, _, other, text in _PLAIN.findall(html):
            if start:
                tag = start.lower()
                if tag in _ACTIVE:
                    self._start(tag, attributes)
                elif tag not in _VOID:
                    open_.append((tag, None))
                if empty:
                    self._close((tag,), _barrier(tag))
            elif end:
                tag = end.lower()
                if open_ and open_[-1][0] == tag:
                    items = open_.pop()[1]
                    if items is not None:
                        items.pop()
                else:
                    self._close((tag,), _barrier(tag))
            elif other:
                return False
            if cells and text:
                stripped = (unescape(text) if "&" in text else text).strip()
                for cell in cells if stripped else ():
                    cell["texts"].append(stripped)
        return True


def _read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def _rows(page: _Page) -> list[dict]:
    found = []
    for number, cells in enumerate(page.rows, start=1):
        if len(cells) >= MIN_CELLS:
            texts = ["".join(cell["texts"]) for cell in cells[:4]]
            found.append({"row_no": number, **dict(zip(schemas.LABELS, texts)), "links": cells[4]["links"]})
    return found


def rows_of(html: str) -> list[dict]:
    """Rows of the first table body with at least five cells."""
    page = _PlainPage()
    return _rows(page if page.read(html) else _read(html))


def pager_parent_class_of(html: str) -> str:
    """Class of the element around the next-page link."""
    links = _read(html).pager
    chosen = [x for x in links if x[0]] or [x for x in links if "page suivante" in x[1].get("title", "")]
    return chosen[0][2].get("class", "") if chosen else ""


def _alone(read, page: str | None) -> tuple[str | None, str | None]:
    """Result and error for one page; a page that cannot be read takes no other with it."""
    if page is None:
        return None, None
    try:
        return read(page), None
    except Exception as problem:  # noqa: BLE001
        return None, f"{type(problem).__name__}: {problem}"


@F.pandas_udf(T.StringType())
def pager_parent_class(html: pd.Series) -> pd.Series:
    return html.map(lambda page: _alone(pager_parent_class_of, page)[0])


_FIELDS = ("row_no", *schemas.LABELS)


@F.udtf(returnType=schemas.ROW)
class HtmlRows:
    """``SELECT … FROM pages, LATERAL html_rows(html)``"""

    def eval(self, html: str):
        for row in _alone(rows_of, html)[0] or ():
            yield *(row[name] for name in _FIELDS), [tuple(link.values()) for link in row["links"]]
