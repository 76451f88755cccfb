"""HTML as column expressions: anchors, table rows, cell text, pager links."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from folioscan.functions.text import let, strip

# Rest of a tag, where '>' may occur inside quoted values.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# Hidden content; without an end it goes on to the end of the page.
_HIDDEN = (
    rf"(?i)<(?=[!s])(?:!--(?:[^-]++|-(?!->))*+(?:-->)?+|(script|style)\b{_IN_TAG}(?:[^<]++|<(?!/\1\s*>))*+(?:</\1\s*>)?+)"
)
_MARK = "<!>"  # left in place of hidden content, so that text around it stays apart
_ANY_TAG = rf"</?[A-Za-z]{_IN_TAG}|<![^>]*>"
_ANCHOR = rf"(?is)<a(?=[\s/>]){_IN_TAG}"
_BODY_START = r"<[Tt][Bb][Oo][Dd][Yy](?=[\s/>])"
_BODY_END = r"</[Tt](?:[Bb][Oo][Dd][Yy]|[Aa][Bb][Ll][Ee])"
_TO_BODY = rf"(?:[^<]++|<(?!{_BODY_START[1:]}))*+{_BODY_START}"
_INNER_TABLE = r"<[Tt](?:[Aa][Bb][Ll][Ee]|[Bb][Oo][Dd][Yy])\b"
_HAS_INNER_TABLE = rf"^{_TO_BODY}(?:[^<]++|<(?!{_INNER_TABLE[1:]}|{_BODY_END[1:]}))*+{_INNER_TABLE}"
_ROW_START = r"<[Tt][Rr](?=[\s/>])"
# From the first body on, or from the row before: a row as it stands behind its start tag, up to its end.
_ROW = (
    rf"(?:\G(?!^)|^{_TO_BODY})(?:[^<]++|<(?!{_ROW_START[1:]}|{_BODY_END[1:]}))*+{_ROW_START}"
    rf"((?:[^<]++|<(?!{_ROW_START[1:]}|/[Tt][Rr]|{_BODY_END[1:]}))*+)"
)
_TO_CELL_END = r"(?:[^<]++|<(?!/?[Tt][DdHh]\b))*+"
_CELL = rf"<[Tt][Dd](?=[\s/>]){_IN_TAG}({_TO_CELL_END})"
# Tags one behind the other, with the white space around them.
_BLANKS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
_TAGS_AND_BLANKS = rf"(?<!{_BLANKS}){_BLANKS}*+(?:<(?:/?[A-Za-z]{_IN_TAG}|![^>]*+>){_BLANKS}*+)++"
# A tag with complete values before one that holds '<'.
_MARKUP_IN_VALUE = r"""<[A-Za-z][^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+(?:"[^"<]*+<|'[^'<]*+<)"""
_ALL = 1 << 30
_REFERENCE_OR_TEXT = "&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]++|&"
_VALUE = r"""("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
# The same without its quotes.
_INNER_VALUE = r"""["']?+((?<=")[^"]*+(?=")|(?<=')[^']*+(?=')|(?<!["'])[^\s"'>]++)"""

# References to these characters stay until the markup around them is gone.
_MARKUP_CHARACTERS = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
_NAMED = {name: _MARKUP_CHARACTERS.get(chr(point), chr(point)) for name, point in name2codepoint.items()}
_NUMBERED = {str(ord(c)): reference for c, reference in _MARKUP_CHARACTERS.items()}

# References that are frequent in French pages, and stand for no markup.
_FREQUENT = ("nbsp", "eacute", "egrave", "ecirc", "agrave", "ccedil", "ocirc", "rsquo")

MIN_CELLS = 5


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(html, _HIDDEN, _MARK)


def _constant_map(pairs: dict[str, str]) -> Column:
    # none of the items holds a line feed
    return F.map_from_arrays(*[F.split(F.lit("\n".join(items)), "\n") for items in (pairs, pairs.values())])


def _character(number: Column) -> Column:
    """Character of a code point; null outside Unicode and for surrogates."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_references(html: Column) -> Column:
    """Resolve character references, except those to markup characters.

    The exceptions get one fixed spelling, for ``plain`` to resolve in the end.
    """
    named, numbered = _constant_map(_NAMED), _constant_map(_NUMBERED)
    # a reference is one wherever it stands, so the frequent ones can go first
    known = html
    for name in _FREQUENT:
        known = F.replace(known, F.lit(f"&{name};"), F.lit(_NAMED[name]))

    def resolved(token: Column) -> Column:
        body = F.regexp_extract(token, "^&#?[xX]?(.*);$", 1)
        number = F.when(token.rlike("^&#[xX]"), F.try_to_number(F.conv(body, 16, 10), F.lit("9" * 20))).otherwise(
            F.try_to_number(body, F.lit("9" * 20))
        ).cast("bigint")
        by_number = F.coalesce(F.try_element_at(numbered, number.cast("string")), _character(number))
        return F.when(
            token.startswith("&") & token.endswith(";"),
            F.coalesce(F.when(token.startswith("&#"), by_number).otherwise(F.try_element_at(named, body)), token),
        ).otherwise(token)

    def all_resolved(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(_REFERENCE_OR_TEXT), F.lit(0))
        return F.when(text.contains("&"), F.array_join(F.transform(tokens, resolved), "")).otherwise(text)

    return F.when(html.contains("&"), let(known, all_resolved)).otherwise(html)


def plain(text: Column) -> Column:
    """Resolve the references that ``decode_references`` left."""
    for character, reference in reversed(_MARKUP_CHARACTERS.items()):
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def raw_attribute(tag: Column, name: str, value: str = _VALUE) -> Column:
    """Value of an attribute as written, with its quotes; '' only when it is absent."""
    others = rf"""(?:[\s/]++(?!{name}[\s=/>])[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+"""
    return F.regexp_extract(tag, rf"(?is)^<[a-z][a-z0-9]*+{others}[\s/]++{name}\s*+=\s*+{value}", 1)


def unquoted(value: Column) -> Column:
    """The value that a raw attribute stands for; one that begins with a quote ends with it."""
    quoted = value.startswith('"') | value.startswith("'")
    inner = F.when(quoted, F.substring(value, F.lit(2), F.char_length(value) - 2)).otherwise(value)
    return F.when(value.contains("&"), plain(inner)).otherwise(inner)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, '' when it is absent."""
    return plain(raw_attribute(tag, name, _INNER_VALUE))


def anchors(html: Column) -> Column:
    """Start tags of all anchors, in document order."""
    return F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))


def cut_cell(content: Column) -> Column:
    """What a cell holds, without what follows its end."""
    return F.regexp_extract(content, f"^{_TO_CELL_END}", 0)


def cells_of(row: Column) -> Column:
    """Contents of the cells of a row, as ``table_rows`` cuts it, each up to its end."""
    return F.regexp_extract_all(row, F.lit(_CELL), F.lit(1))


def cell_text(content: Column) -> Column:
    """Text pieces of a cell, each trimmed, joined without separator."""
    pieces = F.transform(F.split(content, _ANY_TAG, -1), lambda piece: strip(plain(piece)))
    # without references the pieces need not be told apart
    return (
        F.when(~content.contains("<"), strip(plain(content)))
        .when(~content.contains("&"), strip(F.regexp_replace(content, _TAGS_AND_BLANKS, "")))
        .otherwise(F.array_join(pieces, ""))
    )


def table_body(html: Column) -> Column:
    """Content of the first table body, up to its end; null when there is none."""
    return F.get(F.split(F.get(F.split(html, _BODY_START, 2), 1), _BODY_END, 2), 0)


def table_rows(html: Column) -> Column:
    """Rows of the first table body, each from behind its start tag to its end, in one pass.

    A row also ends where the next one starts, which takes omitted end tags as well.
    """
    return F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))


def markup_in_values(html: Column) -> Column:
    """Whether a quoted value of a tag holds markup, in a page as ``visible`` leaves it."""
    return html.rlike(_MARKUP_IN_VALUE)


def has_inner_tables(html: Column) -> Column:
    """Whether the first table body, as ``table_body`` cuts it, has a table or body inside."""
    return html.rlike(_HAS_INNER_TABLE)


def pager_tag(html: Column) -> Column:
    """Start tag of the link to the next page, null when there is none."""
    tags = anchors(html)
    by_rel = F.get(F.filter(tags, lambda tag: attribute(tag, "rel") == "next"), 0)
    by_title = F.get(F.filter(tags, lambda tag: F.contains(attribute(tag, "title"), F.lit("page suivante"))), 0)
    return F.coalesce(by_rel, by_title)


def tag_before(html: Column, tag: Column) -> Column:
    """The tag that directly precedes the given one."""
    before = F.call_function("substring_index", html, tag, F.lit(1))
    return F.regexp_extract(before, r"(?s)(<[^<>]*>)[^<>]*\z", 1)
