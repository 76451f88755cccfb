"""Text helpers shared by all column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# Every character that counts as white space, for btrim.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Unicode word characters, written out so that bounds do not depend on the JDK.
WORD = r"[\p{L}\p{N}_]"

# Inside a character class: white space including the four separator controls.
SPACE = r"(?U:[\s\x1c-\x1f])"


def bounded(pattern: str, length: int | None = None) -> str:
    """The pattern between Unicode word bounds.

    For a pattern of fixed length the bound before it is tested last, so that
    the search runs on the pattern itself.
    """
    if length is None:
        return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"
    return rf"(?s)(?:{pattern})(?!{WORD})(?<!{WORD}.{{{length}}})"


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.contains(part) for part in parts])


def contains_word(text: Column, words: tuple[str, ...]) -> Column:
    """One of the words between word bounds; a byte search spares most regex runs."""
    stems = tuple(w for w in words if not any(w != other and other in w for other in words))
    return contains_any(text, stems) & text.rlike(bounded("|".join(words)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def fold(text: Column) -> Column:
    """Trimmed and lower-cased, as every label rule expects."""
    return F.lower(strip(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of the pattern, null when there is none."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 0)


def percent_decode(text: Column) -> Column:
    """Lenient percent-decoding: '+' and malformed escapes stay as they are."""
    kept_plus = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(kept_plus, "%(?![0-9A-Fa-f]{2})", "%25"))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    The body is evaluated without code generation: for rare branches only.
    """
    return F.get(F.transform(F.array(value), body), 0)
