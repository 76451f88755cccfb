"""URL resolution, file names and extensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscan import fixed_values as fixed
from folioscan.functions.text import SPACE, blank_to_null, first_match, let, percent_decode

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ORIGIN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(url, _SCHEME, "")


def _path(rest: Column) -> Column:
    """Path of a URL without its scheme."""
    return F.regexp_extract(rest, "^(?://[^/?#]*)?([^?#]*)", 1)


def _query(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)


def _fragment(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1)


def _with_mark(mark: str, part: Column) -> Column:
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise(F.lit(""))


def _remove_dots(segments: Column) -> Column:
    """Apply '.' and '..' segments and join the rest into an absolute path."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(closed, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def _resolved(p: Column) -> Column:
    """Resolution of an href that has been taken apart; ``p`` holds the parts."""
    tail = F.concat(_with_mark("?", p["query"]), _with_mark("#", p["fragment"]))
    folder = F.regexp_replace(p["base_path"], "[^/]*$", "")
    joined = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), p["path"]), "/", -1)
    relative = let(
        joined,
        lambda parts: F.concat(
            F.slice(parts, 1, 1),
            F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x != ""),
            F.slice(parts, -1, 1),
        ),
    )
    segments = F.when(p["path"].startswith("/"), F.split(p["path"], "/", -1)).otherwise(relative)
    query = F.when(p["query"] != "", p["query"]).otherwise(p["base_query"])
    return (
        F.when((p["scheme"] != "") & (p["scheme"] != p["base_scheme"]), p["href"])
        .when(p["host"] != "", F.concat(p["base_scheme"], F.lit("://"), p["host"], p["path"], tail))
        .when(
            p["path"] == "",
            F.concat(p["origin"], p["base_path"], _with_mark("?", query), _with_mark("#", p["fragment"])),
        )
        .otherwise(F.concat(p["origin"], let(segments, _remove_dots), tail))
    )


def resolve(base: Column | str, href: Column) -> Column:
    """Absolute URL of ``href`` as seen from ``base`` (an http or https URL).

    Hrefs with a plain absolute path, nearly all of them, only get the origin
    put in front; the full rules are left to the rest.
    """
    base = F.lit(base) if isinstance(base, str) else base
    origin = F.regexp_extract(base, _ORIGIN, 0)
    base_rest = _after_scheme(base)
    clean = F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")
    rest = _after_scheme(clean)
    parts = F.struct(
        href.alias("href"),
        F.lower(F.regexp_extract(clean, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(rest, "^//([^/?#]*)", 1).alias("host"),
        _path(rest).alias("path"),
        _query(rest).alias("query"),
        _fragment(rest).alias("fragment"),
        origin.alias("origin"),
        F.lower(F.regexp_extract(base, _SCHEME, 1)).alias("base_scheme"),
        _path(base_rest).alias("base_path"),
        _query(base_rest).alias("base_query"),
    )
    plain = href.startswith("/") & ~href.startswith("//") & ~href.contains("/.") & ~href.rlike(r"[?#\t\r\n]")
    return (
        F.when(plain, F.concat(origin, href)).when(href == "", base).when(href.isNotNull(), let(parts, _resolved))
    )


def name_in_url(url: Column) -> Column:
    """Text after the last '/', without the query; not decoded."""
    last = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    return F.when(url.contains("/"), last).otherwise(url)


def _last_segment(url: Column) -> Column:
    segment = F.substring_index(_path(_after_scheme(url)), "/", -1)
    return percent_decode(F.substring_index(segment, ";", 1))


def suffix(name: Column) -> Column:
    """Last suffix with its dot, '' when there is none ('.pdf' and 'a.' have none)."""
    last = F.regexp_extract(F.regexp_replace(name, r"(/\.?)+$", ""), "([^/]*)$", 1)
    return F.regexp_extract(last, r"(?s)^[^/]*[^/](\.[^./]+)$", 1)


def file_extension(url: Column, name: Column) -> Column:
    """Extension from the file name, else from the URL path, else .pdf; lower case."""
    return F.lower(
        F.coalesce(
            blank_to_null(suffix(name)),
            blank_to_null(suffix(_last_segment(url))),
            F.lit(fixed.DEFAULT_EXTENSION),
        )
    )


def sanitize(name: Column, max_length: int = fixed.MAX_NAME_LENGTH) -> Column:
    """Name that is safe for a file system, at most ``max_length`` long."""
    replaced = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    single = F.btrim(F.regexp_replace(replaced, f"(?:{SPACE}|_)+", "_"), F.lit("_ "))
    extension = F.substring_index(single, ".", -1)
    stem = F.substring(single, F.lit(1), F.length(single) - F.length(extension) - 1)
    room = F.lit(max_length - 1) - F.length(extension)
    # a negative room cuts from the end, like a slice does
    kept = F.when(room >= 0, F.substring(stem, F.lit(1), room)).otherwise(
        F.substring(stem, F.lit(1), F.greatest(F.length(stem) + room, F.lit(0)))
    )
    cut = F.when(
        single.contains(".") & (extension != ""), F.concat(kept, F.lit("."), extension)
    ).otherwise(F.substring(F.when(single.contains("."), stem).otherwise(single), 1, max_length))
    return F.when(F.length(single) > max_length, cut).otherwise(single)


def safe_name_in_url(url: Column) -> Column:
    """Decoded and sanitised name from the URL path, with a default."""
    name = _last_segment(url)
    return sanitize(F.when(name.contains("."), name).otherwise(F.lit(fixed.DEFAULT_FILE_NAME)))


def is_document_link(href: Column, pattern: str = fixed.DOCUMENT_LINK) -> Column:
    return href.rlike(pattern)


def document_id(href: Column) -> Column:
    return first_match(href, fixed.DOCUMENT_ID, 1)
