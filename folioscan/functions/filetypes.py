"""File types from bytes and headers, and validity by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan import fixed_values as fixed
from folioscan.functions.text import literal_map, strip
from folioscan.functions.urls import suffix

_END_RECORD = "PK\x05\x06"  # start of the end-of-directory record
_END_RECORD_BYTES = 22
_TAIL_BYTES = (1 << 16) + _END_RECORD_BYTES  # the record may be followed by a comment of 64 KiB


def _magic(content: Column, position: int, unknown: str) -> Column:
    head = F.substring(content, 1, 8)
    chain = F
    for row in fixed.MAGIC_BYTES:
        chain = chain.when(F.startswith(head, F.lit(row[0])), F.lit(row[position]))
    return chain.otherwise(F.lit(unknown))


def magic_extension(content: Column) -> Column:
    return _magic(content, 1, fixed.UNKNOWN_EXTENSION)


def magic_mime(content: Column) -> Column:
    return _magic(content, 2, fixed.UNKNOWN_MIME)


def main_type(content_type: Column) -> Column:
    """A Content-Type header without its parameters."""
    return F.lower(strip(F.substring_index(content_type, ";", 1)))


def content_type_extension(content_type: Column) -> Column:
    """Extension of a Content-Type header, null when unmapped or generic."""
    return F.try_element_at(literal_map(fixed.CONTENT_TYPES), main_type(content_type))


def extensions_from_table(responses: DataFrame, types: DataFrame) -> DataFrame:
    """Responses with ``header_extension`` by a table ``content_type, extension`` of one's own.

    Types are compared as headers are; of several rows for a type the first
    extension counts. Types that are not in the table are null.
    """
    known = types.groupBy(main_type(F.col("content_type")).alias("main_type")).agg(F.min("extension").alias("header_extension"))
    return responses.withColumn("main_type", main_type(F.col("content_type"))).join(known, "main_type", "left").drop("main_type")


def detected_extension(content_type: Column, content: Column) -> Column:
    return F.coalesce(content_type_extension(content_type), magic_extension(content))


def renamed(path: Column, extension: Column) -> Column:
    """The path with its last suffix replaced by the detected extension, if they differ."""
    other = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), extension)
    return F.when(F.lower(suffix(path)) == extension, path).otherwise(other)


def is_zip(content: Column) -> Column:
    """Whether an end-of-directory record is found where an archive has it."""
    end = F.substring(content, -_END_RECORD_BYTES, _END_RECORD_BYTES)
    at_end = F.startswith(end, F.lit(_END_RECORD.encode())) & (F.substring(end, -2, 2) == F.lit(b"\x00\x00"))
    # one character per byte, so that the text after the last record can be measured
    tail = F.decode(F.substring(content, -_TAIL_BYTES, _TAIL_BYTES), "ISO-8859-1")
    rest = F.length(F.substring_index(tail, _END_RECORD, -1))
    inside = tail.contains(_END_RECORD) & (rest >= _END_RECORD_BYTES - len(_END_RECORD))
    return (F.length(content) >= _END_RECORD_BYTES) & (at_end | inside)


def is_valid(extension: Column, content: Column, size: Column | None = None) -> Column:
    """Verdict on a landed file, by its lower-case extension."""
    size = F.length(content) if size is None else size
    return (
        F.when(size < fixed.MIN_FILE_BYTES, F.lit(False))
        .when(extension == ".pdf", (size >= fixed.MIN_PDF_BYTES) & F.startswith(F.substring(content, 1, 4), F.lit(b"%PDF")))
        .when(extension.isin(".zip", ".docx", ".odt"), is_zip(content))
        .when(extension == ".doc", size > fixed.MIN_DOC_BYTES)
        .when(extension == fixed.UNKNOWN_EXTENSION, size > fixed.MIN_FILE_BYTES)
        .otherwise(F.lit(True))
    )
