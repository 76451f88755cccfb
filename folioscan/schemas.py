"""Schemas of the tables that flow between the operators."""

from __future__ import annotations

from pyspark.sql import types as T

from folioscan import fixed_values as fixed

LANDED_PAGES = "page_no bigint, url string, html string"
LABELS = ("session_txt", "discipline_txt", "serie_txt", "localisation_txt")
LINK = T.StructType([T.StructField(name, T.StringType()) for name in ("href", "entry_name", "link_name")])
ROW = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in LABELS],
        T.StructField("links", T.ArrayType(LINK)),
    ]
)
RESPONSES = "url string, attempt_no int, attempt_ts timestamp_ntz, content_type string, content binary, error string"
ARCHIVE_MEMBERS = "archive_path string, member string, size bigint, content binary, error string"

DOMAINS = {
    "session": fixed.SESSION_KINDS,
    "discipline": fixed.DISCIPLINES,
    "serie": fixed.SERIES,
    "localisation": fixed.LOCATIONS,
}
