"""Metadata derived from link names and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscan import fixed_values as fixed
from folioscan.functions.text import blank_to_null, bounded, contains_any, contains_word, first_match, percent_decode
from folioscan.functions.urls import name_in_url

_YEAR_LEAD = r"^\p{Nd}{2}"
_YEAR_WORD = bounded(r"20[0-2]\p{Nd}", length=4)


def link_name(url: Column, name_attribute: Column) -> Column:
    """File name of a link: first part of the name attribute, else from the URL.

    An attribute such as ``|123`` gives an empty name, which is kept.
    """
    return F.when(blank_to_null(name_attribute).isNull(), name_in_url(url)).otherwise(
        F.substring_index(name_attribute, "|", 1)
    )


def link_file_id(name_attribute: Column) -> Column:
    return F.get(F.split(blank_to_null(name_attribute), r"\|", -1), 1)


def search_text(url: Column, name: Column) -> Column:
    """Lower-case text in which the word rules look."""
    return F.lower(F.concat(percent_decode(url), F.lit(" "), percent_decode(F.coalesce(name, F.lit("")))))


def file_year(name: Column) -> Column:
    """Year from two leading digits of the file name."""
    return F.concat(F.lit("20"), first_match(name, _YEAR_LEAD))


def year(url: Column, name: Column) -> Column:
    decoded = percent_decode(F.coalesce(name, F.lit("")))
    return F.coalesce(file_year(decoded), first_match(search_text(url, name), _YEAR_WORD))


def subject_in_text(text: Column, words: tuple[tuple[str, str], ...] = fixed.SUBJECT_WORDS) -> Column:
    chain = F
    for word, subject in words:
        chain = chain.when(contains_word(text, (word,)), F.lit(subject))
    return subject_forms(text, chain)


def subject_forms(text: Column, chain=F) -> Column:
    """Combined spellings, tried after the single words."""
    for part, form, subject in fixed.SUBJECT_FORMS:
        chain = chain.when(text.contains(part) & text.rlike(bounded(form)), F.lit(subject))
    return chain.otherwise(F.lit(None).cast("string"))


def session_in_text(text: Column) -> Column:
    chain = F
    for word in fixed.SESSION_WORDS:
        chain = chain.when(contains_word(text, (word,)), F.lit(word))
    return chain.otherwise(F.lit(None).cast("string"))


def series_in_text(text: Column) -> Column:
    return F.when(contains_word(text, fixed.PRO_SERIES_WORDS), F.lit("professionnelle")).otherwise(F.lit("generale"))


def correction_in_text(text: Column) -> Column:
    """Whether a correction word occurs anywhere, also inside other words."""
    return contains_any(text, fixed.CORRECTION_PARTS)


def document_type(is_correction: Column) -> Column:
    return F.when(is_correction, F.lit("correction")).otherwise(F.lit("sujet"))


FIELDS = ("filename", "file_id", "year", "subject", "session", "series", "is_correction", "document_type")


def with_parsed(df: DataFrame, url: Column, name_attribute: Column, prefix: str = "") -> DataFrame:
    """Add all metadata of one link as columns.

    Name and search text are columns of their own in between, so each is
    computed once and the generated code stays small.
    """
    df = df.withColumns({"_attribute": name_attribute, "_name": link_name(url, name_attribute)})
    df = df.withColumns({"_decoded": percent_decode(F.col("_name")), "_text": search_text(url, F.col("_name"))})
    df = df.withColumn("_correction", correction_in_text(F.col("_text")))
    text = F.col("_text")
    fields = (
        F.col("_name"),
        link_file_id(F.col("_attribute")),
        F.coalesce(file_year(F.col("_decoded")), first_match(text, _YEAR_WORD)),
        subject_in_text(text),
        session_in_text(text),
        series_in_text(text),
        F.col("_correction"),
        document_type(F.col("_correction")),
    )
    df = df.withColumns({prefix + field: column for field, column in zip(FIELDS, fields)})
    return df.drop("_attribute", "_name", "_decoded", "_text", "_correction")


def organized_name(
    filename: Column, year: Column, subject: Column, session: Column, series: Column, document_type: Column, file_id: Column
) -> Column:
    """The file name if there is one, else a name built from the metadata parts."""
    parts = (year, F.translate(subject, " /", "__"), session, series)
    built = F.concat(
        F.concat_ws("_", *[blank_to_null(p) for p in parts], document_type, blank_to_null(file_id)), F.lit(".pdf")
    )
    return F.coalesce(blank_to_null(filename), F.translate(built, "éèàô", "eeao"))


def target_path(year: Column, subject: Column, name: Column, by_year: bool = True, by_subject: bool = True) -> Column:
    """Relative path ``[year]/[subject]/name``; missing levels are left out."""
    levels = ([blank_to_null(year)] if by_year else []) + ([blank_to_null(subject)] if by_subject else [])
    return F.concat_ws("/", *levels, name)


def save_name(
    entry_id: Column, session: Column, discipline: Column, serie: Column, location: Column, file_id: Column
) -> Column:
    return F.concat_ws("_", entry_id, session, discipline, serie, location, file_id)


def format_bytes(size: Column) -> Column:
    """Size with two decimals and a unit, 1024 steps; ties round to even."""
    def shown(power: int) -> Column:
        value = F.bround(size.cast("double") / F.lit(float(1024**power)), 2)
        return F.format_string(f"%.2f {fixed.BYTE_UNITS[power]}", value)

    last = len(fixed.BYTE_UNITS) - 1
    return reduce(
        lambda rest, power: F.when(size < F.lit(1024 ** (power + 1)), shown(power)).otherwise(rest),
        range(last - 1, -1, -1),
        shown(last),
    )
