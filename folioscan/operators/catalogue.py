"""Listing rows to coded entries and files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscan import schemas
from folioscan.functions import labels, metadata, urls
from folioscan.functions.text import blank_to_null, first_match, fold
from folioscan.operators.extract import listing_rows
from folioscan.operators.numbering import number_rows
from folioscan.session import written

CODES = ("session", "discipline", "serie", "localisation")


def coded_rows(rows: DataFrame, base_url: str, name_field: str = "entry_name") -> DataFrame:
    """Rows with their four codes and their files, one row per file.

    A label that is not known gives a null code. A listing row without a
    document link has one row without file (``file_no`` null). All steps are
    narrow; each works on columns of the step before, so nothing is computed
    twice.
    """
    document = F.filter(F.col("links"), lambda link: urls.is_document_link(link["href"]))
    keyed = rows.select(
        "page_no", "row_no", *schemas.LABELS, document.alias("links"),
        *[fold(F.col(text)).alias(f"{code}_key") for code, text in zip(CODES, schemas.LABELS)],
    )
    keyed = keyed.withColumn("localisation_single", labels.single_blanks(F.col("localisation_key")))
    codes = F.struct(
        labels.session_kind(F.col("session_key"), folded=True).alias("session"),
        labels.discipline(F.col("discipline_key"), folded=True).alias("discipline"),
        labels.serie(F.col("serie_key"), folded=True).alias("serie"),
        labels.location(F.col("localisation_key"), folded=True, single=F.col("localisation_single")).alias("localisation"),
    )
    # as generator output the codes are computed once; a later filter on them is
    # not turned into a second run of the rules below this point
    coded = keyed.select("page_no", "row_no", *schemas.LABELS, "links", F.inline(F.array(codes)))
    flat = coded.select(
        "page_no", "row_no", *schemas.LABELS, *CODES, F.size("links").alias("files_count"),
        F.posexplode_outer("links").alias("at", "link"),
    )
    flat = flat.select(
        "page_no", "row_no", *schemas.LABELS, *CODES, "files_count",
        (F.col("at") + 1).cast("bigint").alias("file_no"),
        F.col("link.href").alias("href"),
        F.col(f"link.{name_field}").alias("name"),
    )
    flat = flat.withColumn("filename", metadata.link_name(F.col("href"), F.col("name")))
    file_id = F.coalesce(urls.document_id(F.col("href")), metadata.link_file_id(F.col("name")), F.lit(""))
    session_year = first_match(F.col("session_txt"), r"^\p{Nd}{4}")
    return flat.select(
        "page_no", "row_no", *schemas.LABELS, *CODES, "files_count", "file_no", "filename",
        urls.resolve(base_url, F.col("href")).alias("download_url"),
        F.when(F.col("file_no").isNotNull(), file_id).alias("file_id"),
        F.coalesce(metadata.year(F.col("href"), F.col("filename")), session_year).alias("year"),
    )


def accepted_files(coded: DataFrame) -> DataFrame:
    """Files of the rows whose four labels are known."""
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*CODES, "file_no")])
    return coded.filter(known).drop(*schemas.LABELS)


def rejected_rows(coded: DataFrame) -> DataFrame:
    """All other rows, with the fields that failed; one row per listing row."""
    failed = F.array_compact(
        F.array(
            *[F.when(F.col(code).isNull(), F.lit(code)) for code in CODES],
            F.when(F.col("file_no").isNull(), F.lit("files")),
        )
    )
    first = coded.filter(F.coalesce(F.col("file_no"), F.lit(1)) == 1)
    return first.select("page_no", "row_no", *schemas.LABELS, failed.alias("failed")).filter(F.size("failed") > 0)


def numbered_files(accepted: DataFrame, start: int = 1) -> DataFrame:
    """Files with the ids of their entries and their save names; rejected rows use up no id."""
    files = number_rows(accepted, F.col("file_no") == 1, "id", start)
    name = metadata.save_name(F.col("id").cast("string"), *[F.col(code) for code in CODES], F.col("file_id"))
    return files.select(
        "id", "file_no", *CODES, "files_count", "filename", "download_url", "file_id", name.alias("filename_for_save"), "year"
    )


def entries_of(files: DataFrame) -> DataFrame:
    """One row per entry."""
    return files.filter(F.col("file_no") == 1).select("id", *CODES, "files_count")


def nested_entries(files: DataFrame) -> DataFrame:
    """One row per entry with its files as an array, in link order."""
    one = F.struct("file_no", "filename", "download_url", "file_id", "filename_for_save", "year")
    return files.groupBy("id", *CODES).agg(F.sort_array(F.collect_list(one)).alias("files"))


@dataclass
class Catalogue:
    """Coded rows, written once; everything else derives from them."""

    rows: DataFrame
    start: int = 1

    @property
    def rejects(self) -> DataFrame:
        return rejected_rows(self.rows)

    @property
    def unnumbered_files(self) -> DataFrame:
        """Files without entry ids, for reports that do not need them: no exchange."""
        return accepted_files(self.rows)

    @property
    def files(self) -> DataFrame:
        return numbered_files(self.unnumbered_files, self.start)

    @property
    def entries(self) -> DataFrame:
        first = self.unnumbered_files.filter(F.col("file_no") == 1)
        return entries_of(numbered_files(first, self.start))


def build_catalogue(pages: DataFrame, base_url: str, start: int = 1) -> Catalogue:
    """Parse and code the pages once, write the narrow result, derive the rest from it.

    The pages are the large input; writing the coded rows means they are read
    and parsed once although numbering needs two passes.
    """
    coded = coded_rows(listing_rows(pages, names=("entry_name",)), base_url)
    return Catalogue(written(coded, "coded-rows"), start)


def files_of_year(files: DataFrame, year: str) -> DataFrame:
    """Files of one year."""
    return files.filter(F.col("year") == year)


def limit_pages(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """Pages 1 to ``max_pages``, at least one; all pages if it is None.

    A plain range on ``page_no``, so it is pushed into the scan.
    """
    return pages if max_pages is None else pages.filter(F.col("page_no").between(1, max(max_pages, 1)))


def complete(file_id: Column, filename: Column, save_name: Column, url: Column) -> Column:
    """Whether a file has all four parts, empty counting as missing."""
    return reduce(Column.__and__, [blank_to_null(part).isNotNull() for part in (file_id, filename, save_name, url)])
