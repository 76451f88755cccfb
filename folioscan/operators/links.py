"""First sight of links, and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGE_BITS = 36


def first_links(links: DataFrame) -> DataFrame:
    """One row per URL: its first link in page and document order.

    An aggregation with a map-side part, not a window: a URL that fills a third
    of the links shrinks to one row per task before the exchange. The links are read
    once, so this is the form for links that are still to be parsed out of pages; it
    sorts them inside the tasks. For a table see ``first_stored_links``.
    """
    first = F.min(F.struct("page_no", "link_no", "data_name"))
    return links.groupBy("url").agg(first.alias("first")).select("url", "first.*")


def first_stored_links(links: DataFrame) -> DataFrame:
    """The same for links that are a table, so that reading them twice is cheap.

    The place of a link is packed into one number, so the least one is found by hash aggregation;
    the rows at those places are then joined by place, which no two links share. A page number may
    have ``PAGE_BITS`` binary digits; a link number never needs more than the rest, as a page is shorter than 2 GB.
    """
    page = F.col("page_no")
    limit = 1 << (PAGE_BITS - 1)
    place = F.when(page.between(-limit, limit - 1), F.shiftleft(page, 64 - PAGE_BITS) + F.col("link_no"))
    place = F.coalesce(place, F.raise_error(F.lit("page number out of range")).cast("bigint"))
    least = links.groupBy("url").agg(F.min(place).alias("place")).select(
        F.shiftright("place", 64 - PAGE_BITS).alias("page_no"), F.pmod("place", F.lit(1 << (64 - PAGE_BITS))).alias("link_no")
    )
    return links.join(least, ["page_no", "link_no"]).select("url", "page_no", "link_no", "data_name")


def new_links_per_page(links: DataFrame) -> DataFrame:
    """How many links are first seen on each page; pages without new links have no row."""
    first_page = links.groupBy("url").agg(F.min("page_no").alias("page_no"))
    return first_page.groupBy("page_no").agg(F.count("*").alias("new_links"))


def unseen_links(links: DataFrame, seen: DataFrame) -> DataFrame:
    """First links whose URL is not among those seen before."""
    return first_links(links).join(seen.select("url").distinct(), "url", "left_anti")


def with_entries(first: DataFrame, files: DataFrame) -> DataFrame:
    """Each first link with the first entry that holds its URL, if any.

    Both sides have one row per URL when they meet, so no URL is hot in the join.
    """
    fields = ["id", "file_no", "session", "discipline", "serie", "localisation", "filename", "filename_for_save"]
    entry = files.groupBy(F.col("download_url").alias("url")).agg(F.min(F.struct(*fields)).alias("entry"))
    return first.join(entry, "url", "left").select("url", "page_no", "link_no", "data_name", "entry.*")
