"""From landed HTML pages to links, table rows and pager edges.

All three drop the page text before anything is shuffled, and are narrow: one
page in, many rows out, no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan import fixed_values as fixed, schemas
from folioscan.functions import markup, metadata, nesting, urls
from folioscan.functions.markup_parser import pager_parent_class
from folioscan.functions.text import strip

_NAME_ATTRIBUTES = {"entry_name": fixed.ENTRY_NAME_ATTRIBUTE, "link_name": fixed.LINK_NAME_ATTRIBUTE}


def page_links(
    pages: DataFrame,
    base_url: str | Column,
    pattern: str = fixed.DOCUMENT_LINK,
    name_attribute: str = fixed.LINK_NAME_ATTRIBUTE,
) -> DataFrame:
    """Every matching link of every page, numbered in document order.

    Links are filtered inside the array, so each anchor is read once and rows
    exist only for links that are kept.
    """
    found = pages.select(
        "page_no",
        *([] if isinstance(base_url, str) else [base_url.alias("base")]),
        F.posexplode(_document_anchors(markup.decode_references(markup.visible(F.col("html"))), pattern)).alias("at", "link"),
    )
    return found.select(
        "page_no",
        (F.col("at") + 1).cast("bigint").alias("link_no"),
        urls.resolve(base_url if isinstance(base_url, str) else F.col("base"), F.col("link.href")).alias("url"),
        markup.attribute(F.col("link.tag"), name_attribute).alias("data_name"),
    )


def _document_anchors(html: Column, pattern: str) -> Column:
    links = F.transform(
        markup.anchors(html), lambda tag: F.struct(markup.attribute(tag, "href").alias("href"), tag.alias("tag"))
    )
    return F.filter(links, lambda link: (link["href"] != "") & urls.is_document_link(link["href"], pattern))


def _cell_links(cell: Column, names: tuple[str, ...]) -> Column:
    """Links of a cell with the asked-for name attributes."""
    tags = F.transform(
        markup.anchors(cell),
        lambda tag: F.struct(
            markup.raw_attribute(tag, "href").alias("href"),
            *[markup.attribute(tag, _NAME_ATTRIBUTES[name]).alias(name) for name in names],
        ),
    )
    return F.transform(
        F.filter(tags, lambda link: link["href"] != ""),
        lambda link: F.struct(markup.unquoted(link["href"]).alias("href"), *[link[name].alias(name) for name in names]),
    )


def _tidy_pages(pages: DataFrame) -> DataFrame:
    """page_no and what can be seen of the page, free of markup inside values."""
    seen = pages.select("page_no", markup.visible(F.col("html")).alias("seen"))
    tidy = F.when(markup.markup_in_values(F.col("seen")), nesting.without_markup_in_values(F.col("seen")))
    return seen.select("page_no", F.coalesce(tidy, F.col("seen")).alias("seen"))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages that have no rows to read, and why: ``page_no, error``."""
    body = _tidy_pages(pages).select("page_no", "seen", markup.table_body(F.col("seen")).alias("body"))
    error = F.when(strip(F.coalesce("seen", F.lit(""))) == "", F.lit("no html")).when(F.col("body").isNull(), F.lit("no table body"))
    return body.select("page_no", error.alias("error")).filter(F.col("error").isNotNull())


def listing_rows(pages: DataFrame, names: tuple[str, ...] = ("entry_name", "link_name")) -> DataFrame:
    """Rows of the first table body that have five cells or more.

    One scan of the pages and no exchange: every page is made visible once, and
    what its body needs is decided once. Bodies with tables inside are cut by
    level (``nesting``), all others in one pass that gives each row as a text, whose cells
    are found once the rows are apart. Pages without a body are in ``rejected_pages``.
    """
    no_text, no_cells = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    nested = F.transform(
        nesting.nested_rows(F.col("seen"), markup.MIN_CELLS),
        lambda row: F.struct(row["row_no"].alias("row_no"), no_text.alias("row"), F.transform(row["cells"], markup.cut_cell).alias("cells")),
    )
    flat = F.transform(
        markup.table_rows(F.col("seen")),
        lambda row, i: F.struct((i + 1).cast("bigint").alias("row_no"), row.alias("row"), no_cells.alias("cells")),
    )
    rows = _tidy_pages(pages).select("page_no", F.inline(F.when(markup.has_inner_tables(F.col("seen")), nested).otherwise(flat)))
    # as generator output the cells are cut once, also for the filter
    cells = F.when(F.col("row").isNull(), F.col("cells")).otherwise(markup.cells_of(F.col("row")))
    rows = rows.select("page_no", "row_no", F.inline(F.array(F.struct(cells.alias("cells"))))).filter(F.size("cells") >= markup.MIN_CELLS)
    rows = rows.select("page_no", "row_no", *[markup.decode_references(F.col("cells")[i]).alias(f"cell_{i}") for i in range(markup.MIN_CELLS)])
    return rows.select(
        "page_no",
        "row_no",
        *[markup.cell_text(F.col(f"cell_{i}")).alias(name) for i, name in enumerate(schemas.LABELS)],
        _cell_links(F.col("cell_4"), names).alias("links"),
    )


def label_values(rows: DataFrame) -> DataFrame:
    """Every non-empty raw label of every row, and its document type by the first link: ``field, value``."""
    first = F.get(F.col("links"), 0)
    text = metadata.search_text(first["href"], metadata.link_name(first["href"], first["link_name"]))
    kind = F.when(first.isNotNull(), metadata.document_type(metadata.correction_in_text(text)))
    pairs = [
        ("Session", F.col("session_txt")),
        ("Discipline", F.col("discipline_txt")),
        ("Serie", F.col("serie_txt")),
        ("Localisation", F.col("localisation_txt")),
        ("TypeDocument", kind),
    ]
    flat = rows.select(
        F.inline(F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in pairs]))
    )
    return flat.filter(F.col("value") != "")


def distinct_values(rows: DataFrame) -> DataFrame:
    """Distinct raw label values per field, and document types of the first link.

    Partial aggregation removes repeats before the exchange, so a value that
    fills a third of the rows costs one row per task.
    """
    return label_values(rows).distinct()


def next_pages(pages: DataFrame) -> DataFrame:
    """Edge to the next page: ``url, next_url``; null where the chain stops."""
    seen = pages.select("page_no", "url", "html", markup.decode_references(markup.visible(F.col("html"))).alias("doc"))
    seen = seen.withColumn("tag", markup.pager_tag(F.col("doc")))
    seen = seen.withColumn("parent", F.when(F.col("tag").isNotNull(), markup.tag_before(F.col("doc"), F.col("tag"))))
    # the parent is the tag before the link, unless elements closed in between
    direct = F.col("parent").rlike(r"^<[A-Za-z]") & ~F.col("parent").rlike(r"/>$|(?i)^<(?:br|img|input|hr)\b")
    seen = seen.select("page_no", "url", "tag", "parent", direct.alias("direct"), "html")
    seen = seen.select(
        "page_no", "url", "tag", "parent", "direct",
        pager_parent_class(F.when(~F.col("direct"), F.col("html"))).alias("read"),
    )
    around = F.when(F.col("direct"), markup.attribute(F.col("parent"), "class")).otherwise(F.col("read"))
    own = markup.attribute(F.col("tag"), "class")
    disabled = own.contains("is-disabled") | around.contains("is-disabled")
    target = urls.resolve(F.col("url"), markup.attribute(F.col("tag"), "href"))
    return seen.select("page_no", "url", F.when(F.col("tag").isNotNull() & ~disabled, target).alias("next_url"))
