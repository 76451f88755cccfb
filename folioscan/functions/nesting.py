"""Tables inside tables, and markup inside quoted values, as column expressions.

The page is cut into table tags and what stands between them. A running sum of opened
and closed tables gives every tag its level, and sorting by level puts the tag that ends
a row or cell right behind the one that begins it: whatever lies deeper is out of the way.
So first body, rows and cells are found with a few passes over an array, without a parser,
without an exchange, and in time that grows like n log n with the number of tags.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscan.functions.text import let

_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_NAMES = "table|tbody|thead|tfoot|tr|td|th"
_TABLE_TAG = rf"</?(?:{_NAMES})(?=[\s/>]){_IN_TAG}"
_PIECES = rf"(?i){_TABLE_TAG}|(?:[^<]++|<(?!/?(?:{_NAMES})[\s/>]))++|<"
_KIND = rf"(?i)^<(/?(?:{_NAMES}))(?=[\s/>])(?s:.*)>$"
_NO_MARKUP_IN_TAG = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""
# Text and tags that hold no '<' as one piece, a tag that holds one as another.
_TIDY_OR_TAG = rf"(?:[^<]++|<(?![A-Za-z])|<[A-Za-z]{_NO_MARKUP_IN_TAG})++|<[A-Za-z]{_IN_TAG}|<"
_TAG_WITH_MARKUP = rf"^<[A-Za-z](?!{_NO_MARKUP_IN_TAG}){_IN_TAG}"
_MARK = "<!>"

_SECTIONS = ("tbody", "thead", "tfoot")
_SECTION_ENDS = (*_SECTIONS, "/tbody", "/table")
_ROW_ENDS = (*_SECTION_ENDS, "tr", "/tr")
_CELL_ENDS = (*_ROW_ENDS, "td", "th", "/td")
BLOCKS = (8, 64)  # places that are summed one by one, then such blocks; small ones first, as each sum copies its block


def running_sum(values: Column, blocks: tuple[int, ...] = BLOCKS) -> Column:
    """Sums of an array up to each of its places.

    Sums are formed inside blocks, and the sums of whole blocks in the same way, so an
    element costs one step and a copy of no more than a block.
    """

    def within(v: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(v, empty, lambda sums, x: F.concat(sums, F.array(_last(sums) + x)))

    def summed(v: Column) -> Column:
        size = blocks[0]
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(size))
        return let(F.transform(starts, lambda at: within(_between(v, at, F.least(at + size, F.size(v)) - 1))), joined)

    def joined(parts: Column) -> Column:
        ends = running_sum(F.transform(parts, _last), blocks[1:])
        shifted = lambda sums, end: let(end - _last(sums), lambda base: F.transform(sums, lambda x: x + base))
        return F.flatten(F.zip_with(parts, ends, shifted))

    if not blocks:
        return within(values)
    return let(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(F.array().cast("array<int>")))


def _last(sums: Column) -> Column:
    return F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0))


def without_markup_in_values(html: Column) -> Column:
    """The page with every '<' inside a tag written as a reference, which means the same there."""
    pieces = F.regexp_extract_all(html, F.lit(_TIDY_OR_TAG), F.lit(0))

    def tidy(piece: Column) -> Column:
        inside = F.replace(F.substring(piece, 2, 1 << 30), F.lit("<"), F.lit("&lt;"))
        return F.when(piece.rlike(_TAG_WITH_MARKUP), F.concat(F.lit("<"), inside)).otherwise(piece)

    return F.array_join(F.transform(pieces, tidy), "")


def _kind(piece: Column) -> Column:
    """Name of the table tag that a piece is, else ''."""
    return F.when(piece.startswith("<"), F.lower(F.regexp_extract(piece, _KIND, 1))).otherwise("")


def _levelled(kinds: Column) -> Column:
    """Table tags as (level, at, kind), from the kinds of all pieces: the tables open around them, their piece, their name."""
    tags = F.filter(
        F.transform(kinds, lambda kind, i: F.struct(i.alias("at"), kind.alias("kind"))),
        lambda tag: tag["kind"] != "",
    )

    def with_level(found: Column) -> Column:
        step = F.transform(found, lambda tag: F.when(tag["kind"] == "table", 1).when(tag["kind"] == "/table", -1).otherwise(0))
        return F.zip_with(
            found, running_sum(step),
            # the end of a table is on the level that it closes
            lambda tag, depth: F.struct(
                (depth + (tag["kind"] == "/table").cast("int")).alias("level"), tag["at"].alias("at"), tag["kind"].alias("kind")
            ),
        )

    return let(tags, with_level)


def _extents(tags: Column, kind: str, ends: tuple[str, ...], last: Column, cells_before: Column) -> Column:
    """(at, end, first, behind) of all tags of a kind, in page order; behind: cells before the end."""
    marks = F.sort_array(F.filter(tags, lambda tag: tag["kind"].isin(*ends)))

    def paired(sorted_: Column) -> Column:
        def one(tag: Column, i: Column) -> Column:
            after = F.get(sorted_, i + 1)
            same = after["level"] == tag["level"]
            return F.struct(
                tag["at"].alias("at"), F.coalesce(F.when(same, after["at"]), last).alias("end"), tag["cells"].alias("first"),
                F.coalesce(F.when(same, after["cells"]), cells_before).alias("behind"), tag["kind"].alias("kind"),
            )

        return F.sort_array(F.filter(F.transform(sorted_, one), lambda tag: tag["kind"] == kind))

    return let(marks, paired)


def nested_rows(html: Column, least: int) -> Column:
    """Rows of the first table body with at least ``least`` cells: ``row_no`` and the contents of their first cells.

    A row ends at the next row or section of its own table, or with the table; a cell
    also at the next cell. Rows of inner tables are rows as well, and a row has the cells
    of the tables inside it. What a cell holds keeps its links and texts, table tags
    become marks.
    """

    def rows_of(page: Column) -> Column:
        pieces, tags = page["pieces"], page["tags"]
        begin = F.get(F.filter(tags, lambda tag: tag["kind"] == "tbody"), 0)
        return let(
            begin,
            lambda first: let(
                F.coalesce(
                    F.get(F.filter(tags, lambda tag: (tag["at"] > first["at"]) & _closes(tag, first)), 0)["at"], F.size(pieces)
                ),
                lambda end: inside(pieces, F.filter(tags, lambda tag: (tag["at"] > first["at"]) & (tag["at"] < end)), end),
            ),
        )

    def inside(pieces: Column, tags: Column, end: Column) -> Column:
        def counted(own: Column) -> Column:
            cell = F.transform(own, lambda tag: (tag["kind"] == "td").cast("int"))
            return F.zip_with(
                own, running_sum(cell),
                lambda tag, n: F.struct(
                    tag["level"].alias("level"), tag["at"].alias("at"), tag["kind"].alias("kind"),
                    (n - (tag["kind"] == "td").cast("int")).alias("cells"),
                ),
            )

        def built(found: Column) -> Column:
            total = F.size(F.filter(found, lambda tag: tag["kind"] == "td"))
            return let(
                F.struct(
                    _extents(found, "tr", _ROW_ENDS, end, total).alias("rows"), _extents(found, "td", _CELL_ENDS, end, total).alias("cells"),
                    pieces.alias("pieces"),
                ),
                contents,
            )

        return let(tags, lambda own: let(counted(own), built))

    def contents(page: Column) -> Column:
        def content(cell: Column) -> Column:
            return F.array_join(_between(page["pieces"], cell["at"] + 1, cell["end"] - 1), "")

        rows = F.transform(
            page["rows"],
            lambda row, i: F.struct((i + 1).cast("bigint").alias("row_no"), (row["behind"] - row["first"]).alias("n"), row["first"].alias("first")),
        )
        return F.transform(
            F.filter(rows, lambda row: row["n"] >= least),
            lambda row: F.struct(
                row["row_no"].alias("row_no"),
                F.array(*[let(F.get(page["cells"], row["first"] + i), content) for i in range(least)]).alias("cells"),
            ),
        )

    def marked(pieces: Column, kinds: Column) -> Column:
        texts = F.zip_with(pieces, kinds, lambda piece, kind: F.when(kind != "", _MARK).otherwise(piece))
        return let(F.struct(texts.alias("pieces"), _levelled(kinds).alias("tags")), rows_of)

    # the kind of a piece takes a pattern, and is found once
    pieces = F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0))
    return let(pieces, lambda own: let(F.transform(own, _kind), lambda kinds: marked(own, kinds)))


def _between(values: Column, first: Column, last: Column) -> Column:
    """Elements of an array from place to place; unlike ``slice`` it touches no others."""
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(values, i))


def _closes(tag: Column, first: Column) -> Column:
    return (tag["level"] == first["level"]) & tag["kind"].isin(*_SECTION_ENDS)
