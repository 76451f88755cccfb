"""Extraction, coding and numbering on small pages, against brute force."""

import random

from pyspark.sql import functions as F

from folioscan import fixed_values as fixed, schemas
from folioscan.functions import markup, nesting
from folioscan.functions.markup_parser import HtmlRows, pager_parent_class_of, rows_of
from folioscan.operators import catalogue, extract, numbering

BASE = "https://listing.example.org/archive/list"
HEAD = "<html><script>'<tbody><tr><td>'</script><!-- <a href='/document/0/download'> --><table>"

PLAIN = HEAD + """<tbody class="x"><tr><td> a <b>b</b>&nbsp;</td><td>c&eacute;&#233;&#xE9;&amp;lt;</td><td>d</td>
<td>e<!-- q -->f</td><td><a class="a>b" href="/document/7/download?x=1&amp;y=2" data-ati-name='24x.pdf|7'>t</a><a>n</a>
<A HREF=/document/8/download data-atl-name="z|8">u</a><a href="">e</a></td></tr><tr><td>1</td></tr></tbody></table>"""
OPEN_ENDED = HEAD + "<tbody><tr><td>1<td>2<td>3<td>4<td><a href='/document/1/download'>x<tr><td>5<td>6<td>7<td>8<td>9</table><p>rest"
NESTED = HEAD + """<tbody><tr><td>1</td><td>2</td><td>3</td><td>4 &lt;b&gt;</td><td><table><tbody><tr><td>in</td></tr></tbody></table>
<a href='/document/"5"/download' data-ati-name="a&amp;amp;b">x</a></td></tr></tbody><tbody><tr><td>a<td>b<td>c<td>d<td>e</tr></tbody></table>"""
UNCLOSED = PLAIN.replace("</table>", "</table><!-- <a href='/document/9/download'>")
ROW = "<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>{}</td></tr>"
QUOTED = [
    HEAD + "<tbody>" + ROW.format('<a title="a <td> b" href="/document/1/download">x</a>') + "</tbody></table>",
    HEAD + "<tbody>" + ROW.format("<a href='/document/2/download'>x</a>").replace("<td>2", '<td title="end </table>">2') + "</tbody></table>",
    HEAD + "<![foo[x]]><tbody>" + ROW.format("<a title='<tr' href='/document/3/download'>x</a>") + "</tbody></table>",
]
NO_BODY = "<html><table><tr><td>1<td>2<td>3<td>4<td>5</table>"
STRANGE = HEAD + "<tbody><tr><td>&euro;&nosuch;&#128512;&#xD800;&#0;</td><td>a &amp;eacute; b</td><td>x<script>no</script>y</td><td> &lt;i&gt; </td><td></td></tr></tbody></table>"


def _pages(spark, *htmls):
    return spark.createDataFrame([(i + 1, f"{BASE}?page={i + 1}", h) for i, h in enumerate(htmls)], schemas.LANDED_PAGES)


def _rows(df):
    return [(r["page_no"], r["row_no"], *[r[c] for c in schemas.LABELS], [tuple(x) for x in r["links"]]) for r in df.orderBy("page_no", "row_no").collect()]


def test_rows(spark):
    got = _rows(extract.listing_rows(_pages(spark, PLAIN, OPEN_ENDED, NESTED, NO_BODY, STRANGE)))
    assert got == [
        (1, 1, "ab", "cééé&lt;", "d", "ef", [("/document/7/download?x=1&y=2", "24x.pdf|7", ""), ("/document/8/download", "", "z|8"), ("", "", "")]),
        (2, 1, "1", "2", "3", "4", [("/document/1/download", "", "")]),
        (2, 2, "5", "6", "7", "8", []),
        (3, 1, "1", "2", "3", "4 <b>", [('/document/"5"/download', "a&amp;b", "")]),
        (5, 1, "€&nosuch;😀&#xD800;&#0;", "a &eacute; b", "xy", "<i>", []),
    ]


def test_parser_agrees_with_expressions(spark):
    pages = _pages(spark, PLAIN, OPEN_ENDED, NO_BODY)
    native = _rows(extract.listing_rows(pages))
    parsed = [(i, r["row_no"], *[r[c] for c in schemas.LABELS], [tuple(x.values()) for x in r["links"]]) for i, h in ((1, PLAIN), (2, OPEN_ENDED), (3, NO_BODY)) for r in rows_of(h)]
    assert native == parsed
    table = pages.lateralJoin(HtmlRows(F.col("html").outer())).select("page_no", "row_no", *schemas.LABELS, "links")
    assert _rows(table) == parsed


def _parsed(htmls):
    return [
        (i, r["row_no"], *[r[c] for c in schemas.LABELS], [tuple(x.values()) for x in r["links"]])
        for i, h in enumerate(htmls, 1) for r in rows_of(h)
    ]


def _random_table(rng, depth, closed):
    """A table with tables inside; unless closed, end tags of rows and cells are missing here and there."""
    end = lambda tag: tag if closed or rng.random() < 0.6 else ""
    html = "<table>" + rng.choice(["", "<thead><tr><th>h</th></tr></thead>"]) + rng.choice(["<tbody>", '<TBODY class="x">'])
    fill = ["t1", " x <b>y</b> z", "&eacute;&lt;", '<a href="/document/1/download" data-ati-name="n">l</a>',
            '<a title="<td> q" href="h2">m</a>', "<i title='</table>'>w</i>"]
    for _ in range(rng.randint(0, 3)):
        html += "<tr>"
        for _ in range(rng.choice([1, 4, 5, 6, 7])):
            html += rng.choice(["<td>", '<td a="b">', "<TD>"]) + rng.choice(fill)
            if depth and rng.random() < 0.25:
                html += _random_table(rng, depth - 1, closed) + "after"
            html += end("</td>")
        html += end("</tr>")
    if rng.random() < 0.2:
        html += "</tbody><tbody><tr><td>a<td>b<td>c<td>d<td>e</tr>"
    return html + "</tbody></table>"


def test_nested_tables_against_the_parser(spark):
    rng = random.Random(3)
    pages = ["<html>" + _random_table(rng, 3, i % 2 == 0) + "<p>tail</p>" + _random_table(rng, 1, True) for i in range(400)]
    pages += [NESTED, PLAIN, "<table><tbody><tr><td><table><tbody><tr><td>1<td>2<td>3<td>4<td>5", "<tbody></table><table><tbody>", *QUOTED]
    got = _rows(extract.listing_rows(_pages(spark, *pages)))
    assert got == _parsed(pages) and len(got) > 2000


def test_large_nested_page(spark):
    row = "<tr><td>{}</td><td>b</td><td>c</td><td>d</td><td><table><tbody><tr><td>z</td></tr></tbody></table></td></tr>"
    page = "<html><table><tbody>" + "".join(row.format(i) for i in range(5000)) + "</tbody></table>"
    rows = _rows(extract.listing_rows(_pages(spark, page)))
    assert [(r[1], r[2]) for r in rows] == [(2 * i + 1, str(i)) for i in range(5000)]


def test_running_sum(spark):
    for n in (0, 1, 2, 127, 128, 129, 1000):
        values = [(i * 7) % 5 - 2 for i in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(nesting.running_sum(F.col("v")).alias("s")).first()
        assert row["s"] == [sum(values[: i + 1]) for i in range(n)]


def test_markup_in_values_loses_nothing(spark):
    got = _rows(extract.listing_rows(_pages(spark, *QUOTED)))
    assert [(r[0], len(r[-1])) for r in got] == [(1, 1), (2, 1), (3, 1)]
    assert got == _parsed(QUOTED)


def test_rejected_pages(spark):
    pages = _pages(spark, PLAIN, None, " \n", NO_BODY, HEAD + "<!-- <tbody><tr> --></table>", NESTED, *QUOTED)
    got = {r["page_no"]: r["error"] for r in extract.rejected_pages(pages).collect()}
    assert got == {2: "no html", 3: "no html", 4: "no table body", 5: "no table body"}
    assert {r[0] for r in _rows(extract.listing_rows(pages))} == {1, 6, 7, 8, 9}


def test_links(spark):
    links = extract.page_links(_pages(spark, PLAIN), BASE).orderBy("link_no").collect()
    assert extract.page_links(_pages(spark, UNCLOSED), BASE).count() == 2
    assert [tuple(r) for r in links] == [
        (1, 1, "https://listing.example.org/document/7/download?x=1&y=2", ""),
        (1, 2, "https://listing.example.org/document/8/download", "z|8"),
    ]


def test_distinct_values(spark):
    got = {tuple(r) for r in extract.distinct_values(extract.listing_rows(_pages(spark, PLAIN, PLAIN, OPEN_ENDED))).collect()}
    assert ("Session", "ab") in got and ("Localisation", "8") in got and ("TypeDocument", "sujet") in got
    assert len([g for g in got if g[0] == "Session"]) == 3


def test_next_pages(spark):
    bodies = [
        '<ul><li class="p"><a rel="next" href="?page=2">n</a></li></ul>',
        '<a title="Aller à la page suivante" href="/x?page=3">n</a>',
        '<li class="is-disabled"><a rel="next" href="?page=4">n</a></li>',
        '<li><a rel="next" class="a is-disabled" href="?page=5">n</a></li>',
        '<div class="is-disabled"><i>x</i> <a rel="next" href="?page=6">n</a></div>',
        '<div class="is-disabled"></div><div><br><a rel="next" href="?page=7">n</a></div>',
        "<a href='?page=8'>n</a>",
    ]
    got = [r["next_url"] for r in extract.next_pages(_pages(spark, *bodies)).orderBy("page_no").collect()]
    assert got == [f"{BASE}?page=2", "https://listing.example.org/x?page=3", None, None, None, f"{BASE}?page=7", None]
    assert pager_parent_class_of(bodies[4]) == "is-disabled"


def _listing(rows):
    cells = "".join(
        f"<tr><td>{s}</td><td>{d}</td><td>{e}</td><td>{p}</td><td>{''.join(f'<a href={chr(34)}{h}{chr(34)} data-ati-name={chr(34)}{n}{chr(34)}>x</a>' for h, n in links)}</td></tr>"
        for s, d, e, p, links in rows
    )
    return f"<table><tbody>{cells}</tbody></table>"


def test_catalogue(spark):
    ok = ("2024 - normale", "Sciences", "Pro", "Asie")
    pages = _pages(
        spark,
        _listing([
            (*ok, [("/document/1/download", "24a.pdf|1"), ("/aide", ""), ("/document/2/download", "|2")]),
            ("2024", "Sciences", "Pro", "Mars", [("/document/3/download", "")]),
            (*ok, []),
            ("2019 normale", "maths", "gen", "liban", [("/document/4/download", "")]),
        ]),
        _listing([(*ok, [("/document/1/download", "x.zip")])]),
    )
    built = catalogue.build_catalogue(pages, BASE)
    files = [tuple(r) for r in built.files.orderBy("id", "file_no").collect()]
    o = "https://listing.example.org/document/"
    assert files == [
        (1, 1, "NORMAL", "SCIENCES", "PROFESSIONNELLE", "ASIA", 2, "24a.pdf", o + "1/download", "1", "1_NORMAL_SCIENCES_PROFESSIONNELLE_ASIA_1", "2024"),
        (1, 2, "NORMAL", "SCIENCES", "PROFESSIONNELLE", "ASIA", 2, "", o + "2/download", "2", "1_NORMAL_SCIENCES_PROFESSIONNELLE_ASIA_2", "2024"),
        (2, 1, "NORMAL", "MATHS", "GENERALE", "LIBAN", 1, "download", o + "4/download", "4", "2_NORMAL_MATHS_GENERALE_LIBAN_4", "2019"),
        (3, 1, "NORMAL", "SCIENCES", "PROFESSIONNELLE", "ASIA", 1, "x.zip", o + "1/download", "1", "3_NORMAL_SCIENCES_PROFESSIONNELLE_ASIA_1", "2024"),
    ]
    rejects = {(r["row_no"], tuple(r["failed"])) for r in built.rejects.collect()}
    assert rejects == {(2, ("session", "localisation")), (3, ("files",))}
    assert built.entries.count() + built.rejects.count() == extract.listing_rows(pages).count()
    nested = catalogue.nested_entries(built.files).filter("id = 1").first()
    assert [f["file_id"] for f in nested["files"]] == ["1", "2"]
    coded = {f: {r[0] for r in built.rows.select(f).dropna().distinct().collect()} for f in catalogue.CODES}
    assert all(values <= set(schemas.DOMAINS[f]) for f, values in coded.items())
    assert built.rows.filter("session IS NULL").count() == 1
    assert catalogue.limit_pages(pages, 1).count() == 1 and catalogue.limit_pages(pages, 0).count() == 1
    many = spark.range(1, 300).select(F.col("id").alias("page_no"))
    assert catalogue.limit_pages(many, None).count() == 299 and catalogue.limit_pages(many, 200).count() == 200


def test_numbers_match_a_plain_count(spark, monkeypatch):
    # small spans and blocks, and one page that holds a third of the rows
    monkeypatch.setattr(numbering, "PAGE_SPAN", 4)
    monkeypatch.setattr(numbering, "ROW_BLOCK", 8)
    rng = random.Random(5)
    keys = sorted({(7, rng.randint(1, 400)) for _ in range(200)} | {(rng.randint(0, 50), rng.randint(1, 30)) for _ in range(400)})
    rows = [(p, r, f) for p, r in keys for f in range(1, rng.randint(1, 3) + 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_no bigint, row_no bigint, file_no bigint")
    numbered = numbering.number_rows(df, F.col("file_no") == 1, start=11).collect()
    want = {key: i for i, key in enumerate(keys, start=11)}
    assert len(numbered) == len(rows)
    assert all(r["id"] == want[(r["page_no"], r["row_no"])] for r in numbered)


def test_pages_of_known_markup_need_no_parser_and_give_the_same_rows(monkeypatch):
    import random

    from folioscan.functions import markup_parser

    row = (
        '<tr><td class="x">\n &eacute;1&nbsp;</td><TD> b<br/> <i>c</i></td><td>d<!-- x -->e</td><td/>f<td><a title="<td> </table>" href=\'u&amp;v\' '
        'data-atl-name="n|1" HREF=w>x</a><table><tbody><td>in</td></tbody></table><a href=y>z</tr>'
    )
    page = f"<!DOCTYPE html><![foo[x]]><script>var x = '<a href=q>';</script><p>p<table><tbody>{row * 3}</tbody></table>"
    parsed = markup_parser._rows(markup_parser._read(page))
    odd = ["<", "</", "<title><td></title>", "<a href='x'b=c>", "<script><!-- </script>", "<![CDATA[<td>]]>", "<!---->", "<td", "<p/ >"]
    plain = ["<table>", "</table>", "<tbody>", "</tbody>", "<tr>", "</tr>", "<td>", "<td>", "</td>", "<th>", "<b>", "</b>", "<a href=x>", "</a>", "<br>", "a ", "&amp", "<li/>"]
    rng = random.Random(5)
    pages = ["<tbody><tr>" + "".join(rng.choice(plain + odd * (i % 2)) for _ in range(rng.randrange(60))) for i in range(3000)]
    for html in pages:
        assert rows_of(html) == markup_parser._rows(markup_parser._read(html)), html
    assert [len(r["links"]) for r in parsed] == [2] * len(parsed) and len(parsed) == 3
    monkeypatch.setattr(markup_parser, "_read", None)
    assert rows_of(page) == parsed
