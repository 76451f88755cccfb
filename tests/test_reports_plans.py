"""Links, reports, plans and fetches on small tables."""

import pytest
from pyspark.sql import functions as F

from folioscan import fixed_values as fixed, schemas
from folioscan.operators import dictionary, fetch, links, reports
from folioscan.plans import chain, download

FILES = (
    "id bigint, file_no bigint, session string, discipline string, serie string, localisation string, files_count int, "
    "filename string, download_url string, file_id string, filename_for_save string, year string"
)


def _files(spark, rows):
    return spark.createDataFrame(
        [(i, n, "NORMAL", d, "GENERALE", "ASIA", 1, name, url, fid, f"{i}_{fid}", year) for i, n, d, name, url, fid, year in rows], FILES
    )


def _long(df):
    return {(r["metric"], r["key"]): r["n"] for r in df.collect()}


def test_first_links_with_a_hot_url(spark):
    rows = [(p, n, "hot" if n % 3 else f"u{p}-{n}", f"{p}.{n}") for p in range(1, 9) for n in range(1, 10)]
    df = spark.createDataFrame(rows, "page_no bigint, link_no bigint, url string, data_name string").repartition(5)
    got = {r["url"]: (r["page_no"], r["link_no"], r["data_name"]) for r in links.first_links(df).collect()}
    want = {}
    for p, n, url, name in rows:
        want.setdefault(url, (p, n, name))
    assert got == want
    fresh = {r["page_no"]: r["new_links"] for r in links.new_links_per_page(df).collect()}
    assert fresh == {p: sum(1 for v in want.values() if v[0] == p) for p in range(1, 9)}
    seen = spark.createDataFrame([("hot",), ("hot",)], "url string")
    assert {r["url"] for r in links.unseen_links(df, seen).collect()} == set(want) - {"hot"}


def test_summary(spark):
    files = _files(spark, [
        (1, 1, "MATHS", "24a.pdf", "/document/2020/download", "1", "2024"), (1, 2, "MATHS", "corrige 2019", "/d", "2", None), (2, 1, "SCIENCES", "x", "/d", "3", "2021"),
    ])
    want = {("total", ""): 3, ("by_year", "2024"): 1, ("by_year", "2019"): 1, ("by_subject", "MATHS"): 2, ("by_subject", "SCIENCES"): 1}
    assert _long(reports.summary(files)) == {**want, ("by_type", "sujet"): 3, ("by_type", "correction"): 0}
    assert _long(reports.summary_by_detected_type(files)) == {**want, ("by_type", "sujet"): 2, ("by_type", "correction"): 1}
    assert _long(reports.summary(files.filter("false"))) == {("total", ""): 0, ("by_type", "sujet"): 0, ("by_type", "correction"): 0}
    assert [r[0] for r in reports.summary_years(files).collect()] == ["2024", "2019"]
    assert [r[0] for r in reports.summary_subjects(files).collect()] == ["MATHS", "SCIENCES"]


def test_validation(spark):
    files = _files(spark, [(1, 1, "MATHS", "a", "/d", "1", None), (2, 1, "MATHS", "", "/d", "2", None)])
    report = reports.validation_report(files)
    assert tuple(report.columns) == fixed.VALIDATION_COLUMNS
    assert {r["ID"]: r["Status"] for r in report.collect()} == {1: "OK", 2: "MISSING"}
    assert tuple(reports.validation_gate(report).first()) == (2, 1, False)
    with pytest.raises(ValueError, match="1 of 2"):
        reports.require_valid(report)
    reports.require_valid(report.filter("ID = 1"))
    assert tuple(reports.validation_gate(report.filter("false")).first()) == (0, 0, True)


def test_plan(spark):
    files = _files(spark, [
        (1, 1, "MATHS", "24a.ZIP", "/u1", "1", None), (2, 1, "SCIENCES", "b", "/u1", "2", "2020"), (3, 1, "MATHS", "c.docx", "/u2", "3", ""),
    ])
    plan = download.with_target_path(download.download_plan(files))
    got = {r["id"]: (r["target_path"], r["year"]) for r in plan.collect()}
    assert got == {1: ("2024/MATHS/1_1.zip", "2024"), 2: ("2020/SCIENCES/2_2.pdf", "2020"), 3: ("MATHS/3_3.docx", None)}
    wanted = spark.createDataFrame([("/u1",), ("/u1",), ("/document/2023/download",)], "url string")
    met = sorted((r["url"], r["filename"], r["year"], r["subject"]) for r in download.with_metadata(wanted, plan).collect())
    assert met == [("/document/2023/download", "download", "2023", None)] + [("/u1", "2_2.pdf", "2020", "SCIENCES")] * 2
    landed = spark.createDataFrame([("2024/MATHS/1_1.zip", True), ("2024/MATHS/1_1.zip", True), ("MATHS/3_3.docx", False)], "path string, valid boolean")
    assert {r["id"] for r in download.not_landed(plan, landed).collect()} == {2, 3}
    history = spark.createDataFrame([("/u2",)], "url string")
    assert {r["id"] for r in download.not_landed(plan, landed, "any", history).collect()} == {2}


def test_chain_stops_loops_and_limits(spark):
    edges = [(i, f"p{i}", f"p{i + 1}") for i in range(1, 250)] + [(300, "a", "b"), (301, "b", "a"), (302, "end", None), (303, "gap", "missing")]
    df = spark.createDataFrame(edges, "page_no bigint, url string, next_url string")
    starts = spark.createDataFrame([("p1",), ("p200",), ("a",), ("end",), ("gap",), ("nowhere",)], "url string")
    walked = {}
    for r in chain.page_chain(df, starts).collect():
        walked.setdefault(r["start_url"], {})[r["page_no"]] = r["url"]
    assert walked["p1"] == {i: f"p{i}" for i in range(1, 250)}
    assert walked["p200"] == {i: f"p{199 + i}" for i in range(1, 51)}
    assert walked["a"] == {1: "a", 2: "b"}
    assert walked["end"] == {1: "end"} and walked["gap"] == {1: "gap"} and "nowhere" not in walked
    assert chain.page_chain(df, starts.limit(1), 7).count() == 7
    assert chain.page_chain(df, starts.limit(1), 200).count() == 200


def test_fetches(spark):
    plan = spark.createDataFrame(
        [(1, 1, "/u1", "a.pdf", "1", "2024", "MATHS", "NORMAL", "GENERALE", False, "sujet")],
        "id bigint, file_no bigint, url string, filename string, file_id string, year string, subject string, session string, series string, is_correction boolean, document_type string",
    )
    pdf, doc = b"%PDF" + b"x" * 1100, b"y" * 1200
    rows = [
        ("/u1", 1, None, "application/pdf", pdf, None), ("/u2", 1, None, "", doc, None), ("/u3", 1, None, "application/msword", doc, None),
        ("/u4", 1, None, "", None, "503"), ("/u4", 2, None, "", None, "503"), ("/u5", 1, None, "application/zip", doc, None), ("/u6", 1, None, "", b"z" * 150, None),
    ]
    fetched = fetch.ingested(spark.createDataFrame(rows, schemas.RESPONSES), plan)
    got = {(r["url"], r["attempt_no"]): (r["filepath"], r["outcome"]) for r in fetched.collect()}
    assert got[("/u1", 1)] == ("2024/MATHS/a.pdf", "successful") and got[("/u2", 1)] == ("u2.bin", "successful")
    assert got[("/u3", 1)] == ("u3.doc", "successful") and got[("/u5", 1)] == ("u5.zip", "invalid")
    counts = {r["outcome"]: (r["attempts"], r["urls"]) for r in fetch.outcomes(fetched).collect()}
    assert counts == {"successful": (4, 4), "invalid": (1, 1), "error": (2, 1)}
    stats = _long(reports.fetch_statistics(fetch.history_of(fetched), fetch.failures_of(fetched)))
    assert stats[("total_downloads", "")] == 4 and stats[("total_failures", "")] == 2
    assert stats[("total_size", "")] == len(pdf) + 2 * len(doc) + 150 and ("total_size_formatted", "3.57 KB") in stats
    assert stats[("by_file_type", ".bin")] == 2 and stats[("by_subject", "MATHS")] == 1 and stats[("by_year", "2024")] == 1
    empty = _long(reports.fetch_statistics(fetch.history_of(fetched.filter("false")), fetch.failures_of(fetched.filter("false"))))
    assert empty == {("total_downloads", ""): 0, ("total_failures", ""): 0, ("total_size", ""): 0, ("total_size_formatted", "0.00 B"): 0}


def test_placements(spark):
    """First valid response wins; files that were there stay; discarded and skipped ones leave no record."""
    plan = spark.createDataFrame(
        [(i, 1, f"/{n}", f"{n}.{e}", n, None, None, None, None, False, "sujet") for i, (n, e) in enumerate((n, "pdf") for n in "abcde")],
        "id bigint, file_no bigint, url string, filename string, file_id string, year string, subject string, session string, series string, is_correction boolean, document_type string",
    )
    pdf, doc, short = b"%PDF" + b"x" * 1100, b"y" * 1200, b"z" * 50
    rows = [(f"/x{i:03}", 1, None, "application/msword", short if i < 5 else doc, None) for i in range(90)] + [
        ("/a", 1, None, "application/msword", doc, None), ("/b", 1, None, "application/msword", doc, None), ("/c", 1, None, "", pdf, None),
        ("/d", 1, None, "application/msword", doc, None), ("/e", 1, None, "", None, "503"), ("/e", 2, None, "", pdf, None),
    ]
    responses = spark.createDataFrame(rows, schemas.RESPONSES).withColumn("url", F.regexp_replace("url", "^/x", "/document/9"))
    landed = spark.createDataFrame([("a.doc", True), ("b.doc", False), ("c.pdf", False), ("d.pdf", True)], "path string, valid boolean")
    fetched = fetch.ingested(responses, plan, landed)
    got = {r["filepath"]: (r["responses"], r["placement"]) for r in fetch.placements(fetched).collect()}
    assert got.pop("a.doc") == (1, "kept_existing") and got.pop("b.doc") == (1, "nothing")
    assert got.pop("c.pdf") == (1, "stored") and got.pop("d.doc") == (1, "kept_existing") and got.pop("e.pdf") == (1, "stored")
    assert sum(n for n, _ in got.values()) == 90 and all(p in ("stored", "nothing") for _, p in got.values())
    history = fetch.history_of(fetched)
    assert history.count() == history.select("filepath").distinct().count() == 2 + sum(p == "stored" for _, p in got.values())
    alone = fetch.ingested(responses.filter("url like '/document/%'").selectExpr(
        "'/same' AS url", "CAST(regexp_extract(url, '9(.*)$', 1) AS INT) AS attempt_no", "attempt_ts", "content_type", "content", "error"
    ), plan)
    assert {r["outcome"]: r["attempts"] for r in fetch.outcomes(alone).collect()} == {"invalid": 5, "successful": 1, "discarded": 84}


def test_dictionary_of_any_words(spark):
    words = spark.createDataFrame([("histoire-geo", "HG", 0), ("svt", "S", 1), ("a b", "AB", 2)], "word string, subject string, position int")
    texts = {1: "x histoire-geo svt", 2: "svt2 svt", 3: "histoire-geos", 4: "xa b a b", 5: "", 6: "phys-chim", 7: "svt/a b"}
    df = spark.createDataFrame(list(texts.items()), "key int, text string")
    got = {r["key"]: r["subject"] for r in dictionary.subjects_from_table(df, words).collect()}
    assert got == {1: "HG", 2: "S", 3: None, 4: "AB", 5: None, 6: "Sciences (Physique-Chimie)", 7: "S"}


def test_links_with_entries(spark):
    files = _files(spark, [(1, 1, "MATHS", "a", "/u1", "1", None), (2, 1, "MATHS", "b", "/u1", "2", None)])
    first = spark.createDataFrame([("/u1", 1, 1, ""), ("/u9", 1, 2, "")], "url string, page_no bigint, link_no bigint, data_name string")
    assert {(r["url"], r["id"]) for r in links.with_entries(first, files).collect()} == {("/u1", 1), ("/u9", None)}


def test_dictionary_rows_grow_with_matches(spark):
    """Texts without a dictionary word make no row for the join, however long they and the words are."""
    rows = [(i, " ".join(f"token{(i * 31 + j) % 997}" for j in range(400))) for i in range(20)] + [(20, "abc a b c d a b c"), (21, None), (22, ""), (23, "a-b-c, a b")]
    texts = spark.createDataFrame(rows, "key long, text string")
    words = spark.createDataFrame([("a b c", "x", 2), ("abc", "y", 1), ("a-b", "z", 0), ("q" + " q" * 30, "w", 3), ("a b c", "v", 9)], "word string, subject string, position int")
    lengths, bitmap = dictionary.first_token_index(words)
    assert lengths == [1, 2, 3, 31] and len(bitmap) == dictionary.BITS // 64
    made = texts.select("key", F.explode(dictionary.spans(F.col("text"), lengths, bitmap)).alias("word")).collect()
    assert {r["key"] for r in made} <= {20, 23} and {(20, "abc"), (20, "a b c"), (23, "a-b"), (23, "a-b-c")} <= {tuple(r) for r in made}
    got = {r["key"]: r["subject"] for r in dictionary.subjects_from_table(texts, words).collect()}
    assert len(got) == 24 and (got[20], got[23]) == ("y", "z") and {got[i] for i in (*range(20), 21, 22)} == {None}
    nothing = dictionary.subjects_from_table(texts, words.limit(0)).collect()
    assert len(nothing) == 24 and {r["subject"] for r in nothing} == {None}
