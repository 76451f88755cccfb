"""Plans that must hold at scale."""

import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from folioscan.operators import catalogue, extract, fetch, links, reports
from folioscan.plans import download
from folioscan.workload import fixtures as fx
from folioscan.workload.oracle import ORACLES
from folioscan.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
# all of them take minutes: check.py does that; a few of each kind run here
CHECKED = os.environ.get("CHECK_QUERIES", "summary exam_files link_dedup file_validate parse_metadata zip_members").split()

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = df.select("*")
    return df._jdf.queryExecution().executedPlan().toString()


def _pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", "<table></table>")], "page_no bigint, url string, html string").write.parquet(path)
    return spark.read.parquet(path)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("orders", "documents", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(oracle_sql()[name])
    order = sorted((d[0], i) for i, d in enumerate(cursor.description))
    assert [c for c, _ in order] == columns
    assert got == sorted((tuple(r[i] for _, i in order) for r in cursor.fetchall()), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(queries()) & set(oracle_sql())


@needs_data
def test_entry(spark):
    assert entry(spark).columns == ["metric", "key", "n"]


def test_extraction_is_narrow_and_in_the_jvm(spark, tmp_path):
    pages = _pages(spark, tmp_path)
    for df in (
        extract.page_links(pages, fx.BASE_URL),
        extract.listing_rows(pages),
        catalogue.coded_rows(extract.listing_rows(pages), fx.BASE_URL),
    ):
        plan = _plan(df)
        assert "Exchange" not in plan and "Python" not in plan
        assert "ReadSchema: struct<page_no:bigint,html:string>" in plan


def test_listing_pages_are_scanned_once_and_meet_no_python(spark, tmp_path):
    rows = extract.listing_rows(_pages(spark, tmp_path))
    coded = catalogue.coded_rows(rows, fx.BASE_URL)
    for df in (reports.summary(catalogue.accepted_files(coded)), coded, extract.distinct_values(rows)):
        plan = _plan(df)
        assert plan.count("FileScan") == 1 and "Python" not in plan
        assert plan.count("html#") <= 4  # scan and the first step only


def test_page_limit_and_codes_are_pushed_down(spark, tmp_path):
    pages = _pages(spark, tmp_path)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(page_no,7\)", _plan(catalogue.limit_pages(pages, 7)))
    built = catalogue.build_catalogue(pages, fx.BASE_URL)
    plan = _plan(built.unnumbered_files)
    for column in (*catalogue.CODES, "file_no"):
        assert f"IsNotNull({column})" in plan
    assert "session_txt" not in plan


def test_rules_run_once_when_codes_are_filtered(spark, tmp_path):
    coded = catalogue.coded_rows(extract.listing_rows(_pages(spark, tmp_path)), fx.BASE_URL)
    plan = _plan(catalogue.accepted_files(coded))
    assert plan.count("THEN HIST_GEO_EMC") == 1


def test_no_pairwise_joins_and_one_row_exchange(spark, tmp_path):
    pages = _pages(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        files = catalogue.build_catalogue(pages, fx.BASE_URL).files
        first = links.first_links(extract.page_links(pages, fx.BASE_URL))
        plan = download.with_target_path(download.download_plan(files))
        frames = {
            "files": files,
            "links": links.with_entries(first, files),
            "metadata": download.with_metadata(first.select("url"), plan),
            "report": reports.validation_report(files),
        }
        for name, df in frames.items():
            text = _plan(df)
            assert "NestedLoop" not in text and "Cartesian" not in text, name
        text = _plan(files)
        # the rows with their file names are exchanged once; the rest are counts
        assert len([1 for line in _exchange_inputs(text) if "filename" in line]) == 1
        # only span totals meet in one task
        single = re.findall(r"Exchange SinglePartition.*\n.*", text)
        assert len(single) == 1 and "span" in single[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _exchange_inputs(plan: str) -> list[str]:
    lines = plan.splitlines()
    return [next(x for x in lines[i + 1 :] if "Project" in x or "Aggregate" in x or "Filter" in x) for i, line in enumerate(lines) if "- Exchange" in line]


@needs_data
def test_bodies_are_not_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        responses = fx.responses(spark, SF).selectExpr("*")
        plan = spark.createDataFrame(
            [], "id bigint, file_no bigint, url string, filename string, file_id string, year string, subject string, session string, series string, is_correction boolean, document_type string"
        )
        joined = _plan(fetch.ingested(responses, plan))
        top, below = joined.split("hashpartitioning(url", 1)
        exchanged = below.splitlines()[1]
        assert "Project" in exchanged and not re.search(r"[\[,] ?content#", exchanged) and "content#" not in top
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
