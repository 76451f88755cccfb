"""Registered queries: one for each operator, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscan import fixed_values as fixed
from folioscan.functions import filetypes, labels, metadata, urls
from folioscan.functions.markup_parser import HtmlRows
from folioscan.functions.text import fold
from folioscan.operators import catalogue, dictionary, extract, fetch, links, reports
from folioscan.plans import chain, download
from folioscan.session import new_path, ship_package, written
from folioscan.sources import archives, landed, sinks
from folioscan.streaming import landing
from folioscan.workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query; its session may have been built elsewhere, so the package is sent along."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(ship_package(spark), sf_dir)
    return function


# --- shared steps --------------------------------------------------------------

def _catalogue(spark: SparkSession, sf_dir: str) -> catalogue.Catalogue:
    return catalogue.build_catalogue(fx.landed_pages(spark, sf_dir), fx.BASE_URL)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded rows for reports that need no ids: nothing is written."""
    return catalogue.coded_rows(extract.listing_rows(fx.landed_pages(spark, sf_dir), names=("entry_name",)), fx.BASE_URL)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.accepted_files(_coded(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return download.download_plan(_catalogue(spark, sf_dir).files)


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.ingested(fx.responses(spark, sf_dir), _plan(spark, sf_dir))


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_links(fx.landed_pages(spark, sf_dir), fx.BASE_URL)


# --- extraction ------------------------------------------------------------------

@query
def link_extract(spark, sf_dir):
    """Links of the real web pages, with the link pattern as a parameter."""
    return extract.page_links(fx.pages_table(spark, sf_dir), fx.BASE_URL, pattern="^/")


@query
def link_extract_own_base(spark, sf_dir):
    """The same links as seen from the page they are on."""
    return extract.page_links(fx.pages_table(spark, sf_dir), F.col("url"), pattern="^/").select("page_no", "link_no", "url")


@query
def link_extract_fx(spark, sf_dir):
    return _page_links(spark, sf_dir)


@query
def listing_rows(spark, sf_dir):
    rows = extract.listing_rows(fx.landed_pages(spark, sf_dir))
    return rows.select(
        "page_no", "row_no", "session_txt", "discipline_txt", "serie_txt", "localisation_txt",
        F.size("links").alias("n_links"), F.col("links")[0]["href"].alias("href"), F.col("links")[0]["entry_name"].alias("data_name"),
    )


@query
def listing_rows_udtf(spark, sf_dir):
    """All pages through the tolerant parser as a table function."""
    pages = fx.landed_pages(spark, sf_dir)
    rows = pages.lateralJoin(HtmlRows(F.col("html").outer()))
    return rows.select("page_no", "row_no", "session_txt", "discipline_txt", "serie_txt", "localisation_txt")


@query
def distinct_values(spark, sf_dir):
    return extract.distinct_values(extract.listing_rows(fx.landed_pages(spark, sf_dir)))


@query
def next_pages(spark, sf_dir):
    return extract.next_pages(fx.landed_pages(spark, sf_dir))


@query
def next_pages_fallbacks(spark, sf_dir):
    """Pagers without rel, with disabled links, and with links that lead back."""
    return extract.next_pages(fx.pager_pages(spark, sf_dir))


@query
def page_chain_loops(spark, sf_dir):
    """Chains from every hundredth page and from the first; some end at a disabled link, some in a loop."""
    edges = extract.next_pages(fx.pager_pages(spark, sf_dir))
    starts = edges.filter((F.col("page_no") % 100 == 0) | (F.col("page_no") == 1)).select("url")
    return chain.page_chain(edges, starts)


@query
def page_chain(spark, sf_dir):
    edges = extract.next_pages(fx.landed_pages(spark, sf_dir))
    starts = edges.agg(F.min_by("url", "page_no").alias("url"))
    return chain.page_chain(edges, starts)


@query
def page_limit(spark, sf_dir):
    pages = catalogue.limit_pages(fx.landed_pages(spark, sf_dir), 7)
    return extract.listing_rows(pages).groupBy("page_no").agg(F.count("*").alias("n"))


# --- catalogue --------------------------------------------------------------------

@query
def exam_entries(spark, sf_dir):
    return _catalogue(spark, sf_dir).entries


@query
def exam_files(spark, sf_dir):
    return _catalogue(spark, sf_dir).files


@query
def exam_entries_nested(spark, sf_dir):
    """Entries with their files as an array, flattened again for the check."""
    entries = catalogue.nested_entries(_catalogue(spark, sf_dir).files)
    return entries.select("id", F.size("files").alias("n"), F.array_join("files.filename", "/").alias("names"))


@query
def rejected_rows(spark, sf_dir):
    rejects = catalogue.rejected_rows(_coded(spark, sf_dir))
    return rejects.select("page_no", "row_no", F.explode("failed").alias("field"))


@query
def files_by_year(spark, sf_dir):
    files = catalogue.files_of_year(_accepted(spark, sf_dir), "2024")
    return files.select("page_no", "row_no", "file_no", "year", "download_url")


# --- labels --------------------------------------------------------------------------

@query
def norm_session(spark, sf_dir):
    text = F.col("session_txt")
    return fx.listing_rows(spark, sf_dir).select(
        "row_key", labels.session_code(text).alias("code"), labels.session_kind(text).alias("kind")
    )


@query
def norm_discipline(spark, sf_dir):
    return fx.listing_rows(spark, sf_dir).select("row_key", labels.discipline(F.col("discipline_txt")).alias("code"))


@query
def norm_serie(spark, sf_dir):
    return fx.listing_rows(spark, sf_dir).select("row_key", labels.serie(F.col("serie_txt")).alias("code"))


@query
def norm_localisation(spark, sf_dir):
    return fx.listing_rows(spark, sf_dir).select("row_key", labels.location(F.col("localisation_txt")).alias("code"))


@query
def norm_whole_texts(spark, sf_dir):
    """All label rules on whole documents."""
    folded = fx.table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("text"))
    folded = folded.withColumn("single", labels.single_blanks(F.col("text")))
    text = F.col("text")
    return folded.select(
        "doc_id",
        labels.session_code(text, folded=True).alias("session"),
        labels.discipline(text, folded=True).alias("discipline"),
        labels.serie(text, folded=True).alias("serie"),
        labels.location(text, folded=True, single=F.col("single")).alias("localisation"),
    )


@query
def sql_label_functions(spark, sf_dir):
    """The label rules as SQL functions."""
    labels.register_sql_functions(spark)
    return spark.sql(
        """SELECT row_key, label_session_code(session_txt) AS session_code, label_session_kind(session_txt) AS session,
                  label_discipline(discipline_txt) AS discipline, label_serie(serie_txt) AS serie,
                  label_location(localisation_txt) AS localisation
           FROM {rows}""",
        rows=fx.listing_rows(spark, sf_dir),
    )


# --- metadata ---------------------------------------------------------------------------

def _texts(spark, sf_dir) -> DataFrame:
    names = fx.link_names(spark, sf_dir)
    named = names.withColumn("name", metadata.link_name(F.col("url"), F.col("data_name")))
    return named.withColumn("text", metadata.search_text(F.col("url"), F.col("name")))


@query
def parse_metadata(spark, sf_dir):
    parsed = metadata.with_parsed(fx.link_names(spark, sf_dir), F.col("url"), F.col("data_name"))
    return parsed.select("row_key", "url", *metadata.FIELDS)


@query
def parse_year(spark, sf_dir):
    return _texts(spark, sf_dir).select("row_key", metadata.year(F.col("url"), F.col("name")).alias("year"))


@query
def file_year(spark, sf_dir):
    return _texts(spark, sf_dir).select("row_key", metadata.file_year(F.col("name")).alias("year"))


@query
def parse_subject(spark, sf_dir):
    return _texts(spark, sf_dir).select("row_key", metadata.subject_in_text(F.col("text")).alias("subject"))


@query
def parse_subject_dim(spark, sf_dir):
    words = spark.createDataFrame(
        [(word, subject, i) for i, (word, subject) in enumerate(fixed.SUBJECT_WORDS)], "word string, subject string, position int"
    )
    texts = _texts(spark, sf_dir).select("row_key", "text")
    return dictionary.subjects_from_table(texts, words, key="row_key")


@query
def parse_session(spark, sf_dir):
    return _texts(spark, sf_dir).select("row_key", metadata.session_in_text(F.col("text")).alias("session"))


@query
def parse_series(spark, sf_dir):
    return _texts(spark, sf_dir).select("row_key", metadata.series_in_text(F.col("text")).alias("series"))


@query
def parse_correction(spark, sf_dir):
    correction = metadata.correction_in_text(F.col("text"))
    return _texts(spark, sf_dir).select(
        "row_key", correction.alias("is_correction"), metadata.document_type(correction).alias("document_type")
    )


@query
def organized_name(spark, sf_dir):
    """Names built from metadata parts; the file name is left out to force building."""
    m = metadata.with_parsed(fx.link_names(spark, sf_dir), F.col("url"), F.col("data_name"))
    parts = [F.col(c) for c in ("year", "subject", "session", "series", "document_type", "file_id")]
    return m.select(
        "row_key",
        metadata.organized_name(F.lit(None).cast("string"), *parts).alias("built"),
        metadata.organized_name(F.col("filename"), *parts).alias("name"),
    )


@query
def format_bytes(spark, sf_dir):
    """Sizes up to the fourth power of a key: exact as far as 38 digits go, beyond that as doubles."""
    k = F.col("o_orderkey").cast("bigint")

    def power(n: int, times: int = 1):
        exact = reduce(F.try_multiply, [k.cast("decimal(38,0)")] * n + [F.lit(times).cast("decimal(38,0)")])
        return F.coalesce(exact.cast("double"), reduce(Column.__mul__, [k.cast("double")] * n) * times)

    sizes = fx.table(spark, sf_dir, "orders").select(
        k.alias("row_key"),
        F.when(k % 4 == 0, power(1)).when(k % 4 == 1, power(2)).when(k % 4 == 2, power(3, 17)).otherwise(power(4)).alias("size"),
    )
    return sizes.select("row_key", metadata.format_bytes(F.col("size")).alias("shown"))


@query
def file_extension(spark, sf_dir):
    name = metadata.link_name(F.col("url"), F.col("data_name"))
    return fx.link_names(spark, sf_dir).select(
        "row_key",
        urls.file_extension(F.col("url"), name).alias("by_name"),
        urls.file_extension(F.col("url"), F.lit(None).cast("string")).alias("by_url"),
    )


@query
def url_filename(spark, sf_dir):
    return fx.link_names(spark, sf_dir).select(
        "row_key", urls.name_in_url(F.col("url")).alias("raw"), urls.safe_name_in_url(F.col("url")).alias("safe")
    )


@query
def url_resolve(spark, sf_dir):
    """Ten spellings of each link of the real pages, resolved against the base."""
    path = extract.page_links(fx.pages_table(spark, sf_dir), "https://x.org/", pattern="^/")
    name = F.regexp_replace("url", "^https://x[.]org/", "")
    spellings = [
        F.concat(F.lit("/"), name), name, F.concat(F.lit("./"), name), F.concat(F.lit("../"), name),
        F.concat(F.lit("?q="), name), F.concat(F.lit("#"), name), F.concat(F.lit("//cdn.example.org/"), name),
        F.concat(F.lit("mailto:"), name), F.concat(F.lit("a//b/../"), name, F.lit("/.")), F.lit(""),
    ]
    hrefs = path.select("page_no", "link_no", F.posexplode(F.array(*spellings)).alias("spelling", "href"))
    return hrefs.select("page_no", "link_no", "spelling", urls.resolve(fx.BASE_URL, F.col("href")).alias("url"))


@query
def sanitize_filename(spark, sf_dir):
    """Whole documents as names, so that the length rule applies to most."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", urls.sanitize(F.col("text")).alias("name"))


# --- links ------------------------------------------------------------------------------

@query
def link_dedup(spark, sf_dir):
    return links.first_links(_page_links(spark, sf_dir))


@query
def link_dedup_pages(spark, sf_dir):
    """First sight of each link over the real pages."""
    return links.first_links(link_extract(spark, sf_dir))


@query
def new_links_per_page(spark, sf_dir):
    return links.new_links_per_page(_page_links(spark, sf_dir))


@query
def link_increment(spark, sf_dir):
    """Links of the listing that no response has been fetched for."""
    seen = fx.responses(spark, sf_dir).select("url")
    return links.unseen_links(_page_links(spark, sf_dir), seen).select("url", "page_no")


@query
def links_with_entries(spark, sf_dir):
    pages = written(fx.landed_pages(spark, sf_dir), "pages")
    first = links.first_links(extract.page_links(pages, fx.BASE_URL))
    return links.with_entries(first, catalogue.build_catalogue(pages, fx.BASE_URL).files)


# --- reports -----------------------------------------------------------------------------

@query
def summary(spark, sf_dir):
    return reports.summary(_accepted(spark, sf_dir))


@query
def summary_typed(spark, sf_dir):
    return reports.summary_by_detected_type(_accepted(spark, sf_dir))


@query
def summary_years(spark, sf_dir):
    return reports.summary_years(_accepted(spark, sf_dir))


@query
def summary_subjects(spark, sf_dir):
    return reports.summary_subjects(_accepted(spark, sf_dir))


@query
def validation_report(spark, sf_dir):
    return reports.validation_report(_catalogue(spark, sf_dir).files)


@query
def validation_gate(spark, sf_dir):
    return reports.validation_gate(reports.validation_report(_catalogue(spark, sf_dir).files))


@query
def validation_csv(spark, sf_dir):
    """The report through its CSV sink and back."""
    path = new_path(spark, "validation-csv")
    sinks.write_validation_report(reports.validation_report(_catalogue(spark, sf_dir).files), path)
    kinds = {"ID": "bigint", "Files_Count": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in fixed.VALIDATION_COLUMNS)
    read = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return read.fillna("")


# --- plan -------------------------------------------------------------------------------

@query
def download_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query
def target_path(spark, sf_dir):
    return download.with_target_path(_plan(spark, sf_dir)).select("id", "file_no", "target_path")


@query
def target_path_by_subject(spark, sf_dir):
    return download.with_target_path(_plan(spark, sf_dir), by_year=False).select("id", "file_no", "target_path")


@query
def file_layout(spark, sf_dir):
    """The plan written by year and subject, counted from the folders."""
    path = new_path(spark, "layout")
    sinks.write_by_year_and_subject(_plan(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("year").cast("string").alias("year"), "subject").agg(F.count("*").alias("n"))


@query
def plan_metadata_join(spark, sf_dir):
    pages = written(fx.landed_pages(spark, sf_dir), "pages")
    wanted = links.first_links(extract.page_links(pages, fx.BASE_URL)).select("url")
    plan = download.download_plan(catalogue.build_catalogue(pages, fx.BASE_URL).files)
    return download.with_metadata(wanted, plan)


def _placed_plan(spark, sf_dir) -> DataFrame:
    return written(download.with_target_path(_plan(spark, sf_dir)), "plan")


@query
def download_plan_incremental(spark, sf_dir):
    plan = _placed_plan(spark, sf_dir)
    there = fetch.landed_files(fx.landed_files(spark, sf_dir, plan))
    return download.not_landed(plan, there).select("id", "file_no", "url", "target_path")


@query
def download_plan_incremental_any(spark, sf_dir):
    """Also leaving out URLs that the fetch history holds under another suffix."""
    plan = _placed_plan(spark, sf_dir)
    there = fetch.landed_files(fx.landed_files(spark, sf_dir, plan))
    history = fetch.history_of(fetch.ingested(fx.responses(spark, sf_dir), plan))
    return download.not_landed(plan, there, match="any", history=history).select("id", "file_no", "url", "target_path")


# --- files -------------------------------------------------------------------------------

def _arrived(spark, sf_dir) -> DataFrame:
    """Responses with a body."""
    return fx.responses(spark, sf_dir).filter(F.col("error").isNull())


@query
def magic_type(spark, sf_dir):
    return _arrived(spark, sf_dir).select(
        "url", filetypes.magic_extension(F.col("content")).alias("ext"), filetypes.magic_mime(F.col("content")).alias("mime")
    )


@query
def content_type_ext(spark, sf_dir):
    return fx.responses(spark, sf_dir).select(
        "url", "attempt_no", filetypes.content_type_extension(F.col("content_type")).alias("ext")
    )


@query
def content_type_table(spark, sf_dir):
    """The same with the types given as a table."""
    types = spark.createDataFrame([("application/pdf", ".pdf"), ("Application/ZIP ; q=1", ".zip"), ("application/msword", ".doc")], "content_type string, extension string")
    found = filetypes.extensions_from_table(fx.responses(spark, sf_dir), types)
    return found.select("url", "attempt_no", F.col("header_extension").alias("ext"))


TEXTS_PER_FILE = 4096


@query
def text_files(spark, sf_dir):
    """Texts written as files of bounded size for each language and source, read back as binary files.

    Rows are dealt by runs of 131,072 as well, so a hot source is spread over tasks, more of
    them the larger the input; a file holds at most ``TEXTS_PER_FILE`` texts (2 GB, which
    binaryFile refuses, would take texts of 500 kB on average).
    """
    path = new_path(spark, "text-files")
    texts = fx.table(spark, sf_dir, "documents").select("text", "lang", "source", F.shiftright(F.monotonically_increasing_id(), 17).alias("part"))
    spread = texts.repartition("lang", "source", "part").drop("part")
    spread.write.option("maxRecordsPerFile", TEXTS_PER_FILE).partitionBy("lang", "source").text(path)
    files = fetch.landed_files(landed.read_files(spark, path, "*.txt"))
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    # the least size holds for the text as a whole, not for each of its files
    small = F.col("size") < fixed.MIN_FILE_BYTES
    return files.groupBy(part("lang"), part("source")).agg(
        F.sum("size").alias("size"), (F.bool_and(F.col("valid") | small) & (F.sum("size") >= fixed.MIN_FILE_BYTES)).alias("valid")
    )


@query
def verdicts_kept(spark, sf_dir):
    """Verdicts on all bodies as files, of which half were judged by an earlier run."""
    path = new_path(spark, "judged")
    bodies = _arrived(spark, sf_dir).select(
        F.concat(F.regexp_extract("url", r"(\d+)/download$", 1), filetypes.detected_extension(F.col("content_type"), F.col("content"))).alias("filepath"),
        "content",
    )
    odd = F.octet_length("content") % 2 == 1
    sinks.write_bodies(bodies.filter(~odd), path)
    earlier = written(fetch.kept_verdicts(landed.list_files(spark, path)), "verdicts")
    sinks.write_bodies(bodies.filter(odd), path)
    now = fetch.kept_verdicts(landed.list_files(spark, path), earlier)
    return now.select(F.substring_index("path", "/", -1).alias("filepath"), "size", "valid", "judged")


@query
def link_dedup_stored(spark, sf_dir):
    """First links of a table of links."""
    return links.first_stored_links(written(_page_links(spark, sf_dir), "links"))


@query
def landed_page_range(spark, sf_dir):
    """Links of all pages of a landed table, from the first to the last; the range reaches the scan."""
    path = new_path(spark, "landed-pages")
    fx.landed_pages(spark, sf_dir).write.parquet(path)
    pages = landed.read_pages(spark, path)
    last = pages.agg(F.max("page_no")).first()[0]
    return extract.page_links(catalogue.limit_pages(pages, last or 1), fx.BASE_URL)


@query
def page_files(spark, sf_dir):
    """The web pages as one HTML file each, written by the body sink, read back by number."""
    path = new_path(spark, "page-files")
    html = fx.pages_table(spark, sf_dir).filter(F.coalesce("html", F.lit("")) != "")
    sinks.write_bodies(html.select(F.concat(F.col("page_no").cast("string"), F.lit(".html")).alias("filepath"), F.encode("html", "UTF-8").alias("content")), path)
    pages = landed.read_page_files(spark, path, url_prefix="web/")
    return pages.select("page_no", "url", F.md5(F.encode("html", "UTF-8")).alias("digest"))


@query
def rejected_pages(spark, sf_dir):
    return extract.rejected_pages(fx.odd_pages(spark, sf_dir))


@query
def stored_bodies(spark, sf_dir):
    """Bodies of all successful responses in files at their paths, read back from there."""
    path = new_path(spark, "bodies")
    responses = fx.responses(spark, sf_dir)
    sinks.write_bodies(fetch.stored_bodies(responses, _fetched(spark, sf_dir)), path)
    files = landed.read_files(spark, path)
    inside = F.substring_index("path", path.rsplit("/", 1)[1] + "/", -1)
    return files.select(inside.alias("filepath"), F.col("length").alias("size"), F.md5("content").alias("digest"))


@query
def detected_ext(spark, sf_dir):
    return _arrived(spark, sf_dir).select(
        "url", filetypes.detected_extension(F.col("content_type"), F.col("content")).alias("ext")
    )


@query
def zip_test(spark, sf_dir):
    return _arrived(spark, sf_dir).select("url", filetypes.is_zip(F.col("content")).alias("is_zip"))


@query
def file_validate(spark, sf_dir):
    """Each body judged under every suffix that has a rule."""
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".zip", ".docx", ".odt", ".doc", ".bin", ".xls")])
    bodies = _arrived(spark, sf_dir).select("url", "content", F.explode(suffixes).alias("ext"))
    return bodies.select("url", "ext", filetypes.is_valid(F.col("ext"), F.col("content")).alias("valid"))


@query
def fetch_ingest(spark, sf_dir):
    fetched = _fetched(spark, sf_dir)
    return fetched.select("url", "attempt_no", "extension", "size", "target_path", "filepath", "outcome")


@query
def target_renamed(spark, sf_dir):
    return _fetched(spark, sf_dir).filter(F.col("outcome") != "error").select("url", "target_path", "filepath")


@query
def target_conflicts(spark, sf_dir):
    """Paths after a fetch into a folder that holds files already."""
    plan = _placed_plan(spark, sf_dir)
    there = fetch.landed_files(fx.landed_files(spark, sf_dir, plan))
    return fetch.placements(fetch.ingested(fx.responses(spark, sf_dir), plan, there))


@query
def fetch_outcomes_incremental(spark, sf_dir):
    """Outcome of each response in a folder that holds files already."""
    plan = _placed_plan(spark, sf_dir)
    there = fetch.landed_files(fx.landed_files(spark, sf_dir, plan))
    fetched = fetch.ingested(fx.responses(spark, sf_dir), plan, there)
    return fetched.select("url", "attempt_no", "filepath", "outcome")


@query
def batch_outcome(spark, sf_dir):
    return fetch.outcomes(_fetched(spark, sf_dir))


@query
def download_history(spark, sf_dir):
    """The history through its JSON sink and back."""
    path = new_path(spark, "history")
    sinks.write_history(fetch.history_of(_fetched(spark, sf_dir)), path)
    schema = "url string, filepath string, size bigint, metadata struct<year:string, subject:string>"
    read = spark.read.schema(schema).json(path)
    return read.select("url", "filepath", "size", "metadata.year", "metadata.subject")


@query
def failed_downloads(spark, sf_dir):
    path = new_path(spark, "failures")
    sinks.write_failures(fetch.failures_of(_fetched(spark, sf_dir)), path)
    return sinks.read_failures(spark, path).select("url", "error")


@query
def fetch_stats(spark, sf_dir):
    fetched = written(_fetched(spark, sf_dir), "fetched")
    return reports.fetch_statistics(fetch.history_of(fetched), fetch.failures_of(fetched))


def _archives(spark, sf_dir) -> DataFrame:
    """One archive for each document with its text and language; Spanish ones are cut short."""

    def packed(doc_id, text, lang):
        import io
        import zipfile

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("text.txt", text)
            archive.writestr("about/lang.txt", lang)
        body = held.getvalue()
        return (f"in/{doc_id}.zip", body[:-30] if lang == "es" else body), len(body)

    def pack(batches):
        import pyarrow as pa

        rows = (packed(*[value.as_py() for value in row]) for batch in batches for row in zip(*batch.columns))
        return archives.in_batches(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return documents.mapInArrow(pack, "path string, content binary")


@query
def zip_members(spark, sf_dir):
    found = archives.members(archives.unpack(_archives(spark, sf_dir)))
    return found.select("archive_path", "member_path", "size", F.md5("content").alias("digest"))


@query
def zip_rejects(spark, sf_dir):
    return archives.rejected_archives(archives.unpack(_archives(spark, sf_dir))).select("archive_path")


# --- streams -----------------------------------------------------------------------------

def _finish(stream) -> None:
    stream.awaitTermination()


def _landing_folder(spark, df: DataFrame, label: str) -> str:
    """The rows in files for a stream to find: one for each core, or fewer, so batches get larger and not more with the input."""
    path = new_path(spark, label)
    df.coalesce(spark.sparkContext.defaultParallelism).write.parquet(path)
    return path


@query
def stream_links(spark, sf_dir):
    folder = _landing_folder(spark, fx.landed_pages(spark, sf_dir), "landing")
    output, checkpoint = new_path(spark, "stream-links"), new_path(spark, "stream-state")
    pages = landing.stream_pages(spark, folder, files_per_batch=4)
    _finish(landing.start_new_links(pages, fx.BASE_URL, output, checkpoint))
    return spark.read.parquet(output).select("url")


@query
def stream_distinct(spark, sf_dir):
    folder = _landing_folder(spark, fx.landed_pages(spark, sf_dir), "landing")
    output, checkpoint = new_path(spark, "stream-distinct"), new_path(spark, "stream-state")
    _finish(landing.start_distinct_values(landing.stream_pages(spark, folder, files_per_batch=4), output, checkpoint))
    return landing.latest_distinct_values(spark, output)


@query
def stream_stats(spark, sf_dir):
    folder = _landing_folder(spark, fx.responses(spark, sf_dir), "landing")
    output, checkpoint = new_path(spark, "stream-stats"), new_path(spark, "stream-state")
    _finish(landing.start_statistics(landing.stream_responses(spark, folder), output, checkpoint))
    return landing.latest_statistics(spark, output)


@query
def stream_page_by_page(spark, sf_dir):
    """Entries, links and laid-out files written batch by batch.

    Batches hold pages in any order, so ids differ from run to run: they are counted,
    and what an entry holds is compared without its id.
    """
    folder = _landing_folder(spark, fx.landed_pages(spark, sf_dir), "landing")
    output, checkpoint = new_path(spark, "page-by-page"), new_path(spark, "stream-state")
    _finish(landing.start_page_by_page(landing.stream_pages(spark, folder, files_per_batch=4), fx.BASE_URL, output, checkpoint))
    written_files = spark.read.parquet(f"{output}/files")
    ids = written_files.select(F.lit("entry").alias("kind"), F.col("id").cast("string").alias("key")).distinct()
    held = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("file_no", *catalogue.CODES, "files_count", "filename", "download_url", "file_id", "year")])
    files = written_files.select(F.lit("file").alias("kind"), held.alias("key"))
    found = spark.read.parquet(f"{output}/links").select(F.lit("link").alias("kind"), F.col("url").alias("key"))
    laid = spark.read.parquet(f"{output}/layout").select(F.lit("laid").alias("kind"), F.concat_ws(" ", F.col("year").cast("string"), "subject", "url").alias("key"))
    return ids.unionByName(files).unionByName(found).unionByName(laid)
