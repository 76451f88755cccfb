"""The registered queries in SQL for DuckDB, written independently of the engine.

DuckDB's word bounds are ASCII, so Unicode bounds are spelled out. HTML is never
parsed here except for the plain links of the real pages: the listing pages are
rendered from ``LISTING_ROWS``, which therefore is their expected content.
"""

from __future__ import annotations

from folioscan.workload.fixtures import BASE_URL, LINK_NAMES, LISTING_ROWS, ORIGIN, TAILS

_EDGE = r"[^\p{L}\p{N}_]"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def _word(pattern: str) -> str:
    return f"(^|{_EDGE})({pattern})($|{_EDGE})"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _case(text: str, branches: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test.replace('@', text)} THEN '{code}'" for test, code in branches) + " END"


def _has_word(pattern: str) -> str:
    return _has("@", _word(pattern))


def _folded(label: str) -> str:
    return f"lower(trim({label}, {_BLANKS}))"


def _session_kind(label: str) -> str:
    return _case(_folded(label), [(_has_word("normale?|normales"), "NORMAL"), (_has_word("remplacement|septembre"), "REMPLACEMENT")])


def _session_code(label: str) -> str:
    text = _folded(label)
    year = (
        f"coalesce(nullif(regexp_extract({text}, '{_word('20[0-9][0-9]')}', 2), ''),"
        rf" '20' || nullif(regexp_extract({text}, '^\p{{Nd}}\p{{Nd}}'), ''))"
    )
    return f"{year} || '_' || {_session_kind(label)}"


def _serie(label: str) -> str:
    return _case(
        _folded(label),
        [
            (_has_word("générale|generale|gen"), "GENERALE"),
            (_has_word("professionnelle|professionnel|pro"), "PROFESSIONNELLE"),
            (_has_word("toutes"), "TOUTES"),
        ],
    )


def _discipline(label: str) -> str:
    french = _has_word("fran[çc]ais")
    tongues = "allemand anglais arabe chinois espagnol grec hébreu italien japonais portugais russe turc".split()
    return _case(
        _folded(label),
        [
            ("contains(@, 'fran') AND contains(@, 'dict')", "FR_DICTEE"),
            (f"{french} AND {_has_word('grammaire|compr[ée]hension|questions?')}", "FR_GRAM_COMP"),
            (f"{french} AND {_has_word('r[ée]daction')}", "FR_REDACTION"),
            (f"({_has('@', 'histoire|histore|g[ée]ographie')} OR {_has_word('emc')})", "HIST_GEO_EMC"),
            *[(_has_word(t.replace("é", "[ée]")), "LV_" + t.upper().replace("É", "E")) for t in tongues],
            (_has_word("maths?|math[ée]matiques"), "MATHS"),
            (f"({_has('@', 'physique|chimie|technologie')} OR {_has_word('sciences?|svt')})", "SCIENCES"),
        ],
    )


def _location(label: str) -> str:
    text = rf"regexp_replace({_folded(label)}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')"
    return _case(
        text,
        [
            (_has("@", "am[ée]rique du nord"), "AM_NORTH"),
            (_has("@", "am[ée]rique du sud"), "AM_SOUTH"),
            (_has("@", "antilles ?,? ?guyane"), "ANTIL_GUY"),
            (_has("@", "m[ée]tropole et antilles[- ]guyane"), "METRO_ANTIL_GUY"),
            (_has("@", "m[ée]tropole"), "METROPOLE"),
            (_has("@", "nouvelle[- ]cal[ée]donie"), "NOUVELLE_CAL"),
            (_has("@", "polyn[ée]sie"), "POLYNESIE"),
            (_has("@", "pondich[ée]ry"), "PONDICHERY"),
            (_has_word("groupe ?1"), "GROUPE_1"),
            (_has_word("liban"), "LIBAN"),
            (_has_word("asie"), "ASIA"),
        ],
    )


def _year_in(text: str) -> str:
    return rf"nullif(regexp_extract({text}, '(^|{_EDGE})(20[0-2]\p{{Nd}})($|{_EDGE})', 2), '')"


def _lead_year(name: str) -> str:
    return rf"'20' || nullif(regexp_extract({name}, '^\p{{Nd}}\p{{Nd}}'), '')"


def _suffix(name: str) -> str:
    return rf"nullif(regexp_extract(regexp_replace({name}, '(/\.?)+$', ''), '[^/](\.[^./]+)$', 1), '')"


def _link_name(url: str, attribute: str) -> str:
    from_url = f"CASE WHEN contains({url}, '/') THEN split_part(list_last(string_split({url}, '/')), '?', 1) ELSE {url} END"
    return f"CASE WHEN coalesce({attribute}, '') = '' THEN {from_url} ELSE split_part({attribute}, '|', 1) END"


_SUBJECTS = [
    ("mathematiques|maths", "Mathématiques"),
    ("francais", "Français"),
    ("histoire|geographie", "Histoire-Géographie"),
    ("sciences", "Sciences"),
    ("svt", "Sciences (SVT)"),
    ("physique|chimie", "Sciences (Physique-Chimie)"),
    ("technologie", "Sciences (Technologie)"),
    ("anglais", "Anglais LV1"),
    ("allemand", "Allemand LV1"),
    ("espagnol", "Espagnol LV1"),
    ("italien", "Italien LV1"),
    ("hist(oire)?[-_]?geo(graphie)?", "Histoire-Géographie"),
    ("phys(ique)?[-_]?chim(ie)?", "Sciences (Physique-Chimie)"),
]
_SUBJECT = _case("text", [(_has_word(words), subject) for words, subject in _SUBJECTS])
_SESSION_WORD = _case("text", [(_has_word(w), w) for w in ("normale", "remplacement", "septembre", "juin")])
_CORRECTION = "regexp_matches(text, 'corrig|correction|reponses|solutions|answer|key')"
_SERIES_WORD = f"CASE WHEN {_has('text', _word('pro|professionnelle'))} THEN 'professionnelle' ELSE 'generale' END"


# --- relations shared by the checks: name -> (SQL, names it needs) ---------------------

_RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "rows_fx": (LISTING_ROWS.replace("{orders}", "orders"), ()),
    "names_fx": (LINK_NAMES.replace("{orders}", "orders"), ()),
    "cell_links": (
        """SELECT * EXCLUDE (href, data_name, href2, data_name2), 1 AS file_no, href, data_name FROM rows_fx WHERE href LIKE '/document/%'
           UNION ALL
           SELECT * EXCLUDE (href, data_name, href2, data_name2), 2, href2, data_name2 FROM rows_fx WHERE href2 IS NOT NULL""",
        ("rows_fx",),
    ),
    "page_links": (
        f"""SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY row_no, file_no) AS link_no,
                   '{ORIGIN}' || href AS url, data_name FROM cell_links""",
        ("cell_links",),
    ),
    "first_links": (
        """SELECT url, page_no, link_no, data_name FROM page_links
           QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_no, link_no) = 1""",
        ("page_links",),
    ),
    "coded": (
        f"""SELECT *, {_session_kind('session_txt')} AS session, {_discipline('discipline_txt')} AS discipline,
                   {_serie('serie_txt')} AS serie, {_location('localisation_txt')} AS localisation FROM rows_fx""",
        ("rows_fx",),
    ),
    "entries": (
        """SELECT *, row_number() OVER (ORDER BY page_no, row_no) AS id,
                  CASE WHEN href2 IS NULL THEN 1 ELSE 2 END AS files_count
           FROM coded WHERE session IS NOT NULL AND discipline IS NOT NULL AND serie IS NOT NULL AND localisation IS NOT NULL
             AND href LIKE '/document/%'""",
        ("coded",),
    ),
    "named": (
        f"""SELECT e.id, c.page_no, c.row_no, CAST(c.file_no AS BIGINT) AS file_no, e.session, e.discipline, e.serie, e.localisation,
                   e.files_count, {_link_name('c.href', 'c.data_name')} AS filename, '{ORIGIN}' || c.href AS download_url,
                   c.href, split_part(c.href, '/', 3) AS file_id, c.session_txt
            FROM entries e JOIN cell_links c USING (row_key)""",
        ("entries", "cell_links"),
    ),
    "files": (
        f"""SELECT *, id || '_' || session || '_' || discipline || '_' || serie || '_' || localisation || '_' || file_id
                      AS filename_for_save,
                   coalesce({_lead_year('filename')}, {_year_in("lower(href || ' ' || filename)")},
                            nullif(regexp_extract(session_txt, '^[0-9]{{4}}'), '')) AS year
            FROM named""",
        ("named",),
    ),
    "plan": (
        f"""SELECT id, file_no, download_url AS url, filename_for_save || lower(coalesce({_suffix('filename')}, '.pdf')) AS filename,
                   file_id, coalesce(nullif(year, ''), {_lead_year('filename')}) AS year, discipline AS subject, session,
                   serie AS series, false AS is_correction, 'sujet' AS document_type
            FROM files""",
        ("files",),
    ),
    "placed": ("SELECT *, concat_ws('/', year, subject, filename) AS target_path FROM plan", ("plan",)),
    "plan_by_url": (
        "SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC, file_no DESC) = 1",
        ("plan",),
    ),
    "landed": (
        """SELECT path, CASE WHEN ends_with(path, '.pdf') THEN size >= 1024 WHEN ends_with(path, '.doc') THEN size > 1000
                             WHEN regexp_matches(path, '[.](zip|docx)$') THEN false ELSE size >= 100 END AS valid
           FROM (SELECT CASE WHEN lang = 'fr' THEN target_path ELSE regexp_replace(target_path, '[.][^./]+$', '') || '.doc' END AS path,
                        4 + octet_length(encode(text)) AS size
                 FROM placed JOIN documents ON id = doc_id)""",
        ("placed",),
    ),
    "texts": (
        f"""SELECT *, lower(url_decode(url) || ' ' || url_decode(name)) AS text
            FROM (SELECT *, {_link_name('url', 'data_name')} AS name FROM names_fx)""",
        ("names_fx",),
    ),
    "parsed": (
        f"""SELECT row_key, url, name AS filename,
                   CASE WHEN contains(data_name, '|') THEN split_part(data_name, '|', 2) END AS file_id,
                   coalesce({_lead_year('url_decode(name)')}, {_year_in('text')}) AS year,
                   {_SUBJECT} AS subject, {_SESSION_WORD} AS session, {_SERIES_WORD} AS series, {_CORRECTION} AS is_correction,
                   CASE WHEN {_CORRECTION} THEN 'correction' ELSE 'sujet' END AS document_type
            FROM texts""",
        ("texts",),
    ),
    # responses without their bodies: kind of head, kind of tail and length tell all
    "bodies": (
        f"""SELECT *, '{ORIGIN}/document/' || (50000 + doc_id) || '/download' AS url,
                   list_extract(['.pdf', '.zip', NULL, NULL, NULL, '.doc'], doc_id % 6 + 1) AS header_ext,
                   list_extract(['.pdf', '.zip', '.doc', '.rtf', '.bin'], doc_id % 5 + 1) AS magic_ext,
                   list_extract([4, 4, 8, 5, 0], doc_id % 5 + 1) + octet_length(encode(text))
                     + CASE WHEN doc_id % 5 <> 1 THEN 0 WHEN lang = 'fr' THEN 22 WHEN lang = 'en' THEN 25 ELSE 0 END AS size,
                   doc_id % 5 = 1 AND lang IN ('fr', 'en') AS is_zip, doc_id % 5 = 0 AS is_pdf, doc_id % 23 = 0 AS failing
            FROM (SELECT * REPLACE (CASE WHEN doc_id % 31 = 3 THEN substr(text, 1, 40) ELSE text END AS text) FROM documents)""",
        (),
    ),
    "fetched": (
        """SELECT b.url, a.attempt_no, CASE WHEN b.failing THEN coalesce(header_ext, '.bin') ELSE coalesce(header_ext, magic_ext) END AS extension,
                  CASE WHEN NOT b.failing THEN b.size END AS size, b.failing,
                  coalesce(p.year, CASE WHEN p.url IS NULL AND doc_id + 50000 BETWEEN 2000 AND 2029 THEN CAST(doc_id + 50000 AS VARCHAR) END) AS year,
                  p.subject, coalesce(p.filename, 'download') AS filename,
                  b.is_zip, b.is_pdf
           FROM bodies b JOIN (VALUES (false, 1), (true, 1), (true, 2), (true, 3)) a(failing, attempt_no) ON a.failing = b.failing
           LEFT JOIN plan_by_url p ON p.url = b.url""",
        ("bodies", "plan_by_url"),
    ),
    "ingested": (
        """SELECT *, CASE WHEN failing THEN 'error' WHEN NOT valid THEN 'invalid'
                          WHEN row_number() OVER (PARTITION BY filepath, failing, valid ORDER BY url, attempt_no) = 1 THEN 'successful'
                          ELSE 'discarded' END AS outcome
           FROM arrived""",
        ("arrived",),
    ),
    # the same into a folder with files: what lies at the planned path is kept, and at the new path of a renamed file as well
    "refetched": (
        """SELECT *, CASE WHEN state = 'open' AND row_number() OVER (PARTITION BY filepath, state ORDER BY url, attempt_no) > 1 THEN 'discarded'
                          WHEN state = 'open' THEN 'successful' ELSE state END AS outcome
           FROM (SELECT a.*, f.valid AS at_final,
                        CASE WHEN failing THEN 'error' WHEN t.valid THEN 'skipped'
                             WHEN a.filepath <> a.target_path AND f.path IS NOT NULL THEN 'discarded'
                             WHEN a.valid THEN 'open' ELSE 'invalid' END AS state
                 FROM arrived a
                 LEFT JOIN (SELECT path, bool_or(valid) AS valid FROM landed GROUP BY path) t ON t.path = a.target_path
                 LEFT JOIN (SELECT path, bool_or(valid) AS valid FROM landed GROUP BY path) f ON f.path = a.filepath)""",
        ("arrived", "landed"),
    ),
    "arrived": (
        f"""SELECT *, CASE WHEN lower(coalesce({_suffix('target_path')}, '')) = extension THEN target_path
                           ELSE regexp_replace(target_path, '([^/])[.][^./]+$', '\\1') || extension END AS filepath
            FROM (SELECT *, concat_ws('/', year, subject, filename) AS target_path,
                         CASE WHEN size < 100 THEN false WHEN extension = '.pdf' THEN is_pdf AND size >= 1024
                              WHEN extension = '.zip' THEN is_zip WHEN extension = '.doc' THEN size > 1000
                              WHEN extension = '.bin' THEN size > 100 ELSE true END AS valid
                  FROM fetched)""",
        ("fetched",),
    ),
    "real_links": (
        """SELECT page_id AS page_no, url AS page_url, i AS link_no, regexp_replace(hrefs[i], '&amp;', '&', 'g') AS href
           FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS hrefs FROM pages),
                unnest(range(1, len(hrefs) + 1)) AS t(i)""",
        (),
    ),
}


def _with(query: str, *needed: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        sql, needs = _RELATIONS[name]
        for other in needs:
            add(other)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({_RELATIONS[name][0]})" for name in order) + "\n" + query


_FILE_COLUMNS = (
    "id, file_no, session, discipline, serie, localisation, files_count, filename, download_url, file_id, filename_for_save, year"
)
_NAME_YEAR = f"coalesce({_lead_year('filename')}, {_year_in(chr(39) + ' ' + chr(39) + ' || lower(filename)')})"


def _summary(kind: str) -> str:
    return f"""
    SELECT 'total' AS metric, '' AS key, count(*) AS n FROM files
    UNION ALL SELECT 'by_year', y, count(*) FROM (SELECT {_NAME_YEAR} AS y FROM files) WHERE y IS NOT NULL GROUP BY y
    UNION ALL SELECT 'by_subject', discipline, count(*) FROM files GROUP BY discipline
    UNION ALL SELECT 'by_type', t, (SELECT count(*) FROM files WHERE {kind} = t) FROM (VALUES ('sujet'), ('correction')) v(t)"""


_REPORT = """SELECT id AS "ID", file_id AS "IDFile", session AS "Session", discipline AS "Discipline", serie AS "Serie",
    localisation AS "Localisation", files_count AS "Files_Count",
    CASE WHEN file_id <> '' AND filename <> '' AND filename_for_save <> '' AND download_url <> '' THEN 'OK' ELSE 'MISSING' END AS "Status",
    filename AS "FileName", filename_for_save AS "FileNameToSave", download_url AS "Link" FROM files"""

_LABELS = (("Session", "session_txt"), ("Discipline", "discipline_txt"), ("Serie", "serie_txt"), ("Localisation", "localisation_txt"))

_SANITIZE_SINGLE = (
    r"""trim(regexp_replace(regexp_replace(text, '[<>:"/\\|?*]', '_', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}_]+', '_', 'g'), '_ ')"""
)


def _byte_steps() -> str:
    value = "CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN k * k WHEN k % 4 = 2 THEN k * k * k * 17 ELSE k * k * k * k END"
    branches = " ".join(
        f"WHEN size < {1024 ** (p + 1)} THEN printf('%.2f {unit}', size / {1024 ** p}.0)" for p, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
    )
    return (
        f"SELECT k AS row_key, CASE {branches} ELSE printf('%.2f PB', size / {1024 ** 5}.0) END AS shown FROM "
        f"(SELECT k, CAST({value} AS DOUBLE) AS size FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders))"
    )


_RESOLVED = f"""
SELECT page_no, link_no, CAST(s AS INTEGER) AS spelling,
  CASE s WHEN 0 THEN '{ORIGIN}/' || x WHEN 1 THEN '{ORIGIN}/archive/' || x WHEN 2 THEN '{ORIGIN}/archive/' || x WHEN 3 THEN '{ORIGIN}/' || x
         WHEN 4 THEN '{BASE_URL}?q=' || x WHEN 5 THEN '{BASE_URL}#' || x WHEN 6 THEN 'https://cdn.example.org/' || x
         WHEN 7 THEN 'mailto:' || x WHEN 8 THEN '{ORIGIN}/archive/a/' || x || '/' ELSE '{BASE_URL}' END AS url
FROM (SELECT page_no, link_no, substr(href, 2) AS x FROM real_links), unnest(range(0, 10)) AS t(s)"""

_PLACED = """
SELECT filepath, arg_min(url, (CASE WHEN outcome = 'successful' THEN '0' ELSE '1' END) || url) AS url, count(*) AS responses,
  CASE WHEN bool_or(outcome = 'successful') THEN 'stored'
       WHEN bool_or(outcome = 'skipped' OR (outcome = 'discarded' AND coalesce(at_final, false))) THEN 'kept_existing' ELSE 'nothing' END AS placement
FROM refetched WHERE outcome <> 'error' GROUP BY filepath"""

_NEXT = f"""
SELECT page_no, '{BASE_URL}?page=' || page_no AS url,
       CASE WHEN page_no < (SELECT max(page_no) FROM rows_fx) THEN '{BASE_URL}?page=' || (page_no + 1) END AS next_url
FROM (SELECT DISTINCT page_no FROM rows_fx)"""

_CHAIN = f"""
RECURSIVE rows_fx AS ({LISTING_ROWS.replace('{orders}', 'orders')}),
edges AS ({_NEXT}),
walk AS (
  SELECT url AS start_url, CAST(1 AS BIGINT) AS page_no, url FROM edges WHERE page_no = (SELECT min(page_no) FROM edges)
  UNION ALL
  SELECT w.start_url, w.page_no + 1, e.next_url FROM walk w JOIN edges e ON e.url = w.url
  WHERE e.next_url IS NOT NULL)
SELECT start_url, page_no, url FROM walk"""

_FALLBACKS = f"""
SELECT page_no, '{BASE_URL}?page=' || page_no AS url,
       CASE WHEN page_no % 41 IN (17, 29) THEN NULL
            WHEN page_no % 3 = 0 THEN '{ORIGIN}/archive/list?page=' || (page_no + 1)
            ELSE '{BASE_URL}?page=' || CASE WHEN page_no = max(page_no) OVER () THEN 3 ELSE page_no + 1 END END AS next_url
FROM (SELECT DISTINCT page_no FROM rows_fx)"""

_LOOPS = f"""
RECURSIVE rows_fx AS ({LISTING_ROWS.replace('{orders}', 'orders')}),
edges AS ({_FALLBACKS}),
walk AS (
  SELECT url AS start_url, CAST(1 AS BIGINT) AS page_no, url, [url] AS passed FROM edges WHERE page_no % 100 = 0 OR page_no = 1
  UNION ALL
  SELECT w.start_url, w.page_no + 1, e.next_url, list_append(w.passed, e.next_url) FROM walk w JOIN edges e ON e.url = w.url
  WHERE EXISTS (SELECT 1 FROM edges n WHERE n.url = e.next_url) AND NOT list_contains(w.passed, e.next_url))
SELECT start_url, page_no, url FROM walk"""

_STATS = """
SELECT 'total_downloads' AS metric, '' AS key, count(*) AS n FROM good
UNION ALL SELECT 'total_failures', '', count(*) FROM ingested WHERE outcome = 'error'
UNION ALL SELECT 'total_size', '', CAST(coalesce(sum(size), 0) AS BIGINT) FROM good
UNION ALL SELECT 'total_size_formatted',
  CASE WHEN sum(size) < 1024 THEN printf('%.2f B', sum(size) / 1.0) WHEN sum(size) < 1048576 THEN printf('%.2f KB', sum(size) / 1024.0)
       WHEN sum(size) < 1073741824 THEN printf('%.2f MB', sum(size) / 1048576.0) ELSE printf('%.2f GB', sum(size) / 1073741824.0) END,
  CAST(sum(size) AS BIGINT) FROM good
UNION ALL SELECT 'by_year', year, count(*) FROM good WHERE year IS NOT NULL GROUP BY year
UNION ALL SELECT 'by_subject', subject, count(*) FROM good WHERE subject IS NOT NULL GROUP BY subject
UNION ALL SELECT 'by_file_type', extension, count(*) FROM good GROUP BY extension"""

_ZIP_OK = "lang <> 'es'"

ORACLES: dict[str, str] = {
    # extraction
    "link_extract": _with(f"SELECT page_no, link_no, '{ORIGIN}' || href AS url, '' AS data_name FROM real_links", "real_links"),
    "link_extract_own_base": _with(
        "SELECT page_no, link_no, regexp_extract(page_url, '^https?://[^/?#]*') || href AS url FROM real_links", "real_links"
    ),
    "link_extract_fx": _with("SELECT page_no, link_no, url, data_name FROM page_links", "page_links"),
    "listing_rows": _with(
        """SELECT page_no, row_no, session_txt, discipline_txt, serie_txt, localisation_txt,
                  CASE WHEN href2 IS NULL THEN 2 ELSE 3 END AS n_links, href, data_name FROM rows_fx""",
        "rows_fx",
    ),
    "listing_rows_udtf": _with("SELECT page_no, row_no, session_txt, discipline_txt, serie_txt, localisation_txt FROM rows_fx", "rows_fx"),
    "distinct_values": _with(
        " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS field, {column} AS value FROM rows_fx" for name, column in _LABELS)
        + f""" UNION ALL SELECT DISTINCT 'TypeDocument', CASE WHEN {_CORRECTION} THEN 'correction' ELSE 'sujet' END
              FROM (SELECT lower(href || ' ' || {_link_name('href', 'data_name')}) AS text FROM rows_fx)""",
        "rows_fx",
    ),
    "next_pages": _with(_NEXT, "rows_fx"),
    "page_chain": "WITH " + _CHAIN,
    "next_pages_fallbacks": _with(_FALLBACKS, "rows_fx"),
    "page_chain_loops": "WITH " + _LOOPS,
    "page_limit": _with("SELECT page_no, count(*) AS n FROM rows_fx WHERE page_no <= 7 GROUP BY page_no", "rows_fx"),
    # catalogue
    "exam_entries": _with("SELECT id, session, discipline, serie, localisation, files_count FROM entries", "entries"),
    "exam_files": _with(f"SELECT {_FILE_COLUMNS} FROM files", "files"),
    "exam_entries_nested": _with(
        "SELECT id, CAST(count(*) AS INTEGER) AS n, string_agg(filename, '/' ORDER BY file_no) AS names FROM files GROUP BY id", "files"
    ),
    "rejected_rows": _with(
        " UNION ALL ".join(f"SELECT page_no, row_no, '{c}' AS field FROM coded WHERE {c} IS NULL" for c in ("session", "discipline", "serie", "localisation"))
        + " UNION ALL SELECT page_no, row_no, 'files' FROM coded WHERE href NOT LIKE '/document/%'",
        "coded",
    ),
    "files_by_year": _with("SELECT page_no, row_no, file_no, year, download_url FROM files WHERE year = '2024'", "files"),
    # labels
    "norm_session": _with(f"SELECT row_key, {_session_code('session_txt')} AS code, {_session_kind('session_txt')} AS kind FROM rows_fx", "rows_fx"),
    "norm_discipline": _with(f"SELECT row_key, {_discipline('discipline_txt')} AS code FROM rows_fx", "rows_fx"),
    "norm_serie": _with(f"SELECT row_key, {_serie('serie_txt')} AS code FROM rows_fx", "rows_fx"),
    "norm_localisation": _with(f"SELECT row_key, {_location('localisation_txt')} AS code FROM rows_fx", "rows_fx"),
    "norm_whole_texts": f"""SELECT doc_id, {_session_code('text')} AS session, {_discipline('text')} AS discipline,
                                   {_serie('text')} AS serie, {_location('text')} AS localisation FROM documents""",
    "sql_label_functions": _with(
        f"""SELECT row_key, {_session_code('session_txt')} AS session_code, session, discipline, serie, localisation FROM coded""", "coded"
    ),
    # metadata
    "parse_metadata": _with(
        "SELECT row_key, url, filename, file_id, year, subject, session, series, is_correction, document_type FROM parsed", "parsed"
    ),
    "parse_year": _with("SELECT row_key, year FROM parsed", "parsed"),
    "file_year": _with(f"SELECT row_key, {_lead_year('name')} AS year FROM texts", "texts"),
    "parse_subject": _with("SELECT row_key, subject FROM parsed", "parsed"),
    "parse_subject_dim": _with("SELECT row_key, subject FROM parsed", "parsed"),
    "parse_session": _with("SELECT row_key, session FROM parsed", "parsed"),
    "parse_series": _with("SELECT row_key, series FROM parsed", "parsed"),
    "parse_correction": _with("SELECT row_key, is_correction, document_type FROM parsed", "parsed"),
    "organized_name": _with(
        """SELECT row_key, built, CASE WHEN filename <> '' THEN filename ELSE built END AS name FROM (
             SELECT row_key, filename, translate(concat_ws('_', year, replace(replace(subject, ' ', '_'), '/', '_'), session, series,
                    document_type, nullif(file_id, '')) || '.pdf', 'éèàô', 'eeao') AS built FROM parsed)""",
        "parsed",
    ),
    "format_bytes": _byte_steps(),
    "file_extension": _with(
        rf"""SELECT row_key, lower(coalesce({_suffix('name')}, by_url)) AS by_name, by_url FROM (
              SELECT row_key, name, lower(coalesce({_suffix("url_decode(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1))")}, '.pdf')) AS by_url
              FROM texts)""",
        "texts",
    ),
    "url_filename": _with(
        r"""SELECT row_key, CASE WHEN contains(url, '/') THEN split_part(list_last(string_split(url, '/')), '?', 1) ELSE url END AS raw,
                   CASE WHEN contains(seg, '.') THEN trim(regexp_replace(regexp_replace(seg, '[<>:"/\\|?*]', '_', 'g'), '[\s_]+', '_', 'g'), '_ ')
                        ELSE 'downloaded_file.pdf' END AS safe
            FROM (SELECT row_key, url, url_decode(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1)) AS seg FROM names_fx)""",
        "names_fx",
    ),
    "url_resolve": _with(_RESOLVED, "real_links"),
    "sanitize_filename": f"""
        SELECT doc_id, CASE WHEN length(n) <= 255 THEN n
                            WHEN NOT contains(n, '.') THEN substr(n, 1, 255)
                            WHEN ext = '' THEN substr(stem, 1, 255)
                            WHEN length(ext) <= 254 THEN substr(stem, 1, 254 - length(ext)) || '.' || ext
                            ELSE substr(stem, 1, greatest(length(stem) + 254 - length(ext), 0)) || '.' || ext END AS name
        FROM (SELECT doc_id, n, list_last(string_split(n, '.')) AS ext,
                     substr(n, 1, length(n) - length(list_last(string_split(n, '.'))) - 1) AS stem
              FROM (SELECT doc_id, {_SANITIZE_SINGLE} AS n FROM documents))""",
    # links
    "link_dedup": _with("SELECT url, page_no, link_no, data_name FROM first_links", "first_links"),
    "link_dedup_pages": _with(
        f"""SELECT '{ORIGIN}' || href AS url, page_no, link_no, '' AS data_name FROM real_links
            QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_no, link_no) = 1""",
        "real_links",
    ),
    "new_links_per_page": _with("SELECT page_no, count(*) AS new_links FROM first_links GROUP BY page_no", "first_links"),
    "link_increment": _with(
        "SELECT url, page_no FROM first_links WHERE url NOT IN (SELECT url FROM bodies)", "first_links", "bodies"
    ),
    "links_with_entries": _with(
        """SELECT l.url, l.page_no, l.link_no, l.data_name, f.id, f.file_no, f.session, f.discipline, f.serie, f.localisation,
                  f.filename, f.filename_for_save
           FROM first_links l LEFT JOIN (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY download_url ORDER BY id, file_no) = 1) f
             ON f.download_url = l.url""",
        "first_links", "files",
    ),
    # reports
    "summary": _with(_summary("'sujet'"), "files"),
    "summary_typed": _with(
        _summary("(CASE WHEN regexp_matches(lower(download_url || ' ' || filename), 'corrig|correction|reponses|solutions|answer|key') THEN 'correction' ELSE 'sujet' END)"),
        "files",
    ),
    "summary_years": _with(f"SELECT DISTINCT y AS year FROM (SELECT {_NAME_YEAR} AS y FROM files) WHERE y IS NOT NULL", "files"),
    "summary_subjects": _with("SELECT DISTINCT discipline AS subject FROM files", "files"),
    "validation_report": _with(_REPORT, "files"),
    "validation_gate": _with(
        """SELECT count(*) AS files, count(*) FILTER ("Status" = 'MISSING') AS missing,
                  count(*) FILTER ("Status" = 'MISSING') = 0 AS passed FROM (""" + _REPORT + ")",
        "files",
    ),
    "validation_csv": _with(_REPORT, "files"),
    # plan
    "download_plan": _with("SELECT * FROM plan", "plan"),
    "target_path": _with("SELECT id, file_no, target_path FROM placed", "placed"),
    "target_path_by_subject": _with("SELECT id, file_no, subject || '/' || filename AS target_path FROM plan", "plan"),
    "file_layout": _with("SELECT year, subject, count(*) AS n FROM plan GROUP BY year, subject", "plan"),
    "plan_metadata_join": _with(
        """SELECT l.url, coalesce(p.filename, 'download') AS filename, p.file_id, p.year, p.subject, p.session,
                  coalesce(p.series, 'generale') AS series, false AS is_correction, 'sujet' AS document_type
           FROM first_links l LEFT JOIN plan_by_url p USING (url)""",
        "first_links", "plan_by_url",
    ),
    "download_plan_incremental": _with(
        "SELECT id, file_no, url, target_path FROM placed WHERE target_path NOT IN (SELECT path FROM landed WHERE valid)", "placed", "landed"
    ),
    "download_plan_incremental_any": _with(
        """SELECT id, file_no, url, target_path FROM placed WHERE target_path NOT IN (SELECT path FROM landed WHERE valid)
           AND url NOT IN (SELECT url FROM ingested WHERE outcome = 'successful')""",
        "placed", "landed", "ingested",
    ),
    # files
    "magic_type": _with(
        """SELECT url, magic_ext AS ext, list_extract(['application/pdf', 'application/zip', 'application/msword', 'application/rtf',
                  'application/octet-stream'], doc_id % 5 + 1) AS mime FROM bodies WHERE NOT failing""",
        "bodies",
    ),
    "content_type_ext": _with(
        """SELECT url, attempt_no, header_ext AS ext FROM bodies b
           JOIN (VALUES (false, 1), (true, 1), (true, 2), (true, 3)) a(failing, attempt_no) ON a.failing = b.failing""",
        "bodies",
    ),
    "content_type_table": _with(
        """SELECT url, attempt_no, CASE WHEN header_ext IN ('.pdf', '.zip', '.doc') THEN header_ext END AS ext
           FROM bodies b JOIN (VALUES (false, 1), (true, 1), (true, 2), (true, 3)) a(failing, attempt_no) ON a.failing = b.failing""",
        "bodies",
    ),
    "text_files": """SELECT lang, source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size,
                            sum(octet_length(encode(text)) + 1) >= 100 AS valid FROM documents GROUP BY lang, source""",
    "landed_page_range": _with("SELECT page_no, link_no, url, data_name FROM page_links", "page_links"),
    "page_files": "SELECT page_id AS page_no, 'web/' || page_id || '.html' AS url, md5(html) AS digest FROM pages WHERE coalesce(html, '') <> ''",
    "rejected_pages": """SELECT -page_id - 1 AS page_no, CASE WHEN page_id % 3 <> 0 OR trim(coalesce(html, '')) = '' THEN 'no html' ELSE 'no table body' END AS error
        FROM pages WHERE page_id % 3 <> 0 OR NOT regexp_matches(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '(?i)<tbody[ />]')""",
    "stored_bodies": _with(
        f"""SELECT i.filepath, i.size, md5(list_extract([from_hex('25504446'), from_hex('504B0304'), from_hex('D0CF11E0A1B11AE1'), from_hex('7B5C727466'), ''::BLOB], doc_id % 5 + 1)
                 || encode(text) || CASE WHEN doc_id % 5 <> 1 THEN ''::BLOB WHEN lang = 'fr' THEN from_hex('{TAILS['fr']}')
                                         WHEN lang = 'en' THEN from_hex('{TAILS['en']}') ELSE ''::BLOB END) AS digest
            FROM ingested i JOIN bodies USING (url) WHERE outcome = 'successful'""",
        "ingested", "bodies",
    ),
    "verdicts_kept": _with(
        """SELECT (50000 + doc_id) || ext AS filepath, size, size % 2 = 1 AS judged,
                  CASE WHEN size < 100 THEN false WHEN ext = '.pdf' THEN size >= 1024 AND is_pdf WHEN ext = '.zip' THEN is_zip
                       WHEN ext = '.doc' THEN size > 1000 WHEN ext = '.bin' THEN size > 100 ELSE true END AS valid
           FROM (SELECT *, coalesce(header_ext, magic_ext) AS ext FROM bodies) WHERE NOT failing""",
        "bodies",
    ),
    "link_dedup_stored": _with("SELECT url, page_no, link_no, data_name FROM first_links", "first_links"),
    "detected_ext": _with("SELECT url, coalesce(header_ext, magic_ext) AS ext FROM bodies WHERE NOT failing", "bodies"),
    "zip_test": _with("SELECT url, is_zip FROM bodies WHERE NOT failing", "bodies"),
    "file_validate": _with(
        """SELECT url, ext, CASE WHEN size < 100 THEN false WHEN ext = '.pdf' THEN size >= 1024 AND is_pdf
                  WHEN ext IN ('.zip', '.docx', '.odt') THEN is_zip WHEN ext = '.doc' THEN size > 1000 WHEN ext = '.bin' THEN size > 100
                  ELSE true END AS valid
           FROM bodies, (VALUES ('.pdf'), ('.zip'), ('.docx'), ('.odt'), ('.doc'), ('.bin'), ('.xls')) e(ext) WHERE NOT failing""",
        "bodies",
    ),
    "fetch_ingest": _with("SELECT url, attempt_no, extension, size, target_path, filepath, outcome FROM ingested", "ingested"),
    "target_renamed": _with("SELECT url, target_path, filepath FROM ingested WHERE outcome <> 'error'", "ingested"),
    "target_conflicts": _with(_PLACED, "refetched"),
    "fetch_outcomes_incremental": _with("SELECT url, attempt_no, filepath, outcome FROM refetched", "refetched"),
    "batch_outcome": _with("SELECT outcome, count(*) AS attempts, count(DISTINCT url) AS urls FROM ingested GROUP BY outcome", "ingested"),
    "download_history": _with("SELECT url, filepath, size, year, subject FROM ingested WHERE outcome = 'successful'", "ingested"),
    "failed_downloads": _with("SELECT url, '503 Server Error' AS error FROM ingested WHERE outcome = 'error'", "ingested"),
    "fetch_stats": _with(_STATS, "ingested").replace("\nSELECT 'total_downloads'", ", good AS (SELECT * FROM ingested WHERE outcome = 'successful')\nSELECT 'total_downloads'", 1),
    "zip_members": f"""
        SELECT 'in/' || doc_id || '.zip' AS archive_path, 'in/' || doc_id || '/text.txt' AS member_path,
               CAST(octet_length(encode(text)) AS BIGINT) AS size, md5(text) AS digest FROM documents WHERE {_ZIP_OK}
        UNION ALL
        SELECT 'in/' || doc_id || '.zip', 'in/' || doc_id || '/about/lang.txt', CAST(octet_length(encode(lang)) AS BIGINT), md5(lang)
        FROM documents WHERE {_ZIP_OK}""",
    "zip_rejects": f"SELECT 'in/' || doc_id || '.zip' AS archive_path FROM documents WHERE NOT ({_ZIP_OK})",
    # streams
    "stream_links": _with("SELECT url FROM first_links", "first_links"),
    "stream_distinct": _with(
        " UNION ALL ".join(f"SELECT '{name}' AS field, {column} AS value, count(*) AS n FROM rows_fx GROUP BY {column}" for name, column in _LABELS)
        + f""" UNION ALL SELECT 'TypeDocument', CASE WHEN {_CORRECTION} THEN 'correction' ELSE 'sujet' END AS kind, count(*)
              FROM (SELECT lower(href || ' ' || {_link_name('href', 'data_name')}) AS text FROM rows_fx) GROUP BY kind""",
        "rows_fx",
    ),
    "stream_stats": _with(
        "SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM arrived WHERE NOT failing AND valid GROUP BY extension",
        "arrived",
    ),
    "stream_page_by_page": _with(
        """SELECT 'entry' AS kind, CAST(id AS VARCHAR) AS key FROM entries UNION ALL SELECT 'link', url FROM first_links
           UNION ALL SELECT 'file', concat_ws(' ', file_no, session, discipline, serie, localisation, files_count, filename, download_url, file_id, year)
           FROM files UNION ALL SELECT 'laid', concat_ws(' ', year, subject, url) FROM plan""",
        "entries", "first_links", "files", "plan",
    ),
}
