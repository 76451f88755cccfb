"""Input relations derived from the driver tables.

The SQL runs unchanged in Spark and in DuckDB, so both sides of a check start
from the same rows. Spark also renders the rows back into HTML pages and turns
documents into landed responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_URL = "https://listing.example.org/archive/list"
ORIGIN = "https://listing.example.org"

# One row per order; orders with status P have a second link, urgent ones without a name.
# Some rows have no document link at all.
LISTING_ROWS = """
WITH base AS (
  SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS status, o_orderpriority AS priority,
         CAST(year(o_orderdate) + CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 23 END AS VARCHAR(4)) AS y
  FROM {orders}),
s(i, session_sfx) AS (VALUES
  (0,' - épreuves normales'),(1,' - remplacement'),(2,' - Session NORMALE'),
  (3,' - septembre'),(4,' - épreuves')),
d(i, discipline_txt) AS (VALUES
  (0,'Français - dictée'),(1,'Français - grammaire et compréhension'),
  (2,'Français - rédaction'),(3,'Histoire-géographie-EMC'),(4,'Mathématiques'),
  (5,'Sciences'),(6,'Langue vivante - anglais'),(7,'Langue vivante - hébreu'),
  (8,'Mathématique'),(9,'Éducation musicale'),(10,'Physique-chimie')),
r(i, serie_txt) AS (VALUES
  (0,'Générale'),(1,'Professionnelle'),(2,'Toutes séries'),(3,'Pro'),
  (4,'Agricole'),(5,'generale'),(6,'Professionnel')),
l(i, localisation_txt) AS (VALUES
  (0,'Métropole'),(1,'Amérique  du Nord'),(2,'Antilles, Guyane'),
  (3,'Métropole et Antilles-Guyane'),(4,'Métropole et Antilles Guyane'),
  (5,'Nouvelle-Calédonie'),(6,'Groupe 1'),(7,'Polynésie'),(8,'Pondichery'),
  (9,'Asie'),(10,'LIBAN'),(11,'Europe'),(12,'amerique du sud')),
f(i, sfx) AS (VALUES (0,'_v11.pdf'),(1,'.zip'),(2,' corrige.PDF'),(3,''))
SELECT b.k AS row_key,
       CAST(floor(b.k/50) AS BIGINT)+1 AS page_no,
       CAST(b.k%50 AS BIGINT)+1 AS row_no,
       b.y || s.session_sfx AS session_txt,
       d.discipline_txt, r.serie_txt, l.localisation_txt,
       CASE WHEN b.k % 29 = 4 AND b.status <> 'P' THEN '/note/' || CAST(b.k AS VARCHAR(10))
            ELSE '/document/' || CAST(50000 + b.k % 9973 AS VARCHAR(10)) || '/download' END AS href,
       CASE WHEN f.i = 3 THEN ''
            ELSE substr(b.y,3,2) || 'gen' || CAST(b.k AS VARCHAR(10))
                 || f.sfx || '|' || CAST(50000 + b.k % 9973 AS VARCHAR(10)) END AS data_name,
       CASE WHEN b.status = 'P'
            THEN '/document/' || CAST(70000 + b.k % 4999 AS VARCHAR(10)) || '/download' END AS href2,
       CASE WHEN b.status <> 'P' THEN NULL
            WHEN b.priority = '1-URGENT' THEN '|' || CAST(70000 + b.k % 4999 AS VARCHAR(10))
            ELSE 'annexe' || CAST(b.k AS VARCHAR(10)) || '.docx' END AS data_name2
FROM base b
JOIN s ON s.i = b.k % 5  JOIN d ON d.i = b.k % 11
JOIN r ON r.i = b.k % 7  JOIN l ON l.i = b.k % 13
JOIN f ON f.i = b.k % 4
"""

# Link names and URLs with many spellings, one row per order.
LINK_NAMES = """
WITH base AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM {orders}),
s(i, stem) AS (VALUES
  (0,'24genfrdag1_v11'),(1,'2023-maths'),(2,'sujet 2019 histoire-geographie'),
  (3,'sujet_2021_svt'),(4,'Physique-Chimie session normale 2018'),
  (5,'remplacement hist-geo'),(6,'pro anglais septembre'),(7,'MATHEMATIQUES juin 2022'),
  (8,'turkey francais'),(9,'r%C3%A9ponses%20espagnol'),(10,'physchim 100%+x'),
  (11,'Éducation : musicale? / corrigé'),(12,'')),
e(i, ext) AS (VALUES (0,'.pdf'),(1,'.ZIP'),(2,' corrige.PDF'),(3,''),(4,'.tar.gz'),(5,'.docx'),(6,'.')),
u(i, host, tail) AS (VALUES
  (0,'/document/','/download'),
  (1,'https://files.example.org/a/2020/','/sciences%20svt.zip?x=1'),
  (2,'https://files.example.org/b.c/','/'),
  (3,'document','x'),
  (4,'https://files.example.org/x/','/y+z%2Fw.PDF#p'))
SELECT b.k AS row_key,
       u.host || CAST(50000 + b.k AS VARCHAR(10)) || u.tail AS url,
       s.stem || e.ext || CASE WHEN b.k % 3 = 0 THEN '' ELSE '|' || CAST(50000 + b.k AS VARCHAR(10)) END
         || CASE WHEN b.k % 6 = 1 THEN '|extra' ELSE '' END AS data_name
FROM base b
JOIN s ON s.i = b.k % 13 JOIN e ON e.i = b.k % 7 JOIN u ON u.i = b.k % 5
"""

_PAGES = """
WITH cells AS (
  SELECT page_no, row_no,
    concat('<tr><td class="views-field">\\n  ', replace(session_txt, 'é', '&eacute;'), '&nbsp;\\n</td><td> ',
           discipline_txt, ' </td><td>', serie_txt, '</td><td><span> ', localisation_txt, '</span><!-- x --></td>',
           '<td class="views-field-link"><a href="', href, '" data-atl-name="', data_name, '" data-ati-name="', data_name,
           '">Lien</a>',
           coalesce(concat(' <a title="a ', CASE WHEN page_no % 5 = 3 THEN '<td> </table>' ELSE '>' END, ' b" href=''', href2, ''' data-atl-name="', data_name2, '" data-ati-name="',
                           data_name2, '">Annexe</a>'), ''),
           CASE WHEN page_no % 7 = 2 THEN '<table><tbody><td>note</td></tbody></table>' ELSE '' END,
           '<a href="/aide">Aide</a></td></tr>\\n') AS row_html
  FROM {rows}),
bodies AS (
  SELECT page_no, listagg(row_html, '') WITHIN GROUP (ORDER BY row_no) AS body FROM cells GROUP BY page_no)
SELECT page_no, concat('{base}?page=', page_no) AS url,
  concat('<!DOCTYPE html>', CASE WHEN page_no % 10 = 3 THEN '<![foo[x]]>' ELSE '' END, '<html><head><script>var x = ''<a href="/document/999/download">'';</script></head><body>',
         '<!-- <a href="/document/999/download">old</a> --><a href="/aide">Aide</a>',
         '<table><thead><tr><th>Session</th></tr></thead><tbody>', body,
         '<tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></tbody></table>',
         '<ul class="pager"><li class="pager__item', CASE WHEN page_no = (SELECT max(page_no) FROM {rows}) THEN ' is-disabled' ELSE '' END,
         '"><a rel="next" title="Aller à la page suivante" href="?page=', page_no + 1, '">Suivant</a></li></ul>',
         '</body></html>') AS html
FROM bodies
"""

# Ends of archives, in hex: whole, and with a comment.
TAILS = {"fr": "504B0506000000000000000000000000000000000000", "en": "504B05060000000000000000000000000000000003006E6F74"}

# Attempts per URL: failing ones are tried three times; some bodies are cut short, so that they are invalid.
_RESPONSES = """
WITH attempts(failing, attempt_no) AS (VALUES (0, 1), (1, 1), (1, 2), (1, 3)),
types(i, content_type) AS (VALUES (0, 'application/pdf'), (1, 'application/zip; charset=x'),
  (2, 'application/octet-stream'), (3, 'text/html'), (4, ''), (5, 'Application/MSWORD')),
heads(i, head) AS (VALUES (0, X'25504446'), (1, X'504B0304'), (2, X'D0CF11E0A1B11AE1'), (3, X'7B5C727466'), (4, X'')),
tails(lang, tail) AS (VALUES ('fr', X'{tail_fr}'),
  ('en', X'{tail_en}')),
docs AS (SELECT doc_id, lang, CASE WHEN doc_id % 31 = 3 THEN substr(text, 1, 40) ELSE text END AS text, CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS failing FROM {documents})
SELECT concat('{origin}/document/', 50000 + doc_id, '/download') AS url,
       attempt_no, timestamp_ntz'2024-01-01 00:00:00' AS attempt_ts, content_type,
       CASE WHEN docs.failing = 0
            THEN concat(head, encode(text, 'UTF-8'), coalesce(tail, X'')) END AS content,
       CASE WHEN docs.failing = 1 THEN '503 Server Error' END AS error
FROM docs
JOIN attempts ON attempts.failing = docs.failing
JOIN types ON types.i = doc_id % 6
JOIN heads ON heads.i = doc_id % 5
LEFT JOIN tails ON tails.lang = docs.lang AND doc_id % 5 = 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by the scan's own splits; one with fewer splits than cores is small, and dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTING_ROWS, orders=table(spark, sf_dir, "orders"))


def link_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINK_NAMES, orders=table(spark, sf_dir, "orders"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing rows as HTML pages, 50 rows each.

    The number of partitions is given, so that the few bytes here are not merged
    into one partition: parsing is bound by CPU. The grouping by page needs no
    further exchange.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = listing_rows(spark, sf_dir).repartition(partitions, "page_no")
    return spark.sql(_PAGES.replace("{base}", BASE_URL), rows=rows)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses: one per document, three failures for some."""
    sql = _RESPONSES.replace("{origin}", ORIGIN)
    for lang, tail in TAILS.items():
        sql = sql.replace(f"{{tail_{lang}}}", tail)
    return spark.sql(sql, documents=table(spark, sf_dir, "documents"))


def landed_files(spark: SparkSession, sf_dir: str, placed_plan: DataFrame) -> DataFrame:
    """Files on disk: targets of the plan holding the document with the entry's id as its body.

    French ones lie under the planned path, others under the same path with suffix .doc.
    """
    documents = table(spark, sf_dir, "documents")
    path = F.when(F.col("lang") == "fr", F.col("target_path")).otherwise(
        F.concat(F.regexp_replace("target_path", r"\.[^./]+$", ""), F.lit(".doc"))
    )
    body = F.concat(F.lit(b"%PDF"), F.encode("text", "UTF-8"))
    joined = placed_plan.join(documents, placed_plan["id"] == documents["doc_id"])
    return joined.select(path.alias("path"), body.alias("content")).select(
        "path", F.octet_length("content").cast("bigint").alias("length"), "content"
    )


# Pagers of many makes: by rel, by title alone, disabled themselves or by what is around them; the last page leads back.
_PAGERS = """
WITH numbers AS (SELECT DISTINCT page_no, max(page_no) OVER () AS last FROM {rows})
SELECT page_no, concat('{base}?page=', page_no) AS url,
  concat('<p>', page_no, '</p><ul class="pager">', CASE
    WHEN page_no % 41 = 17 THEN '<li><a rel="next" class="pager-next is-disabled" href="?page=1">x</a></li>'
    WHEN page_no % 41 = 29 THEN '<li class="is-disabled"><i>x</i> <a rel="next" href="?page=1">x</a></li>'
    WHEN page_no % 3 = 0 THEN concat('<li><a title="Aller à la page suivante" href="/archive/list?page=', page_no + 1, '">x</a></li>')
    WHEN page_no % 3 = 1 THEN concat('<li class="p"><a title="page suivante" href="?page=0">no</a><a class="n" rel=next href="?page=', target, '">x</a></li>')
    ELSE concat('<li><span>', page_no, '</span> <a rel="next" href="{base}?page=', target, '">x</a></li>') END, '</ul>') AS html
FROM (SELECT *, CASE WHEN page_no = last THEN {back} ELSE page_no + 1 END AS target FROM numbers)
"""


def pager_pages(spark: SparkSession, sf_dir: str, back: int = 3) -> DataFrame:
    """The page numbers of the listing with pagers of all makes; the last page may lead back to page ``back``."""
    return spark.sql(_PAGERS.replace("{base}", BASE_URL).replace("{back}", str(back)), rows=listing_rows(spark, sf_dir))


def odd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages, and for each page of the web one more: whole, empty, null, or without a table body."""
    landed = landed_pages(spark, sf_dir)
    html = F.when(F.col("page_no") % 3 == 0, F.col("html")).when(F.col("page_no") % 3 == 1, F.lit(" \n"))
    web = pages_table(spark, sf_dir).select((-F.col("page_no") - 1).alias("page_no"), "url", html.alias("html"))
    return landed.unionByName(web)


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's web pages under the names of landed pages."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_no"), "url", "html")
