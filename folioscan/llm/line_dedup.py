"""Line deduplication over a corpus, with keep bitmaps as its result.

The lines' keys are hashed to 128 bits, range-partitioned by hash, and sorted inside
the partitions by document (largest first) and position, so that the first occurrence
of a key and the number of its documents are read off a sorted stream. The result is,
for each document that loses lines, a bitmap of its lines in words of 64 bits; words
in which every line stays are left out. The bitmaps hold no text; where they are applied
(``deduped``), only texts that lose lines, or share a hash bucket with one that does, are
shuffled to them.

Hot lines: where a range of hashes holds more than its share of rows, the key is
extended by a salt from the document, and the few partial results of such keys are
summed. The list of such ranges has at most 2 * partitions entries.

Rules: an empty table gives an empty result; texts are split whole, however long;
a null or empty text is one empty line; keys are stripped of white space at
both ends and A-Z lower-cased; keys shorter than ``min_chars`` stay. A key in at least
``min_docs`` documents keeps its lines in the largest doc_id only, there all of them;
a null doc_id is the smallest. Rows with the same doc_id are one document; each of
them loses its own lines. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import SPACE_CHARACTERS, lower_ascii, partitions
from folioscan.session import written

MIN_CHARS, MIN_DOCS = 20, 3
RANGES = 1 << 16
BUCKETS = 1 << 20


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _text_key(text: str) -> Column:
    return F.xxhash64(_whole(text))


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """doc, text_key, pos, h1, h2: one row for each line with a long enough key."""
    lines = docs.select(
        F.col(doc_id).alias("doc"), _text_key(text).alias("text_key"),
        F.posexplode(F.split(lower_ascii(_whole(text)), "\n")).alias("pos", "line"),
    )
    lines = lines.select("doc", "text_key", "pos", F.btrim("line", F.lit(SPACE_CHARACTERS)).alias("line"))
    return lines.filter(F.char_length("line") >= min_chars).select(
        "doc", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")
    )


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, text_key, pos of every line that goes."""
    spark = docs.sparkSession
    lines = written(line_keys(docs, doc_id, text, min_chars), "line-keys")
    n = partitions(spark)
    span = F.shiftrightunsigned("h1", 48)
    held = lines.groupBy(span.alias("span")).agg(F.count("*").alias("held"))
    most = (lines.count() + 2 * n - 1) // (2 * n)
    hot = held.filter(F.col("held") > max(most, 1)).select("span", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(n))).otherwise(F.lit(-1))
    lines = lines.withColumn("span", span).join(F.broadcast(hot), "span", "left")
    lines = lines.select("doc", "text_key", "pos", "h1", "h2", salt.alias("salt"))

    dealt = lines.repartitionByRange("h1", "h2", "salt").sortWithinPartitions(
        "h1", "h2", "salt", F.desc("doc"), "pos"
    )
    group = Window.partitionBy("h1", "h2", "salt")
    stream = group.orderBy(F.desc("doc"))
    seen = dealt.select(
        "*",
        F.dense_rank().over(stream).alias("nth_doc"),
        F.first("doc").over(group.orderBy(F.desc("doc"), "pos")).alias("first_doc"),
        F.row_number().over(group.orderBy(F.desc("doc"), "pos")).alias("nth_line"),
    ).withColumn("n_docs", F.max("nth_doc").over(group))

    later = (F.col("n_docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("first_doc"))
    cold = seen.filter((F.col("salt") < 0) & later).select("doc", "text_key", "pos")

    salted = seen.filter(F.col("salt") >= 0)
    whole = (
        salted.filter(F.col("nth_line") == 1).groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("all_docs"), F.max("first_doc").alias("last_doc"))
        .filter(F.col("all_docs") >= min_docs)
    )
    rest = (
        lines.filter(F.col("salt") >= 0).join(whole, ["h1", "h2"])
        .filter(~F.col("doc").eqNullSafe(F.col("last_doc"))).select("doc", "text_key", "pos")
    )
    return cold.unionByName(rest)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc, text_key, gone: map of word number to the bits of the lines that go."""
    bit = F.expr("shiftleft(1L, pos % 64)")
    bits = dropped_lines(docs, doc_id, text, **settings).groupBy(
        "doc", "text_key", F.floor(F.col("pos") / 64).cast("int").alias("word")
    ).agg(F.bit_or(bit).alias("bits"))
    return bits.groupBy("doc", "text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone")
    )


def kept_lines(text: Column, gone: Column) -> Column:
    """Apply a document's bitmap: its other lines, joined again."""
    def stays(_line: Column, at: Column) -> Column:
        bits = F.coalesce(F.element_at(gone, F.floor(at / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(bits, at % 64) == 0

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, whole text, its bitmap (null: all lines stay) and the text that stays."""
    bitmaps = keep_bitmaps(docs, doc_id, text, **settings)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _text_key(text).alias("key"), _whole(text).alias("text"))
    bitmaps = written(bitmaps, "line-bitmaps")
    # texts that keep all lines stay where they are: a table of hash buckets, of a fixed greatest size, tells them
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(BUCKETS))
    losing = bitmaps.select(F.col("text_key").alias("key")).select(bucket.alias("bucket")).distinct().withColumn("may", F.lit(True))
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(losing), "bucket", "left").select("doc_id", "key", "text", "may")
    some = marked.filter("may")
    same = some["doc_id"].eqNullSafe(bitmaps["doc"]) & (some["key"] == bitmaps["text_key"])
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col("gone")))
    changed = some.join(bitmaps, same, "left").select("doc_id", "text", "gone", kept.alias("kept_text"))
    whole = marked.filter("may is null").select("doc_id", "text", F.lit(None).cast(changed.schema["gone"].dataType).alias("gone"), F.col("text").alias("kept_text"))
    return changed.unionByName(whole)


def line_counts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    gone = F.coalesce(F.aggregate(F.map_values("gone"), F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)), F.lit(0).cast("long"))
    n_lines = F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1
    return deduped(docs, **settings).select(
        "doc_id", n_lines.cast("long").alias("n_lines"), gone.alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), k AS (
  SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, (k.key IS NOT NULL AND l.doc_id <> k.last_doc) AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
