"""Mixing sources to target weights by systematic sampling.

1. Sizes by source, then targets: the share of each source's weight in the size of
   all, never above ``most`` times its own size; what is cut off goes to the others
   by weight. In closed form: sources sorted by the ratio of limit to weight are cut
   off from the low end, and the rest share what is left.
2. Every document of a source is expected target / size times. These expectations are
   summed along the source's documents, one offset in [0, 1) is added, and a document
   is emitted once for each whole number that its step crosses.

Documents are ordered by size class (the leading three binary digits of their size) and then by a hash, so that each
stretch of a size is sampled evenly and the words taken come near the target. Sums run
in two levels, over blocks and within a block; the number of blocks of a source is
about the root of its number of rows, so neither level meets in one large task. Sums
are exact decimals. The offset and the order come from hashes: reruns agree.

Rows without an id are ordered by their text instead, so that they spread over blocks too.

Rules: a null text has size 0; the null source is one source, last in order; a source
of size 0 has target 0 and none of its documents is emitted. Rows with the same doc_id
and text are separate documents. No document is taken more than ``most`` times. Texts are
measured whole, however long. An empty table gives an empty result. ``mixed_documents`` knows
rows by 128 bits of hash.
Source totals (one row for each source) are ranked in one task: mixes have weights that
people choose, so sources are few; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import n_words
from folioscan.session import written

WEIGHTS = (5, 2, 1)
MOST = 3


def _unit(text: Column) -> Column:
    """A number in [0, 1) from a text, in steps of 2^-28."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_docs, source_size, target from the table (source, size)."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cut = ranked.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("whole"),
        F.coalesce(F.sum("source_size").over(below), F.lit(0)).alias("cut_size"),
        F.sum("weight").over(onward).alias("open_weight"),
    ).withColumn("level", (F.col("whole") - most * F.col("cut_size")) / F.col("open_weight"))
    # sources below the first one that its share does not fill are cut off at their limit
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "cut_size", "level"))).over(Window.partitionBy())["level"]
    share = F.least(most * F.col("source_size").cast("double"), level * F.col("weight"))
    return cut.select("source", "n_docs", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def with_copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add source_size, target and copies to a table with doc_id, source, size and key (a text)."""
    targets = source_targets(rows.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    targets = targets.select(
        F.col("source").alias("of"), "source_size", "target",
        F.floor(rate * 1e12).cast("decimal(24,0)").alias("rate"),
        F.ceil(F.sqrt("n_docs") / 4).cast("int").alias("blocks"),
        F.floor(_unit(F.concat(F.lit("offset:"), F.coalesce("source", F.lit("")))) * 1e12).cast("decimal(24,0)").alias("offset"),
    )
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["of"]), "left").drop("of")
    digits = F.bin("size")
    size_class = F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(F.concat(digits, F.lit("00")), 1, 3))
    joined = joined.withColumn("size_class", size_class)
    spread = F.md5(F.col("key").cast("binary"))
    joined = joined.withColumn("spread", spread).withColumn(
        "block", F.floor(_unit(F.col("key")) * F.col("blocks")).cast("int")
    )
    block = ["source", "size_class", "block"]
    sums = joined.groupBy(*block).agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("size_class", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*[F.col(c).alias(f"b_{c}") for c in block], F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    same = joined["source"].eqNullSafe(before["b_source"])
    for c in block[1:]:
        same &= joined[c] == before[f"b_{c}"]
    placed = joined.join(before, same).drop(*[f"b_{c}" for c in block])
    nth = F.row_number().over(Window.partitionBy(*block).orderBy("spread", "doc_id", "size"))
    placed = placed.withColumn("nth", F.col("before") + nth)
    copies = "(offset + CAST({0} AS DECIMAL(14,0)) * rate) div CAST(1000000000000 AS DECIMAL(24,0))"
    crossed = F.expr(copies.format("nth")) - F.expr(copies.format("(nth - 1)"))
    return placed.withColumn("copies", crossed.cast("long"))


def _key(doc_id: str, text: str) -> Column:
    """What orders a row: its id, or its text if it has none."""
    return F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and the key that orders: the narrow table that is mixed."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        _key(doc_id, text).alias("key"),
    )


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for each document."""
    mixed = with_copies(written(sized(docs), "mix-sizes"), **settings)
    return mixed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of the mix, with all columns: each document as often as it is taken."""
    parts = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")),
             F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull()]
    same = [F.xxhash64(*parts).alias("row_1"), F.xxhash64(F.lit("row"), *parts).alias("row_2")]
    row_key = ["row_1", "row_2"]
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        _key(doc_id, text).alias("key"), *same,
    )
    copies = with_copies(written(narrow, "mix-sizes"), **settings)
    copies = copies.groupBy(*row_key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), *same).join(copies, row_key)
    # equal rows, where there are any, come out together
    several = rows.filter("rows > 1").groupBy(*row_key).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    every = rows.filter("rows = 1").select("row", "copies").unionByName(several.select("row", "copies"))
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return every.select("row", F.explode(times).alias("nth")).select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS spread FROM documents
), t AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM t
), q AS (
  SELECT *, 3 * source_size / weight AS ratio FROM r
), c AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM q
), l AS (
  SELECT source, n_docs, source_size,
         least(3 * source_size::DOUBLE, (SELECT arg_min(level, ratio) FROM c WHERE level <= ratio) * weight) AS target FROM c
), m AS (
  SELECT source, source_size, coalesce(target, 0) AS target,
         floor(CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END * 1e12)::HUGEINT AS rate,
         ceil(sqrt(n_docs) / 4)::INT AS blocks,
         floor(('0x' || substr(md5('offset:' || coalesce(source, '')), 1, 7))::BIGINT / 268435456.0::DOUBLE * 1e12)::HUGEINT AS off
  FROM l
), p AS (
  SELECT d.doc_id, d.size, m.*, row_number() OVER (PARTITION BY m.source
           ORDER BY lpad(length(bin(d.size))::VARCHAR, 2, '0') || substr(bin(d.size) || '00', 1, 3),
                    floor(('0x' || substr(d.spread, 1, 7))::BIGINT / 268435456.0::DOUBLE * m.blocks), d.spread, d.doc_id, d.size) AS nth
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
), z AS (
  SELECT doc_id, size, source_size, target, ((off + nth * rate) // 1000000000000 - (off + (nth - 1) * rate) // 1000000000000)::BIGINT AS copies FROM p
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM z
"""
