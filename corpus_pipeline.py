"""From raw documents to packed batches: quality rules, two deduplications, mixing, packing.

Every stage reads the whole output of the one before it, as Parquet in the shared folder.
All but the last return rows with the columns of documents, whatever these are called; no rows give
no rows. Nulls, empty texts, ties and repeated rows are dealt with as each stage says; texts are
never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import exact_dedup, mixing, near_dedup, packing, quality
from folioscan.llm.common import table
from folioscan.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold of the n-gram ratio, repeated ones each.

    Null and empty texts fail the base rules. Without usable labels these decide alone.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is the smallest, a null text is empty."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; a null id comes last.

    Texts without words are in a class by their content only.
    """
    return near_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; the null source is one source.

    Of a source without any words nothing is taken.
    """
    return mixing.mixed_documents(docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A slot in a batch for every row of the mix, repeated rows one each; null and empty texts have one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mix),
    ("packing", batches),
]

# fitting by labels, near duplicates and the choice of buckets have no SQL; tests hold each against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
