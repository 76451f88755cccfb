"""Summaries, validation and statistics, in long form ``(metric, key, n)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions import metadata
from folioscan.functions.text import blank_to_null
from folioscan.functions.urls import suffix
from folioscan.operators.catalogue import complete


def _long_counts(pre: DataFrame, metrics: list[tuple[str, Column]], zeros: list[tuple[str, str]]) -> DataFrame:
    """Sum ``n`` per metric and key over a pre-aggregated table.

    ``pre`` has already one row per combination of keys, so spreading it over
    the metrics is cheap. Metrics in ``zeros`` appear even without any row.
    """
    spread = pre.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), k.alias("key"), F.col("n").alias("n")) for m, k in metrics]))
    ).filter(F.col("key").isNotNull())
    empty = pre.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("key"), F.lit(0).cast("bigint").alias("n")) for m, k in zeros]))
    )
    return spread.unionByName(empty).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def summary(files: DataFrame, document_type: Column | None = None) -> DataFrame:
    """Counts of files in total, by year of the file name, by subject and by type.

    Every file counts as ``sujet`` unless a type column is given.
    """
    kind = F.lit("sujet") if document_type is None else document_type
    keys = {
        "year": metadata.year(F.lit(""), F.col("filename")),
        "subject": F.col("discipline"),
        "type": kind,
    }
    pre = files.groupBy(*[column.alias(name) for name, column in keys.items()]).agg(F.count("*").alias("n"))
    metrics = [
        ("total", F.lit("")),
        ("by_year", F.col("year")),
        ("by_subject", F.col("subject")),
        ("by_type", F.col("type")),
    ]
    return _long_counts(pre, metrics, [("total", ""), ("by_type", "sujet"), ("by_type", "correction")])


def summary_by_detected_type(files: DataFrame) -> DataFrame:
    """The summary with the type taken from the words in name and URL."""
    text = metadata.search_text(F.col("download_url"), F.col("filename"))
    return summary(files, metadata.document_type(metadata.correction_in_text(text)))


def summary_years(files: DataFrame) -> DataFrame:
    """Years found in file names, latest first."""
    year = metadata.year(F.lit(""), F.col("filename"))
    return files.select(year.alias("year")).dropna().distinct().orderBy(F.desc("year"))


def summary_subjects(files: DataFrame) -> DataFrame:
    return files.select(F.col("discipline").alias("subject")).distinct().orderBy("subject")


def validation_report(files: DataFrame) -> DataFrame:
    """One row per file with its completeness status; missing values are empty."""
    filled = {
        "IDFile": "file_id", "Session": "session", "Discipline": "discipline", "Serie": "serie",
        "Localisation": "localisation", "FileName": "filename", "FileNameToSave": "filename_for_save",
        "Link": "download_url",
    }
    text = {name: F.coalesce(F.col(column), F.lit("")).alias(name) for name, column in filled.items()}
    ok = complete(F.col("file_id"), F.col("filename"), F.col("filename_for_save"), F.col("download_url"))
    return files.select(
        F.col("id").alias("ID"), text["IDFile"], text["Session"], text["Discipline"], text["Serie"],
        text["Localisation"], F.col("files_count").alias("Files_Count"),
        F.when(ok, F.lit("OK")).otherwise(F.lit("MISSING")).alias("Status"),
        text["FileName"], text["FileNameToSave"], text["Link"],
    )


def validation_gate(report: DataFrame) -> DataFrame:
    """One row: number of files, number incomplete, and whether all is well."""
    missing = F.count_if(F.col("Status") == "MISSING")
    return report.agg(F.count("*").alias("files"), missing.alias("missing"), (missing == 0).alias("passed"))


def require_valid(report: DataFrame) -> None:
    """Stop the job when a file is incomplete."""
    row = validation_gate(report).first()
    if not row["passed"]:
        raise ValueError(f"{row['missing']} of {row['files']} files are incomplete")


def fetch_statistics(history: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of fetches and failures, bytes, and counts by year, subject and file type."""
    extension = F.coalesce(blank_to_null(F.lower(suffix(F.col("filepath")))), F.lit(".unknown"))
    pre = history.groupBy(
        F.col("metadata.year").alias("year"), F.col("metadata.subject").alias("subject"), extension.alias("ext")
    ).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    counts = _long_counts(
        pre,
        [
            ("total_downloads", F.lit("")),
            ("by_year", blank_to_null(F.col("year"))),
            ("by_subject", blank_to_null(F.col("subject"))),
            ("by_file_type", F.col("ext")),
        ],
        [("total_downloads", "")],
    )
    size = F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint")
    sizes = pre.agg(size.alias("n")).select(
        F.inline(
            F.array(
                F.struct(F.lit("total_size").alias("metric"), F.lit("").alias("key"), F.col("n")),
                F.struct(F.lit("total_size_formatted").alias("metric"), metadata.format_bytes(F.col("n")).alias("key"), F.col("n")),
            )
        )
    )
    failed = failures.agg(F.count("*").alias("n")).select(F.lit("total_failures").alias("metric"), F.lit("").alias("key"), "n")
    return counts.unionByName(sizes).unionByName(failed)
