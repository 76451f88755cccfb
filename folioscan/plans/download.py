"""What to fetch, where it goes, and what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import metadata, urls
from folioscan.functions.text import blank_to_null

METADATA = metadata.FIELDS


def download_plan(files: DataFrame) -> DataFrame:
    """One row per file to fetch, with its metadata. No exchange."""
    extension = urls.file_extension(F.col("download_url"), F.col("filename"))
    return files.select(
        F.col("id"),
        F.col("file_no"),
        F.col("download_url").alias("url"),
        F.concat("filename_for_save", extension).alias("filename"),
        "file_id",
        F.coalesce(blank_to_null(F.col("year")), metadata.file_year(F.col("filename"))).alias("year"),
        F.col("discipline").alias("subject"),
        "session",
        F.col("serie").alias("series"),
        F.lit(False).alias("is_correction"),
        F.lit("sujet").alias("document_type"),
    )


def with_target_path(plan: DataFrame, by_year: bool = True, by_subject: bool = True) -> DataFrame:
    """Add the path below the output folder."""
    name = metadata.organized_name(*[F.col(c) for c in ("filename", "year", "subject", "session", "series", "document_type", "file_id")])
    return plan.withColumn(
        "target_path", metadata.target_path(F.col("year"), F.col("subject"), name, by_year, by_subject)
    )


def metadata_by_url(plan: DataFrame) -> DataFrame:
    """One metadata record per URL: the last one in plan order wins."""
    last = F.max(F.struct("id", "file_no", *METADATA))
    return plan.groupBy("url").agg(last.alias("last")).select("url", *[F.col(f"last.{c}") for c in METADATA])


def with_metadata(wanted: DataFrame, plan: DataFrame) -> DataFrame:
    """Give each wanted URL its planned metadata, else what its URL tells.

    The planned side has one row per URL, so a hot URL on the other side is
    split by the adaptive skew join; whether a side is broadcast is left to
    Spark, which measures it.
    """
    planned = metadata_by_url(plan).withColumn("planned", F.lit(True))
    joined = metadata.with_parsed(wanted.join(planned, "url", "left"), F.col("url"), F.lit(""), prefix="parsed_")
    columns = [F.when(F.col("planned"), F.col(c)).otherwise(F.col(f"parsed_{c}")).alias(c) for c in METADATA]
    return joined.select(*wanted.columns, *columns)


def not_landed(plan: DataFrame, landed: DataFrame, match: str = "path", history: DataFrame | None = None) -> DataFrame:
    """Planned rows whose target is not there yet as a valid file.

    ``match="path"`` compares the planned path only. ``match="any"`` also leaves
    out URLs recorded in the history, which covers files that were stored under
    another suffix.
    """
    valid = landed.filter("valid").select(F.col("path").alias("target_path")).distinct()
    open_rows = plan.join(valid, "target_path", "left_anti")
    if match == "any" and history is not None:
        open_rows = open_rows.join(history.select("url").distinct(), "url", "left_anti")
    return open_rows
