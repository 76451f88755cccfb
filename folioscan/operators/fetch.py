"""Landed responses and files: type, verdict, placement, history, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscan.functions import filetypes
from folioscan.functions.urls import suffix
from folioscan.plans.download import METADATA, with_metadata, with_target_path
from folioscan.sources.landed import contents


def described(responses: DataFrame) -> DataFrame:
    """Type, size and verdict of each response; the body is dropped here.

    A file ends up under its detected suffix, so the verdict is by that suffix.
    Everything after this step works on narrow rows.
    """
    typed = responses.select(
        "url", "attempt_no", "attempt_ts", "error", "content",
        filetypes.detected_extension(F.col("content_type"), F.col("content")).alias("extension"),
    )
    return typed.select(
        "url", "attempt_no", "attempt_ts", "error", "extension",
        F.octet_length("content").cast("bigint").alias("size"),
        filetypes.is_valid(F.col("extension"), F.col("content")).alias("valid"),
    )


def landed_files(files: DataFrame) -> DataFrame:
    """Verdict on files on disk (``path, length, content``), by their own suffix.

    With the ``binaryFile`` source the content is read for this step only; keep
    the result as a table rather than asking again.
    """
    extension = F.lower(suffix(F.col("path")))
    return files.select(
        "path", F.col("length").alias("size"), filetypes.is_valid(extension, F.col("content"), F.col("length")).alias("valid")
    )


def kept_verdicts(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``path, size, modified, valid, judged`` of listed files (``landed.list_files``).

    known: the table that an earlier run made. A file that has the path, length and time of a
    known one keeps its verdict and is not opened; only the others are read (``judged``).
    """
    same = ["path", "size", "modified"]
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if known is None:
        held = listed.select("*", F.lit(None).cast("boolean").alias("known_valid"), F.lit(False).alias("held"))
    else:
        earlier = known.select(*same, F.col("valid").alias("known_valid"), F.lit(True).alias("held")).dropDuplicates(same)
        held = listed.join(earlier, same, "left").withColumn("held", F.coalesce("held", F.lit(False)))
    read = contents(held, unless="held")
    valid = filetypes.is_valid(F.lower(suffix(F.col("path"))), F.col("content"), F.col("size"))
    return read.select(
        "path", "size", "modified", F.when(F.col("held"), F.col("known_valid")).otherwise(valid).alias("valid"), (~F.col("held")).alias("judged")
    )


def ingested(responses: DataFrame, plan: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Responses with metadata, planned and final path, and outcome.

    landed: files that were there before, as ``path, valid``. Outcomes: ``error``;
    ``skipped`` if a valid file lies at the planned path; ``discarded`` if the new
    path of a renamed file is taken, or if an earlier valid response was stored
    there; ``invalid``; and ``successful`` for the one response that is stored.
    Earlier is by time, then URL, then attempt.
    """
    placed = with_target_path(with_metadata(described(responses), plan))
    final = filetypes.renamed(F.col("target_path"), F.col("extension"))
    arrived = placed.select(
        "url", "attempt_no", "attempt_ts", "error", "extension", "size", "valid",
        F.struct(*METADATA).alias("metadata"), "target_path", final.alias("filepath"),
    )
    if landed is None:
        arrived = arrived.select("*", F.lit(None).cast("boolean").alias("at_target"), F.lit(None).cast("boolean").alias("at_final"))
    else:
        there = landed.groupBy("path").agg(F.bool_or("valid").alias("there_valid"))
        for path, name in (("target_path", "at_target"), ("filepath", "at_final")):
            held = there.select(F.col("path").alias(path), F.col("there_valid").alias(name))
            arrived = arrived.join(held, path, "left")
    moved = F.col("filepath") != F.col("target_path")
    state = (
        F.when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("at_target"), F.lit("skipped"))
        .when(moved & F.col("at_final").isNotNull(), F.lit("discarded"))
        .when(F.col("valid"), F.lit("successful"))
        .otherwise(F.lit("invalid"))
    )
    arrived = arrived.withColumn("state", state)
    # one row for each task and path goes into the exchange, however many responses share the path
    order = F.struct("attempt_ts", "url", "attempt_no")
    stored = arrived.filter(F.col("state") == "successful").groupBy("filepath").agg(F.min(order).alias("stored"))
    joined = arrived.join(stored, "filepath", "left")
    late = (F.col("state") == "successful") & ~order.eqNullSafe(F.col("stored"))
    return joined.select(
        "url", "attempt_no", "attempt_ts", "error", "extension", "size", "valid", "metadata", "target_path", "filepath",
        F.when(late, F.lit("discarded")).otherwise(F.col("state")).alias("outcome"), "at_final",
    )


def history_of(fetched: DataFrame) -> DataFrame:
    """Stored files, one row for each path; what is discarded or skipped leaves no record."""
    return fetched.filter(F.col("outcome") == "successful").select(
        "url", "filepath", "size", F.col("attempt_ts").alias("timestamp"), "metadata"
    )


def stored_bodies(responses: DataFrame, fetched: DataFrame) -> DataFrame:
    """``filepath, content`` of the responses that are stored, for ``sinks.write_bodies``.

    Attempts are known by URL, number and time; bodies are brought to their paths in one join.
    """
    stored = fetched.filter(F.col("outcome") == "successful").select("url", "attempt_no", "attempt_ts", "filepath")
    return responses.select("url", "attempt_no", "attempt_ts", "content").join(stored, ["url", "attempt_no", "attempt_ts"]).select("filepath", "content")


def failures_of(fetched: DataFrame) -> DataFrame:
    """Fetches that raised, one row per attempt."""
    return fetched.filter(F.col("outcome") == "error").select(
        "url", "error", F.col("attempt_ts").alias("timestamp"), "metadata"
    )


def outcomes(fetched: DataFrame) -> DataFrame:
    """Attempts and distinct URLs per outcome."""
    return fetched.groupBy("outcome").agg(
        F.count("*").alias("attempts"), F.count_distinct("url").alias("urls")
    )


def placements(fetched: DataFrame) -> DataFrame:
    """What becomes of each final path: ``stored``, ``kept_existing`` or ``nothing``.

    The URL is that of the stored response, else of the first one. Paths that
    many responses share are reduced by an aggregation with a map-side part.
    """
    arrived = fetched.filter(F.col("outcome") != "error")
    stored = F.col("outcome") == "successful"
    kept = (F.col("outcome") == "skipped") | (F.col("outcome") == "discarded") & F.coalesce("at_final", F.lit(False))
    first = F.min(F.struct(~stored, "attempt_ts", "url"))["url"]
    by_path = arrived.groupBy("filepath").agg(
        first.alias("url"), F.count("*").alias("responses"), F.bool_or(stored).alias("stored"), F.bool_or(kept).alias("kept")
    )
    verdict = F.when(F.col("stored"), F.lit("stored")).when(F.col("kept"), F.lit("kept_existing")).otherwise(F.lit("nothing"))
    return by_path.select("filepath", "url", "responses", verdict.alias("placement"))
