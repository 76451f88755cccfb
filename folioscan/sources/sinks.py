"""Writers for reports, history and the file layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscan import fixed_values as fixed
from folioscan.session import path_exists, ship_package, written
from folioscan.sources.bodies import BodySink


def write_validation_report(report: DataFrame, path: str) -> None:
    """CSV with header and the eleven columns in their fixed order."""
    report.select(*fixed.VALIDATION_COLUMNS).write.mode("overwrite").option("header", True).option("emptyValue", "").option(
        "encoding", "UTF-8"
    ).option("escape", '"').csv(path)


def write_history(history: DataFrame, path: str, mode: str = "append") -> None:
    """History as JSON lines; appended, so that earlier runs stay."""
    history.write.mode(mode).json(path)


def write_failures(failures: DataFrame, path: str) -> bool:
    """Failures as JSON lines, only when there are any; they are worked out once, and written before that is asked."""
    failures = written(failures, "failures")
    if failures.isEmpty():
        return False
    failures.write.mode("overwrite").json(path)
    return True


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """``url, error, timestamp`` of the failures that were written; no rows if there were none to write."""
    schema = "url string, error string, timestamp timestamp"
    return spark.read.schema(schema).json(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Each body (``filepath, content``) as a file below the folder; see ``bodies.BodySink``."""
    spark = ship_package(bodies.sparkSession)
    spark.dataSource.register(BodySink)
    bodies.select("filepath", "content").write.format(BodySink.name()).mode("append").save(path)


def write_by_year_and_subject(files: DataFrame, path: str, by_year: bool = True, by_subject: bool = True) -> None:
    """Table partitioned like the folder layout; a missing level becomes the default partition.

    The rebalance hint gathers the rows of a folder into few files, and splits a
    subject that holds a third of the rows over many tasks.
    """
    levels = [c for c, wanted in (("year", by_year), ("subject", by_subject)) if wanted]
    files.hint("rebalance", *levels).write.mode("overwrite").partitionBy(*levels).parquet(path)


def show_summary(summary: DataFrame, rows: int | None = None) -> None:
    """Print a long-form report: all of it, or its first rows and how many are left out."""
    total = summary.count()
    shown = total if rows is None else rows
    summary.orderBy("metric", F.desc("n"), "key").show(max(shown, 1), truncate=False)
    if shown < total:
        print(f"{total - shown} more rows")
