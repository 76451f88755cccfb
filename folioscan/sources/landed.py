"""Readers for landed pages and files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import batched
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from folioscan import schemas
from folioscan.session import ship_package, written
from folioscan.sources.bodies import opened

_ROWS = 4096  # of a listing, in a batch
_BYTES = 4 << 20  # of opened files in a batch; a larger one is a batch of its own


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as Parquet ``page_no, url, html``."""
    return spark.read.schema(schemas.LANDED_PAGES).parquet(path)


def read_page_files(spark: SparkSession, path: str, number: str = r"(\d+)\.html?$", url_prefix: str = "") -> DataFrame:
    """One HTML file per page, numbered by its file name."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("html"), F.col("_metadata.file_path").alias("file")
    )
    page_no = F.regexp_extract("file", number, 1).cast("bigint")
    return files.select(page_no.alias("page_no"), F.concat(F.lit(url_prefix), F.substring_index("file", "/", -1)).alias("url"), "html")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files on disk with length and content; content is not read unless used."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    )


def _hidden(name: str) -> bool:
    """What Spark's file sources leave out, folders and files."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _share(root: str, name: str, share: int, shares: int) -> Iterator[tuple[str, int, int]]:
    """Path below a mounted folder, bytes and milliseconds of the files that have one of the shares of all paths.

    Every share goes through all names, which costs little, and looks at its own files only; empty ones are left out.
    """
    wanted = re.compile(name, re.S).fullmatch
    folders = [""]
    while folders:
        folder = folders.pop()
        start = crc32(os.fsencode(folder))
        with os.scandir(f"{root}/{folder}") as entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    folders.append(f"{folder}{entry.name}/")
                elif crc32(os.fsencode(entry.name), start) % shares == share and wanted(entry.name):
                    try:
                        found = entry.stat()
                    except FileNotFoundError:  # a link that leads nowhere, or a file that is gone by now
                        continue
                    if found.st_size:
                        yield folder + entry.name, found.st_size, found.st_mtime_ns // 1_000_000


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files on disk as ``path, length, modificationTime``, as they are now; no file is opened.

    The list is a table that is written once, however often it is asked; its rows are dealt out to a few tasks
    for each core. A mounted folder is gone through by a task on each core, so that neither the driver nor a
    task holds the list; other stores, and paths with wildcards, are listed by the scan of ``read_files``.
    """
    columns = ["path", "length", "modificationTime"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(hadoop.Path(path)).toString().rstrip("/")
    if not root.startswith("file:") or set(path) & set("{}[]*?\\") or not system.isDirectory(hadoop.Path(path)):
        return written(read_files(spark, path, glob).select(*columns).coalesce(tasks), "listing").repartition(tasks, *columns)
    name = hadoop.GlobPattern(glob).compiled().pattern()
    shares = spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share in batch.column("id").to_pylist():
                for rows in batched(_share(opened(root)[1], name, share, shares), _ROWS):
                    below, lengths, times = zip(*rows)
                    paths = pa.array([f"{root}/{inner}" for inner in below], pa.string())
                    stamps = pa.array(times, pa.int64()).cast(pa.timestamp("ms", "UTC")).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([paths, pa.array(lengths, pa.int64()), stamps], names=columns)

    found = ship_package(spark).range(0, shares, 1, shares).mapInArrow(listed, "path string, length bigint, modificationTime timestamp")
    return written(found, "listing").repartition(tasks, *columns)


def _filled(batches: Iterator[pa.RecordBatch], unless: str | None) -> Iterator[pa.RecordBatch]:
    """The batches with ``content``, cut into batches of some megabytes or of one larger file."""
    for batch in batches:
        closed = batch.column(unless).to_pylist() if unless else [False] * len(batch)
        start, size, bodies = 0, 0, []

        def cut() -> pa.RecordBatch:
            columns = [*batch.slice(start, len(bodies)).columns, pa.array(bodies, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content"])

        for at, (path, left) in enumerate(zip(batch.column("path").to_pylist(), closed)):
            body = None
            if not left:
                system, inner = opened(path)
                with system.open_input_stream(inner) as stream:
                    body = stream.read()
            if bodies and body and size + len(body) > _BYTES:
                yield cut()
                start, size, bodies = at, 0, []
            bodies.append(body)
            size += len(body or b"")
        if bodies:
            yield cut()


def contents(files: DataFrame, unless: str | None = None) -> DataFrame:
    """Add ``content`` to listed files: each task opens the files of its own rows, and holds some megabytes and one file.

    For a part of a folder that only a join can name; ``read_files`` reads all of it. Files of rows in
    which the column ``unless`` is true are not opened, and have no content.
    """
    ship_package(files.sparkSession)
    return files.mapInArrow(lambda batches: _filled(batches, unless), T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses as Parquet."""
    return spark.read.schema(schemas.RESPONSES).parquet(path)
