"""Members of landed ZIP archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscan import schemas
from folioscan.functions.urls import suffix

_BATCH_BYTES = 4 << 20
_MEMBERS = pa.schema(
    [("archive_path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
)


def _members(path: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            # a damaged member rejects the archive as a whole, so test before the first row
            damaged = archive.testzip()
            if damaged is not None:
                raise zipfile.BadZipFile(f"damaged member {damaged}")
            for info in archive.infolist():
                if not info.is_dir():
                    body = archive.read(info)
                    yield path, info.filename, len(body), body, None
    except Exception as problem:  # noqa: BLE001 - any unreadable archive becomes a reject row
        yield path, None, None, None, f"{type(problem).__name__}: {problem}"


def in_batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their bytes as batches of a few megabytes."""
    held, size = [], 0
    for row, length in rows:
        held.append(row)
        size += length
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), schema.types)], schema=schema)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (
        (row, row[2] or 0)
        for batch in batches
        for path, content in zip(batch.column("path"), batch.column("content"))
        for row in _members(path.as_py(), bytes(content.as_py()))
    )
    return in_batches(found, _MEMBERS)


def unpack(files: DataFrame) -> DataFrame:
    """One row per member of each ``.zip`` in ``path, content``; a bad archive gives one error row.

    Python holds one batch of archives as Spark sends it, one archive of it as bytes, and up
    to 4 MiB of members at a time. Set ``spark.sql.execution.arrow.maxRecordsPerBatch`` low
    when archives are large.
    """
    zips = files.filter(F.lower(suffix(F.col("path"))) == ".zip").select("path", "content")
    return zips.mapInArrow(_unpack, schemas.ARCHIVE_MEMBERS)


def members(unpacked: DataFrame) -> DataFrame:
    """Good members with the folder they go to, named after the archive's stem."""
    folder = F.regexp_replace("archive_path", r"(?<=[^/])\.[^./]+$", "")
    # parts that would lead out of the folder are left out
    parts = F.filter(F.split("member", "/"), lambda part: ~part.isin("", ".", ".."))
    return unpacked.filter(F.col("error").isNull()).select(
        "archive_path", F.concat_ws("/", folder, parts).alias("member_path"), "member", "size", "content"
    )


def rejected_archives(unpacked: DataFrame) -> DataFrame:
    return unpacked.filter(F.col("error").isNotNull()).select("archive_path", "error")
