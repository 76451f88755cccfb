"""A sink that writes rows ``filepath, content`` as files, for ``df.write.format("folio_bodies")``.

Nobody sees half a file. A task writes its bodies into an attempt folder of its own below
``_bodies_<job>``; when all of them are there, it moves each to its path, one atomic
rename after the other. An attempt that fails, or whose executor is lost, has moved
nothing or whole files only, and its repetition moves the same files to the same paths. When the
job ends, well or not, the driver removes the job's folder, whose path is all it is told: tasks
send no lists of files.

Files are reached through Arrow's file systems (local or mounted folders, HDFS, S3, GCS, by
the scheme of the path), so the folder must be one that all executors share. A path leads
nowhere but into the folder: empty, ``.`` and ``..`` parts are left out. Two rows of one
path write the same file; the later rename stays. A null path or content writes nothing.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType


def inside(path: str) -> str:
    """The path without parts that lead out of its folder."""
    return "/".join(part for part in path.split("/") if part not in ("", ".", ".."))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark spells it (not escaped), and the path in it."""
    scheme, authority, inner = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), inner.rstrip("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}:{authority or ''}/")
    return system, (base.rstrip("/") + inner).rstrip("/")


@dataclass
class Moved(WriterCommitMessage):
    files: int
    size: int


class BodyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.job = f"_bodies_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = opened(self.folder)
        attempt = f"{root}/{self.job}/{context.taskAttemptId() if context else 0}"
        held: dict[str, str] = {}
        made: set[str] = set()
        size = 0
        system.create_dir(attempt, recursive=True)
        for batch in iterator:
            for path, content in zip(batch.column("filepath").to_pylist(), batch.column("content")):
                if path is None or not content.is_valid or not inside(path):
                    continue
                waiting = f"{attempt}/{len(held)}"
                with system.open_output_stream(waiting) as out:
                    out.write(content.as_buffer())
                held[waiting] = f"{root}/{inside(path)}"
                size += len(content.as_buffer())
        for waiting, final in held.items():
            parent = final.rsplit("/", 1)[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            system.move(waiting, final)
        system.delete_dir(attempt)
        return Moved(len(held), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        # tasks that are still running when another has failed may write once more
        for wait in (0.1, 0.5, 2.0):
            try:
                self._clear()
            except OSError:
                pass
            time.sleep(wait)
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class BodySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_bodies"

    def schema(self) -> StructType:
        return StructType().add("filepath", StringType()).add("content", BinaryType())

    def writer(self, schema: StructType, overwrite: bool) -> BodyWriter:
        if overwrite:
            raise ValueError("folio_bodies adds files: use mode append")
        return BodyWriter(self.options["path"])
