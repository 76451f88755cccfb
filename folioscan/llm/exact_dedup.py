"""Exact deduplication in the manner of a Grace hash join.

1. Every task of the scan puts its rows into an open-addressing table that compares
   complete content, and writes one row for each content to the spill table in the
   shared folder. A content with a third of all rows thus leaves each task once for each
   table that the task fills; a table is full at ``bucket_bytes``, its contents, rows and ids together.
2. The spill table is dealt out by bits of the content's hash. Buckets whose content
   is larger than ``bucket_bytes`` are written again and dealt out by other bits, as
   often as needed; a bucket with only one hash cannot be split and need not be, as
   its table holds that content once.
3. Each bucket that fits is a task and a table of its own, which again compares complete
   content. Hash values only choose buckets and slots.

Rules: a null text counts as empty; texts are equal when identical after lower-casing
A-Z; the row with the largest id stays (a null id is the smallest; of rows with the
same id and content, one stays); other columns are carried along as they are, under
any name. Texts are compared whole, however long: one that is longer than ``bucket_bytes``
is a bucket by itself. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import partitions
from folioscan.session import written

BUCKET_BYTES = 16 << 20
LEVEL_BITS = 64


class ContentTable:
    """Open addressing with linear probing; a slot matches if hash and content do."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, code: int, content: bytes) -> tuple[int, bool]:
        """Number of the content, and whether it is new."""
        mask = len(self.slots) - 1
        at = code & mask
        while (held := self.slots[at]) >= 0:
            if self.hashes[held] == code and self.contents[held] == content:
                return int(held), False
            at = (at + 1) & mask
        number = len(self.contents)
        self.slots[at] = number
        self.hashes.append(code)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return number, True

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for number, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def _contents(column: pa.Array) -> list[bytes]:
    return [(value or b"").lower() for value in column.cast(pa.binary()).to_pylist()]


def _better(new: int | None, old: int | None) -> bool:
    return new is not None and (old is None or new > old)


class _Kept:
    """The row of the largest id for each content, held as slices of the batches it came in."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch | None] = []
        self.ids: list[int | None] = []

    def offer(self, number: int, fresh: bool, doc_id: int | None, batch: pa.RecordBatch, at: int) -> bool:
        if fresh:
            self.ids.append(doc_id)
            self.rows.append(batch.take(pa.array([at])))
            return True
        if _better(doc_id, self.ids[number]):
            self.ids[number], self.rows[number] = doc_id, batch.take(pa.array([at]))
            return True
        return False


def _one(rows: list[pa.RecordBatch]) -> list[pa.Array]:
    columns = pa.Table.from_batches(rows).combine_chunks().columns
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]


def _local(id_at: int, text_at: int, limit: int):
    """Rows of one task to one row for each content, with the ids it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        held, kept, members, best, n_ids = ContentTable(), _Kept(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal uid, held, kept, members, best, n_ids
            step = 256
            for start in range(0, len(members), step):
                some = slice(start, start + step)
                extra = [
                    pa.array(range(uid, uid + len(members[some])), pa.int64()),
                    pa.array([_signed(code) for code in held.hashes[some]], pa.int64()),
                    pa.array([len(content) for content in held.contents[some]], pa.int64()),
                    pa.array(members[some], pa.list_(pa.int64())),
                    pa.array(best[some], pa.int32()),
                ]
                uid += len(members[some])
                yield pa.RecordBatch.from_arrays(_one(kept.rows[some]) + extra, names=kept.rows[0].schema.names + _EXTRA)
            held, kept, members, best, n_ids = ContentTable(), _Kept(), [], [], 0

        for batch in batches:
            ids = batch.column(id_at).to_pylist()
            row_bytes = batch.nbytes // max(1, len(batch))
            for at, content in enumerate(_contents(batch.column(text_at))):
                number, fresh = held.place(xxhash.xxh3_64_intdigest(content), content)
                if fresh:
                    members.append([])
                    best.append(0)
                if kept.offer(number, fresh, ids[at], batch, at):
                    best[number] = len(members[number])
                members[number].append(ids[at])
                n_ids += 1
                # contents, kept rows (about a mean row each) and ids
                if held.bytes + len(held.contents) * row_bytes + 8 * n_ids > limit:
                    yield from flush()
        yield from flush()

    return run


_EXTRA = ["uid", "code", "bytes", "members", "best"]


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def _bucket(width: int, id_at: int, text_at: int):
    """Spilled rows of one bucket to one row for each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, uids, keep, sizes = ContentTable(), _Kept(), [], [], []
        names = None
        for batch in batches:
            names = batch.schema.names[:width]
            rows = pa.RecordBatch.from_arrays(batch.columns[:width], names=names)
            ids = rows.column(id_at).to_pylist()
            extra = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("uid", "best", "n")]
            for at, content in enumerate(_contents(rows.column(text_at))):
                uid, best, n = (column[at] for column in extra)
                number, fresh = held.place(xxhash.xxh3_64_intdigest(content), content)
                if fresh:
                    uids.append([])
                    keep.append(None)
                    sizes.append(0)
                if kept.offer(number, fresh, ids[at], rows, at):
                    keep[number] = (uid, best)
                uids[number].append(uid)
                sizes[number] += n
        step = 256
        for start in range(0, len(uids), step):
            some = slice(start, start + step)
            extra = [
                pa.array(uids[some], pa.list_(pa.int64())),
                pa.array([k[0] for k in keep[some]], pa.int64()),
                pa.array([k[1] for k in keep[some]], pa.int32()),
                pa.array(kept.ids[some], pa.int64()),
                pa.array(sizes[some], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in held.contents[some]], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(_one(kept.rows[some]) + extra, names=names + _FOUND)

    return run


_FOUND = ["uids", "keep_uid", "keep_best", "keep_id", "group_size", "text_sha256"]


class Grace:
    """Result of one run: the spill table and the tables of all levels, one row for each content."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 bucket_bytes: int = BUCKET_BYTES, fan_out: int | None = None) -> None:
        spark = docs.sparkSession
        self.names = docs.columns
        id_at, text_at = self.names.index(doc_id), self.names.index(text)
        plain = docs.toDF(*[f"c{n}" for n in range(len(self.names))])
        plain = plain.withColumn(f"c{id_at}", F.col(f"c{id_at}").cast("long"))
        self.width = len(self.names)
        fields = list(plain.schema.fields)
        spilled = T.StructType(fields + [
            T.StructField("uid", T.LongType()), T.StructField("code", T.LongType()),
            T.StructField("bytes", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())),
            T.StructField("best", T.IntegerType()),
        ])
        self.spill = written(plain.mapInArrow(_local(id_at, text_at, bucket_bytes), spilled), "grace-spill")
        found = T.StructType(fields + [
            T.StructField("uids", T.ArrayType(T.LongType())), T.StructField("keep_uid", T.LongType()),
            T.StructField("keep_best", T.IntegerType()), T.StructField("keep_id", T.LongType()),
            T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType()),
        ])
        level, done = 0, []
        pending = self.spill.select(*[f.name for f in fields], "uid", "code", "bytes", "best",
                                    F.size("members").cast("long").alias("n"), F.lit(0).alias("bucket"))
        total = self.spill.agg(F.sum("bytes")).first()[0] or 0
        fan = fan_out or max(partitions(spark), 2 * total // bucket_bytes + 1)
        while True:
            dealt = pending.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "bucket", "code"), F.lit(fan)))
            large = (
                dealt.groupBy("bucket")
                .agg(F.sum("bytes").alias("held"), F.min("code").alias("low"), F.max("code").alias("high"))
                .filter((F.col("held") > bucket_bytes) & (F.col("low") != F.col("high")))
                .select("bucket")
            )
            again = level < LEVEL_BITS and bool(large.head(1))
            fits = dealt.join(large, "bucket", "left_anti").select(*dealt.columns) if again else dealt
            done.append(fits.repartitionById(int(fan), F.col("bucket").cast("int")).mapInArrow(_bucket(self.width, id_at, text_at), found))
            if not again:
                break
            pending = written(dealt.join(large, "bucket", "left_semi").select(*dealt.columns), f"grace-level{level + 1}")
            level += 1
        self.levels = level + 1
        self.found = reduce(DataFrame.unionByName, done)

    def survivors(self) -> DataFrame:
        """The rows that stay, with all columns of the input."""
        return self.found.select(*[f"c{n}" for n in range(self.width)]).toDF(*self.names)

    def groups(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of the input."""
        found = self.found.select(F.explode("uids").alias("uid"), *_FOUND[1:])
        members = self.spill.select("uid", F.posexplode("members").alias("at", "doc_id"))
        stays = (F.col("uid") == F.col("keep_uid")) & (F.col("at") == F.col("keep_best"))
        return members.join(found, "uid").select(
            "doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256"
        )


def exact_groups(docs: DataFrame, **settings) -> DataFrame:
    return Grace(docs, **settings).groups()


def without_copies(docs: DataFrame, **settings) -> DataFrame:
    return Grace(docs, **settings).survivors()


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents
), g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM n JOIN g USING (content)
"""
