"""Near duplicates: BagMinHash signatures, bands, and verified multiset overlap.

1. Texts that are equal after lower-casing A-Z are one content; a content goes through
   the rest once, however many copies it has.
2. Every content gets a signature of 150 registers (``bag_minhash``), cut into 30 bands of
   5. Contents that agree in a band are candidates; at a similarity of 0.8 a pair misses
   all bands with a probability of 7e-6.
3. Each band's bucket names a lead: the member that shares most buckets with others. All
   members are verified against the lead, so a bucket of n members makes n pairs. Verified
   pairs are links, and linked contents form classes.
4. Buckets whose members are all in one class are done. In the others every pair across
   classes is looked at: the members outside the bucket's largest class meet all members, in
   blocks of about ``BLOCK``, block by block inside a task; members of the largest class do not
   meet each other. Pairs whose registers agree too seldom for the threshold (by five standard
   errors) are passed over, the others are verified, and only links that join two classes come
   out. So no link is lost. Of a bucket with g members in its largest class and s others some
   g * s / ``BLOCK`` + s * s / ``BLOCK`` rows are sent: in proportion to the bucket while s is
   below ``BLOCK``, and with its square only if it holds that many classes apart from each other.
5. Classes are connected components of all links, by smallest label with shortcuts, each
   round written to the shared folder.

Similarity is the Jaccard similarity of the bags of five-word shingles, words being
lower-cased in A-Z. A text of fewer words is one shingle. Texts without words are in a
class of their own content only. Null texts are empty. Texts are compared whole, however
long; a task holds the shingles of a bounded number of texts, or of one longer text. Other
columns are not touched. Result by document; documents with equal id and text are told apart
nowhere. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import bag_minhash as bm
from folioscan.llm.common import lower_ascii
from folioscan.session import ship_package, written

PERCENT = 80
BLOCK = 512
BUCKETS = 1 << 20
SHINGLES_AT_ONCE = 200_000


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All columns as ``row``, doc_id, text, and the content's hash as k1, k2."""
    df = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("low", lower_ascii(F.col("text")))
    return df.select("row", "doc_id", "text", F.xxhash64("low").alias("k1"), F.xxhash64(F.lit("content"), "low").alias("k2"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with their bags, a bounded number of shingles at a time."""
    shingler = bm.Shingler()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        start, bags, held = 0, [], 0
        for at in range(len(texts)):
            bags.append(shingler.bag(texts[at].as_py()))
            held += len(bags[-1])
            if held > SHINGLES_AT_ONCE or at + 1 == len(texts):
                yield batch.slice(start, at + 1 - start), bags
                start, bags, held = at + 1, [], 0


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bags in _batches(batches):
        codes = bm.band_codes(bm.signatures(bags))
        full = np.array([len(bag) > 0 for bag in bags])
        values = pa.array(codes[full].ravel())
        ends = pa.array(np.concatenate([[0], np.cumsum(np.where(full, bm.BANDS, 0))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(ends, values)], names=["k1", "k2", "bands"]
        )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bags in _batches(batches):
        registers = bm.short_registers(bm.signatures(bags))
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array([r.tobytes() for r in registers], pa.binary()), pa.array([bm.units(b).tobytes() for b in bags], pa.binary())],
            names=["uid", "registers", "units"],
        )


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(name) for name in ("units_a", "units_b"))
            keep = [bm.similar(_units(a[i]), _units(b[i]), percent) for i in range(len(batch))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(keep) for n in ("a", "b")], names=["a", "b"])

    return run


def _units(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.uint64)


def _least_agreement(percent: int) -> float:
    """Of one-byte registers, five standard errors below what the threshold leads to."""
    share = percent / 100
    share += (1 - share) / 256
    return bm.REGISTERS * share - 5 * (bm.REGISTERS * share * (1 - share)) ** 0.5


class _Classes:
    """Classes joined so far, inside one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)


def _links_across(percent: int):
    """Rows of a cell (bucket and two block numbers) to links that join classes."""
    least = _least_agreement(percent)

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        blocks = sorted({row[0] for row in rows})
        first = [row for row in rows if row[0] == blocks[0]]
        second = first if len(blocks) == 1 else [row for row in rows if row[0] == blocks[1]]
        ra, rb = (np.stack([np.frombuffer(row[3], np.uint8) for row in part]) for part in (first, second))
        joined, found = _Classes(), []
        for i, (_, uid, label, _, own) in enumerate(first):
            others = range(i + 1, len(second)) if second is first else range(len(second))
            agree = (rb[others.start :] == ra[i]).sum(1) if len(others) else np.zeros(0)
            near = [others.start + j for j in np.flatnonzero(agree >= least)]
            near.sort(key=lambda j: -agree[j - others.start])
            mine = np.frombuffer(own, np.uint64)
            for j in near:
                _, other, other_label, _, theirs = second[j]
                if joined.find(label) != joined.find(other_label) and bm.similar(mine, np.frombuffer(theirs, np.uint64), percent):
                    joined.join(label, other_label)
                    found.append((label, other_label))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("band", "low", "high", "block", "uid", "label", "registers", "units")]
            for band, low, high, *row in zip(*columns):
                if (band, low, high) != cell:
                    if len(rows) > 1:
                        yield out(links(rows))
                    cell, rows = (band, low, high), []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield out(links(rows))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is linked with) from links (a, b)."""
    edges = written(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges"
    )
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        met = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("met"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        moved = labels.join(met, F.col("node") == F.col("a"), "left").join(up, F.col("label") == F.col("up"), "left")
        moved = written(
            moved.select("node", F.col("label").alias("old"), F.least("label", "met", "above").alias("label")), "near-labels"
        )
        changed = bool(moved.filter(F.col("old") != F.col("label")).head(1))
        labels = moved.select("node", "label")
        if not changed:
            return labels


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The documents as rows with content hashes, and k1, k2, class_id, class_size, n_first, keeps, of all contents.

    class_id is the smallest id in the class; ``keeps`` marks the content it belongs to,
    of equals the one with the smallest number; ``n_first`` is the number of its rows.
    """
    ship_package(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    ids = rows.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("n").alias("rows")))
    content = ids.groupBy("k1", "k2").agg(first.alias("first"), F.sum("n").alias("n"))
    content = content.select("k1", "k2", "n", F.col("first.doc_id").alias("first_id"), F.col("first.rows").alias("n_first"))
    content = written(content.withColumn("uid", F.monotonically_increasing_id()), "near-contents")

    sketches = written(rows.select("k1", "k2", "text").mapInArrow(_sketches, "k1 long, k2 long, bands array<long>"), "near-sketches")
    banded = sketches.select("k1", "k2", F.explode("bands").alias("band"))
    shared = (
        banded.groupBy("band")
        .agg(F.min("k1").alias("l1"), F.max("k1").alias("h1"), F.min("k2").alias("l2"), F.max("k2").alias("h2"))
        .filter((F.col("l1") != F.col("h1")) | (F.col("l2") != F.col("h2"))).select("band")
    )
    numbers = content.select("k1", "k2", "uid")
    members = banded.join(shared, "band").distinct().join(numbers, ["k1", "k2"]).select("band", "uid", "k1", "k2")
    members = written(members, "near-members")

    chosen = members.select("uid", "k1", "k2").distinct()
    # most texts have no candidate: a table of hash buckets, of a fixed greatest size, keeps them out of the exchange
    bucket = F.pmod("k1", F.lit(BUCKETS)).alias("bucket")
    near = rows.select("k1", "k2", "text", bucket).join(F.broadcast(chosen.select(bucket).distinct()), "bucket", "left_semi")
    texts = near.join(chosen, ["k1", "k2"]).groupBy("uid").agg(F.first("text").alias("text"))
    bags = written(texts.mapInArrow(_bags, "uid long, registers binary, units binary"), "near-bags")

    sizes = members.groupBy("band").agg(F.count("*").alias("size"))
    reach = members.join(sizes, "band").groupBy("uid").agg(F.sum("size").alias("reach"))
    leads = members.select("band", "uid").join(reach, "uid").groupBy("band").agg(F.max(F.struct("reach", "uid"))["uid"].alias("lead"))
    pairs = (
        members.join(leads, "band").filter(F.col("uid") != F.col("lead"))
        .select(F.least("uid", "lead").alias("a"), F.greatest("uid", "lead").alias("b")).distinct()
    )
    side = lambda name: bags.select(F.col("uid").alias(name), F.col("units").alias(f"units_{name}"))
    links = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(percent), "a long, b long"), "near-links")
    labels = components(links)

    labelled = written(
        members.select("band", "uid").join(labels, F.col("uid") == F.col("node"), "left")
        .select("band", "uid", F.coalesce("label", "uid").alias("label")), "near-labelled"
    )
    sides = labelled.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(
        F.max(F.struct("n", "label")).alias("largest"), F.sum("n").alias("size")
    ).filter(F.col("largest.n") < F.col("size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sides = sides.select(
        "band", F.col("largest.label").alias("top"), blocks(F.col("largest.n")).alias("top_blocks"),
        blocks(F.col("size") - F.col("largest.n")).alias("rest_blocks"),
    )
    cells = labelled.join(sides, "band").withColumn("in_top", F.col("label") == F.col("top"))
    # blocks of the largest class come first; these meet the others only
    spread = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    last = F.col("top_blocks") + F.col("rest_blocks") - 1
    cells = cells.withColumn("block", F.when(F.col("in_top"), spread(F.col("top_blocks"))).otherwise(F.col("top_blocks") + spread(F.col("rest_blocks"))))
    cells = cells.withColumn("other", F.explode(F.sequence(F.when(F.col("in_top"), F.col("top_blocks")).otherwise(0), last)))
    cells = cells.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "uid", "label")
    cells = cells.join(bags, "uid").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "block", "uid")
    more = written(cells.mapInArrow(_links_across(percent), "a long, b long"), "near-links")
    merged = components(more).select(F.col("node").alias("was"), F.col("label").alias("now"))

    classes = labels.join(merged, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    alone = merged.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    classes = classes.unionByName(alone)
    known = content.join(classes, F.col("uid") == F.col("node"), "left")
    known = known.select("k1", "k2", "uid", "first_id", "n_first", "n", F.coalesce("label", "uid").alias("label"))
    known = written(known, "near-known")
    heads = known.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    keeper = known.join(heads, "label").filter(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("uid").alias("keeper"))
    found = known.join(heads.join(keeper, "label"), "label").select(
        "k1", "k2", "class_id", "class_size", "n_first", (F.col("uid") == F.col("keeper")).alias("keeps")
    )
    return rows, found


def document_classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row for each document."""
    rows, found = near_classes(docs, **settings)
    kept = F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "class_id", "class_size", kept.alias("kept"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One whole row of each class: of its smallest id (of equal rows, one)."""
    rows, found = near_classes(docs, **settings)
    found = written(found.filter("keeps"), "near-kept")
    stays = rows.join(found, ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # ids are unique as a rule; only rows that share id and text are brought together
    if found.filter("n_first > 1").isEmpty():
        return stays.select("row.*")
    several = stays.filter("n_first > 1").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return stays.filter("n_first = 1").select("row").unionByName(several.select("row")).select("row.*")
