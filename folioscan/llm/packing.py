"""Packing: optimal length buckets, and batches of a token budget inside each.

1. The global histogram of lengths is taken over all rows. Lengths count exactly below
   4096 and are rounded up to 12 significant bits above, so that the histogram has a few
   ten thousand bins at most, whatever the input.
2. Dynamic programming over the bins chooses ``n_buckets`` upper bounds that minimise the
   padding when every row is padded to its bucket's bound. The cost of a bucket is linear
   in the bound, so each layer is one pass over a lower hull of lines.
3. Inside a bucket, rows are numbered in the order of a hash and cut into batches of as
   many rows as fit the token budget at the bucket's bound; a bound above the budget makes
   batches of one row. Numbers run in two levels, over blocks and within a block, and a
   bucket has about as many blocks as the root of its rows, so no bucket meets in one task.

Rules: a text has its words and one end as tokens; null and empty texts have the end only.
Lengths are those of whole texts, so above 4096 tokens the padding is optimal for lengths as
rounded. Every row gets a slot, repeated rows one each. Columns of other names play no part. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import n_words
from folioscan.session import written

BUDGET = 8192
N_BUCKETS = 16
_EXACT = 12  # binary digits


class Bucket(NamedTuple):
    bound: int
    rows: int
    capacity: int
    first_batch: int


def rounded(length: Column) -> Column:
    """The length, rounded up to twelve significant binary digits."""
    digits = F.length(F.bin(length))
    shift = F.greatest(digits - _EXACT, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return (F.ceil(length / step).cast("long") * step).cast("long")


def best_bounds(histogram: Sequence[tuple[int, int]], n_buckets: int) -> list[int]:
    """Upper bounds with the least padding; histogram: (length, rows) in order of length."""
    sizes = [size for size, _ in histogram]
    before = [0]
    for _, n in histogram:
        before.append(before[-1] + n)
    d, k = len(sizes), min(n_buckets, len(sizes))
    # cost[j]: least padded tokens of the first j bins; a bucket of bins i..j-1 costs its bound times its rows
    cost = [0.0] + [float("inf")] * d
    chosen = []
    for _ in range(k):
        layer, back = [float("inf")] * (d + 1), [0] * (d + 1)
        hull: list[int] = []
        head = 0
        value = lambda i, x: cost[i] - x * before[i]  # noqa: B023, E731
        for j in range(1, d + 1):
            i = j - 1
            if cost[i] < float("inf"):
                while len(hull) - head >= 2 and _covered(hull[-2], hull[-1], i, cost, before):
                    hull.pop()
                hull.append(i)
            while len(hull) - head >= 2 and value(hull[head + 1], sizes[j - 1]) <= value(hull[head], sizes[j - 1]):
                head += 1
            if len(hull) > head:
                layer[j] = value(hull[head], sizes[j - 1]) + sizes[j - 1] * before[j]
                back[j] = hull[head]
        chosen.append(back)
        cost = layer
    bounds, j = [], d
    for back in reversed(chosen):
        bounds.append(sizes[j - 1])
        j = back[j]
    return bounds[::-1]


def _covered(a: int, b: int, c: int, cost: list[float], before: list[int]) -> bool:
    """Whether line b is nowhere below both a and c."""
    return (cost[c] - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[c] - before[a])


def buckets_of(lengths: DataFrame, n_buckets: int, budget: int) -> list[Bucket]:
    bins = lengths.groupBy(rounded(F.col("n_tokens")).alias("size")).agg(F.count("*").alias("n"))
    histogram = sorted((row["size"], row["n"]) for row in bins.collect())
    found, first, at = [], 0, 0
    for bound in best_bounds(histogram, n_buckets) if histogram else []:
        rows = 0
        while at < len(histogram) and histogram[at][0] <= bound:
            rows += histogram[at][1]
            at += 1
        capacity = max(1, budget // bound)
        found.append(Bucket(bound, rows, capacity, first))
        first += -(-rows // capacity)
    return found


def packed(lengths: DataFrame, n_buckets: int = N_BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Add bucket, bucket_length, batch and slot to a table with doc_id and n_tokens, and a hash ``code`` where ids may be missing."""
    buckets = buckets_of(lengths, n_buckets, budget)
    size = rounded(F.col("n_tokens"))
    bounds = F.array(*[F.lit(b.bound) for b in buckets]) if buckets else F.array().cast("array<int>")
    of = lambda values: F.get(F.array(*[F.lit(int(v)).cast("long") for v in values or [0]]), F.col("bucket"))
    rows = lengths.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < size)))
    rows = rows if "code" in lengths.columns else rows.withColumn("code", F.xxhash64("doc_id", "n_tokens"))
    blocks = of([int(b.rows**0.5 / 4) + 1 for b in buckets])
    rows = rows.withColumn("block", F.pmod(F.col("code"), blocks))
    along = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "block").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "block", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("code", "doc_id", "n_tokens")) - 1
    rows = rows.join(before, ["bucket", "block"]).withColumn("nth", nth + F.col("before"))
    capacity = of([b.capacity for b in buckets])
    return rows.select(
        "doc_id", "n_tokens", "bucket", of([b.bound for b in buckets]).alias("bucket_length"),
        (of([b.first_batch for b in buckets]) + F.floor(F.col("nth") / capacity)).alias("batch"),
        (F.col("nth") % capacity).cast("long").alias("slot"),
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch, slot: one row for each document."""
    lengths = docs.select(F.col(doc_id).alias("doc_id"), (n_words(F.col(text)) + 1).alias("n_tokens"), F.xxhash64(doc_id, text).alias("code"))
    return packed(written(lengths, "pack-lengths"), **settings)
