"""Periodic runs of words: Lyndon arrays by Baier grouping, roots extended into runs.

A run is a stretch of consecutive words with smallest period q that no neighbour extends,
here of at least ``min_exponent`` periods and ``min_length`` words. Per text:

1. Words become numbers. In a run every word but the last q comes again within q words, and
   q is at most a share of the run. Stretches where words come again too late for their
   length are cut there until nothing changes; what is left over can hold runs, the rest
   cannot. This bound is exact and keeps plain text out of the next steps.
2. ``lyndon`` is the first phase of Baier's suffix sorter. Suffixes are grouped by first
   word; groups are taken from the highest to the lowest, and each hands its context on to
   the nearest suffixes to the left that are still in lower groups. At its turn, a group's
   context is the longest Lyndon word at the start of each of its suffixes. It is done
   for the order of words and for its reverse.
3. In one of the two orders a run shows as a chain of equal Lyndon roots, q words apart, at
   most q - 1 words after its start. The head of every long enough chain is extended to
   both sides as far as words q apart are equal, in the whole text.

Every text is work of its own, so nothing is shuffled. Memory in a task is a few megabytes
of text at once, or one text if that is longer.

Rules: words are what white space of ASCII separates, compared as they are. Null and empty
texts have no words and no runs. Repeated rows get their result each. Overlapping runs
all count. An empty table gives an empty table. Other columns stay in ``row``, under any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import words
from folioscan.session import ship_package

MIN_EXPONENT = 4
MIN_LENGTH = 6
BYTES_AT_ONCE = 8 << 20
CUTS = 64

_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def lyndon(codes: list[int]) -> tuple[list[int], list[int]]:
    """For each place the length of the longest Lyndon word that starts there, and its group: equal words, equal groups."""
    n = len(codes)
    number = {code: at for at, code in enumerate(sorted(set(codes)))}
    group = [number[code] for code in codes]
    context = [1] * len(number)
    members: list[list[int]] = [[] for _ in number]
    for at, own in enumerate(group):
        members[own].append(at)
    below = list(range(-1, len(number) - 1))
    above = [*range(1, len(number)), -1]
    # up[at + 1]: the nearest place up to `at` that is in a lower group, plus one; 0 if there is none
    up = list(range(n + 1))
    found = [0] * n
    current = len(number) - 1
    while current >= 0:
        own = [at for at in members[current] if group[at] == current]
        length = context[current]
        for at in own:
            found[at] = length
            up[at + 1] = at
        handed: Counter[int] = Counter()
        for at in own:
            root = at
            while up[root] != root:
                root = up[root]
            while up[at] != root and up[at] != at:
                up[at], at = root, up[at]
            if root:
                handed[root - 1] += 1
        moved: defaultdict[int, defaultdict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for at, copies in handed.items():
            moved[group[at]][copies].append(at)
        for old, by_copies in moved.items():
            under = old
            for copies in sorted(by_copies):
                fresh = len(context)
                context.append(context[old] + copies * length)
                members.append(by_copies[copies])
                for at in by_copies[copies]:
                    group[at] = fresh
                over = above[under]
                below.append(under)
                above.append(over)
                above[under] = fresh
                if over >= 0:
                    below[over] = fresh
                under = fresh
        members[current] = []
        current = below[current]
    return found, group


def _heads(found: np.ndarray, group: np.ndarray, roots: int) -> np.ndarray:
    """Places where a chain of at least ``roots`` equal roots begins."""
    n = len(found)
    at = np.arange(n)
    before = at - found
    good = (before < 0) | (group[np.maximum(before, 0)] != group)
    for step in range(1, roots):
        there = at + step * found
        good &= (there < n) & (group[np.minimum(there, n - 1)] == group)
    return np.flatnonzero(good)


def _equal(codes: np.ndarray, a: int, b: int, limit: int, step: int) -> int:
    """How many codes are equal from a and b on, going by step (1 or -1), at most limit."""
    done, width = 0, 64
    while done < limit:
        width = min(2 * width, limit - done)
        x, y = a + step * done, b + step * done
        differ = codes[x : x + width] != codes[y : y + width] if step > 0 else (codes[x - width + 1 : x + 1] != codes[y - width + 1 : y + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += width
    return done


def runs_of(codes: np.ndarray, stretches: list[tuple[int, int]], exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text that start in one of the stretches that can hold runs."""
    n = len(codes)
    found = set()
    for first, end in stretches:
        part = codes[first:end]
        for order in (part, -part):
            lengths, groups = (np.array(x) for x in lyndon(order.tolist()))
            for head in _heads(lengths, groups, exponent - 1).tolist():
                period, at = int(lengths[head]), first + head
                end_at = at + period + _equal(codes, at, at + period, n - at - period, 1)
                start = at - _equal(codes, at - 1, at + period - 1, at, -1)
                if end_at - start >= max(least, exponent * period):
                    found.add((start, end_at - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _stretches(codes: np.ndarray, bounds: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the stretches that can hold runs; bounds: where the texts begin, and the end."""
    n = len(codes)
    keys = np.sort(codes.astype(np.int64) * n + np.arange(n))
    place = keys % max(n, 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = (keys[1:] // max(n, 1) == keys[:-1] // max(n, 1)) & (text[place[1:]] == text[place[:-1]])
    gap = np.full(n, n + 1, np.int64)
    gap[place[:-1][again]] = (place[1:] - place[:-1])[again]
    shortest = min(max(least, exponent * q) - q for q in range(1, least + 1))
    starts, ends = bounds[:-1], bounds[1:]
    for _ in range(CUTS):  # every round leaves what can hold runs, so more of them would only save work
        sizes = ends - starts
        long = sizes >= shortest
        starts, ends, sizes = starts[long], ends[long], sizes[long]
        at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
        good = gap[at] * (exponent - 1) <= np.repeat(sizes, sizes)
        if good.all():
            break
        piece = np.repeat(np.arange(len(sizes)), sizes)[good]
        at = at[good]
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1]))
        starts, ends = (at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1) if len(at) else (at, at)
    of = text[starts] if len(starts) else starts
    return of, starts, np.minimum(ends + (ends - starts) // (exponent - 1), bounds[of + 1] if len(of) else ends)


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def _texts(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, BYTES_AT_ONCE):
                yield found(part)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
        text = np.repeat(np.arange(len(batch)), np.diff(split.offsets.to_numpy()))
        flat = split.flatten()
        real = pc.not_equal(flat, "")
        flat, text = flat.filter(real), text[real.to_numpy(zero_copy_only=False)]
        bounds = np.searchsorted(text, np.arange(len(batch) + 1))
        codes = flat.dictionary_encode().indices.to_numpy()
        by_text: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        for of, start, end in zip(*(x.tolist() for x in _stretches(codes, bounds, exponent, least))):
            by_text[of].append((start - int(bounds[of]), end - int(bounds[of])))
        runs: list[tuple[int, int, int]] = []
        sizes, gone = np.zeros(len(batch), np.int32), np.zeros(len(codes), bool)
        for of in sorted(by_text):
            first = bounds[of]
            own = runs_of(codes[first : bounds[of + 1]], by_text[of], exponent, least)
            for start, length, period in own:
                gone[first + start + period : first + start + length] = True
            sizes[of] = len(own)
            runs += own
        fields = [pa.array([r[i] for r in runs], pa.int64()) for i in range(3)]
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        run_lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=_RUN.names))
        ends = np.r_[0, np.cumsum(np.bincount(text[~gone], minlength=len(batch)))].astype(np.int32)
        kept = flat.filter(pa.array(~gone)) if gone.any() else flat
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), kept), " ")
        return pa.RecordBatch.from_arrays([batch.column("row"), run_lists, collapsed], names=["row", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str | Column = "text", min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """row (all columns), runs (start and length in words, period; by start, then period), collapsed.

    ``collapsed`` is the text with the first period of each run only, words joined by one
    space. The exponent is a whole number of 3 or more.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent: 3 or more")
    ship_package(docs.sparkSession)
    own = docs.select(F.struct("*").alias("row"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    schema = T.StructType([own.schema["row"], T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return own.mapInArrow(_texts(min_exponent, min_length), schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest)
    found = found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The query's own texts: where crc32 of the id (null: empty) ends in 0, all words after a place repeat a period."""
    code = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(code / 10)

    def repeated(w: Column, a: Column) -> Column:
        period = 1 + F.floor((F.size(w) - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda p: lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return _let(period, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), place(p)), " "))

    some = lambda w: F.when(F.size(w) > 0, _let(F.pmod(g, F.size(w)), lambda a: repeated(w, a))).otherwise(F.lit(""))
    return F.when(F.pmod(code, F.lit(10)) == 0, _let(words(text), some)).otherwise(text)
