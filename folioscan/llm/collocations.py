"""Phrase collocations from stripes.

A stripe is an associative counter: its key is a prefix (a phrase of some words, or none),
its entries count the words that follow. From this one structure come

* extensions: an entry is the frequency of prefix plus next word,
* prefix totals: that of a prefix is its own entry in the stripe of all its words but the
  last, that of the empty prefix is the sum over its stripe, the number of words,
* subsumption maxima: the largest entries, by prefix and by what the phrase has after its
  first word, tell whether a longer phrase subsumes a shorter one.

1. Tasks count stripes of the empty prefix, which gives the words with ``min_count`` or more,
   then stripes of one word, then those of two to ``longest`` - 1 words. Each task counts some
   megabytes of text at once. Stripes of one first word are kept as one (an entry then holds
   the rest of the prefix and the next word), and they travel in bundles: ``GROUPS`` hash
   groups of first words, one row each.
2. Bundles meet by language and group and are merged entry by entry, in streams sorted by
   key, so a task holds a bounded number of stripes. Stripes of a word that is more than one
   in ``HOT`` of all words are cut into slices by entry, each in a group of its own choice (so
   is that of the empty prefix): no key gathers in one task.
3. A phrase is counted only if its words and its pairs can be frequent. Tasks know these
   from bitmaps of ``BITS`` hashed positions, a fixed size; a collision costs work and changes
   no result, since nothing that is frequent is left out. For very large vocabularies
   ``bits`` can be raised.
4. A candidate is scored at every cut by joins with the prefix totals. The products are
   decimals of 38 digits, the quotient is exact.
5. A longer candidate that holds a phrase often enough implies one that is longer by one
   word and does so too, since counts do not grow with length; so the largest entries suffice.

Rules: words are lower-cased in A-Z. A null text is empty, a null language is ``und`` (as is
the language of that name). Repeated rows count each; ids play no part. Texts are read
whole; one that is longer than the share of a task's step is a step of its own. An empty table
or one without frequent phrases gives an empty result. Ties have the order of the contract:
score, frequency, then phrase by its bytes. Other columns, under any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import partitions
from folioscan.session import ship_package, written

MIN_COUNT = 100
LONGEST = 5
SUBSUMED_PERCENT = 100
TOP = 2000
NO_LANGUAGE = "und"
BITS = 1 << 23
HOT = GROUPS = 4096
BYTES_AT_ONCE = 16 << 20
ROWS_AT_ONCE = 2000
ENTRIES_AT_ONCE = 1_000_000

_PIECE_END = r"[.,;:!?\n-\r]"
_STRIPES = "lang string, length int, bundle int, prefixes string, sizes array<int>, nexts string, counts array<int>"
_MERGED = "lang string, length int, total long, phrases array<string>, counts array<long>"


class Allowed(NamedTuple):
    """What a task needs to know to count the next stripes; all of it has a fixed greatest size."""

    words: np.ndarray | None = None  # bitmap
    pairs: np.ndarray | None = None  # bitmap
    slices: dict[tuple[str, str], int] = {}  # by language and word, fewer than HOT


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(strings: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s) for s in strings], np.uint64)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class _Words(NamedTuple):
    """The words of some texts, one after the other."""

    code: np.ndarray  # number in names
    piece: np.ndarray
    names: pa.Array  # distinct words by language
    langs: list[str]  # of names
    hashes: np.ndarray  # of names, with their language


def _words(texts: pa.Array, langs: pa.Array) -> _Words:
    pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _PIECE_END)
    text_of = np.repeat(np.arange(len(pieces)), np.diff(pieces.offsets.to_numpy()))
    split = pc.ascii_split_whitespace(pieces.flatten())
    piece = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    encoded = split.flatten().dictionary_encode()
    distinct, lang = encoded.dictionary, pc.fill_null(langs, NO_LANGUAGE).dictionary_encode()
    empty = pc.index(distinct, "").as_py()
    code = encoded.indices.to_numpy().astype(np.int64)
    real = code != empty
    code, piece = code[real], piece[real]
    both = lang.indices.to_numpy().astype(np.int64)[text_of[piece]] * max(len(distinct), 1) + code
    numbers, kinds = pd.factorize(both)
    of_lang, of_word = np.divmod(kinds, max(len(distinct), 1))
    lang_names = lang.dictionary.to_pylist()
    hashes = _mix(_hashes(lang_names)[of_lang], _hashes(distinct.to_pylist())[of_word])
    return _Words(numbers.astype(np.int64), piece, distinct.take(pa.array(of_word)), [lang_names[i] for i in of_lang], hashes)


def _bundles(words: _Words, length: int, first: np.ndarray, names: pa.Array, counts: np.ndarray, hashes: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Entries to bundles of stripes: number of the first word (or of any word of the language), entry, count, hash and slices."""
    lang = pd.factorize(np.array(words.langs, object))[0][first]
    part = (hashes >> np.uint64(40)) % parts.astype(np.uint64)
    bundle = (_mix(words.hashes[first], part) % np.uint64(GROUPS) if length else part).astype(np.int32)
    order = np.lexsort((first, bundle, lang))
    lang, bundle, first, counts = lang[order], bundle[order], first[order], counts[order]
    new = np.r_[True, (lang[1:] != lang[:-1]) | (bundle[1:] != bundle[:-1])]
    rows = np.flatnonzero(new)
    stripes = np.flatnonzero(new | np.r_[True, first[1:] != first[:-1]])
    ends = pa.array(np.r_[rows, len(first)].astype(np.int32))
    stripe_ends = pa.array(np.r_[np.searchsorted(stripes, rows), len(stripes)].astype(np.int32))
    prefixes = words.names.take(pa.array(first[stripes])) if length else pa.array([""] * len(stripes), pa.string())
    joined = lambda offsets, values: pc.binary_join(pa.ListArray.from_arrays(offsets, values), "\n")
    columns = [
        pa.array([words.langs[i] for i in first[rows]], pa.string()), pa.array(np.full(len(rows), length, np.int32)), pa.array(bundle[rows]),
        joined(stripe_ends, prefixes), pa.ListArray.from_arrays(stripe_ends, pa.array(np.diff(np.r_[stripes, len(first)]).astype(np.int32))),
        joined(ends, names.take(pa.array(order))), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "length", "bundle", "prefixes", "sizes", "nexts", "counts"])


def _single_stripes(words: _Words, slices: int) -> Iterator[pa.RecordBatch]:
    """Stripes of the empty prefix, by language."""
    _, heads, lang = np.unique(np.array(words.langs, object), return_index=True, return_inverse=True)
    counts = np.bincount(words.code, minlength=len(words.names))
    yield _bundles(words, 0, heads[lang], words.names, counts, words.hashes, np.full(len(counts), slices))


def _slices(words: _Words, slices: dict) -> np.ndarray:
    parts = np.ones(len(words.names), np.int64)
    for i, name in enumerate(zip(words.langs, words.names.to_pylist()) if slices else ()):
        parts[i] = slices.get(name, 1)
    return parts


def _pairs(words: _Words, known: np.ndarray) -> np.ndarray:
    """Where a pair of known words begins inside a piece."""
    code = words.code
    return np.flatnonzero((words.piece[1:] == words.piece[:-1]) & known[code[1:]] & known[code[:-1]])


def _pair_stripes(words: _Words, known: np.ndarray, slices: dict) -> Iterator[pa.RecordBatch]:
    at, n = _pairs(words, known), len(words.names)
    if len(at):
        both, counts = np.unique(words.code[at] * n + words.code[at + 1], return_counts=True)
        first, following = np.divmod(both, n)
        yield _bundles(words, 1, first, words.names.take(pa.array(following)), counts, words.hashes[following], _slices(words, slices)[first])


def _phrase_stripes(words: _Words, known: np.ndarray, pairs: np.ndarray, slices: dict, longest: int) -> Iterator[pa.RecordBatch]:
    """Stripes of two words and more, all of whose pairs can be frequent."""
    code, n = words.code, len(words.names)
    pair = np.zeros(len(code) + 1, bool)
    at = _pairs(words, known)
    pair[at] = _in(pairs, _mix(words.hashes[code[at]], words.hashes[code[at + 1]]))
    at = np.flatnonzero(pair)
    key, found = code[at], []
    for length in range(2, longest):
        last = at + length - 1
        goes_on = pair[last]  # the last word of a piece starts no pair
        at, last, key = at[goes_on], last[goes_on], key[goes_on]
        if not len(at):
            break
        key = pd.factorize(key * n + code[last])[0].astype(np.int64)
        _, first, counts = np.unique(key * n + code[last + 1], return_index=True, return_counts=True)
        heads = at[first]
        rest = [words.names.take(pa.array(code[heads + i])) for i in range(1, length + 1)]
        hashes = reduce(_mix, [words.hashes[code[heads + i]] for i in range(1, length + 1)])
        found.append((code[heads], pc.binary_join_element_wise(*rest, " "), counts, hashes))
    if found:
        first, names, counts, hashes = zip(*found)
        first = np.concatenate(first)
        yield _bundles(words, 2, first, pa.concat_arrays(names), np.concatenate(counts), np.concatenate(hashes), _slices(words, slices)[first])


def _counted(allowed: Allowed, parts: int, longest: int, bytes_at_once: int):
    """Texts to stripes, some megabytes of text at once."""

    def stripes(texts: pa.Array, langs: pa.Array) -> Iterator[pa.RecordBatch]:
        words = _words(texts, langs)
        if not len(words.code):
            return
        if allowed.words is None:
            yield from _single_stripes(words, parts)
            return
        known = _in(allowed.words, words.hashes)
        if allowed.pairs is None:
            yield from _pair_stripes(words, known, allowed.slices)
        else:
            yield from _phrase_stripes(words, known, allowed.pairs, allowed.slices, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            start = 0
            while start < len(batch):
                before = lengths[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(lengths, before + bytes_at_once - size, "right")))
                held.append(batch.slice(start, end - start))
                size += int(lengths[min(end, len(batch)) - 1] - before)
                start = end
                if size >= bytes_at_once or start < len(batch):
                    yield from stripes(*_together(held))
                    held, size = [], 0
        if held:
            yield from stripes(*_together(held))

    return run


def _together(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([batch.column(name) for batch in held]) for name in ("text", "lang")]


def _merged(min_count: int):
    """Bundles sorted by key to one for each key: the sum of its entries, and its frequent phrases."""

    def merge(columns: dict[str, pa.Array], last: bool) -> tuple[pa.RecordBatch, dict[str, pa.Array] | None]:
        keys = [columns[name].dictionary_encode().indices.to_numpy() for name in ("lang", "length", "bundle")]
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        key = np.cumsum(new) - 1
        n = int(key[-1]) + 1
        spelled = columns["phrases"]
        encoded = spelled.flatten().dictionary_encode()
        kinds = max(len(encoded.dictionary), 1)
        both, place = np.unique(np.repeat(key, np.diff(spelled.offsets.to_numpy())) * kinds + encoded.indices.to_numpy(), return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        np.add.at(sums, place, columns["counts"].flatten().to_numpy())
        of, names = both // kinds, encoded.dictionary.take(pa.array(both % kinds))
        bounds = np.searchsorted(of, np.arange(n + 1))
        done = n if last else n - 1
        heads = {name: columns[name].take(pa.array(np.flatnonzero(new))) for name in ("lang", "length", "bundle")}
        good = (sums >= min_count) & (of < done)
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(of[good], minlength=n)[:done])].astype(np.int32))
        batch = pa.RecordBatch.from_arrays(
            [heads["lang"].slice(0, done), heads["length"].slice(0, done), pa.array(np.add.reduceat(sums, bounds[:-1])[:done]),
             pa.ListArray.from_arrays(ends, names.take(pa.array(np.flatnonzero(good)))), pa.ListArray.from_arrays(ends, pa.array(sums[good]))],
            names=["lang", "length", "total", "phrases", "counts"],
        )
        if last:
            return batch, None
        # the last key may go on: its merged entries stand in for its rows
        whole = pa.array([0, bounds[n] - bounds[done]], pa.int32())
        rest = {name: column.slice(done) for name, column in heads.items()}
        rest["phrases"] = pa.ListArray.from_arrays(whole, names.slice(bounds[done]))
        rest["counts"] = pa.ListArray.from_arrays(whole, pa.array(sums[bounds[done] :]))
        return batch, rest

    def opened(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        nexts = pc.split_pattern(batch.column("nexts"), "\n")
        prefixes = pc.split_pattern(batch.column("prefixes"), "\n").flatten()
        repeated = prefixes.take(pa.array(np.repeat(np.arange(len(prefixes)), batch.column("sizes").flatten().to_numpy())))
        entries = nexts.flatten()
        spelled = pc.if_else(pc.equal(repeated, ""), entries, pc.binary_join_element_wise(repeated, entries, " "))
        offsets = nexts.offsets.to_numpy() - nexts.offsets[0].as_py()
        part = {name: batch.column(name) for name in ("lang", "length", "bundle")}
        return part | {"phrases": pa.ListArray.from_arrays(pa.array(offsets), spelled), "counts": batch.column("counts").cast(pa.list_(pa.int64()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, pa.Array]] = []
        entries = 0
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                held.append(opened(batch.slice(start, ROWS_AT_ONCE)))
                entries += len(held[-1]["phrases"].flatten())
                if entries >= ENTRIES_AT_ONCE:
                    out, rest = merge(_concatenated(held), False)
                    held, entries = [rest], 0
                    yield out
        if held:
            yield merge(_concatenated(held), True)[0]

    return run


def _concatenated(held: list[dict[str, pa.Array]]) -> dict[str, pa.Array]:
    return {name: pa.concat_arrays([part[name] for part in held]) for name in held[0]}


def _bitmap(hashed: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of ``hash``; at most bits / 64 rows come to the driver."""
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    slots = hashed.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(one).alias("held")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[slots["slot"].to_numpy()] = slots["held"].to_numpy().view(np.uint64)
    return bitmap


def _hashed(phrases: DataFrame) -> DataFrame:
    """Hashes of phrases (lang, phrase) of one or two words, as tasks compute them from words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _hashes(batch.column("lang").to_pylist())
            words = [phrase.split(" ") for phrase in batch.column("phrase").to_pylist()]
            found = [_mix(lang, _hashes([w[at] for w in words])) for at in range(len(words[0]) if words else 0)]
            found = _mix(*found) if len(found) == 2 else found[0] if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["hash"])

    return phrases.mapInArrow(run, "hash long")


class Stripes(NamedTuple):
    table: DataFrame  # lang, length, prefix, total, nexts, counts
    words: DataFrame  # lang, n


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST,
            bits: int = BITS, hot: int = HOT, bytes_at_once: int = BYTES_AT_ONCE) -> Stripes:
    """Merged stripes of prefixes up to ``longest`` - 1 words, and the number of words of each language."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))

    def merged(allowed: Allowed, label: str) -> DataFrame:
        counted = plain.mapInArrow(_counted(allowed, partitions(spark), longest, bytes_at_once), _STRIPES)
        met = counted.repartition("lang", "length", "bundle").sortWithinPartitions("lang", "length", "bundle")
        return written(met.mapInArrow(_merged(min_count), _MERGED), label)

    singles = merged(Allowed(), "stripes-0")
    words = written(singles.groupBy("lang").agg(F.sum("total").alias("n")), "stripes-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    known = phrases(singles).select("lang", "phrase", "f")
    # fewer than `hot` words are that frequent
    often = {(r["lang"], r["phrase"]): -(-hot * r["f"] // total) for r in known.filter(F.col("f") * hot > total).collect()}
    allowed = Allowed(_bitmap(_hashed(known), bits), None, often)
    tables = [singles, merged(allowed, "stripes-1")]
    if longest > 2:
        pairs = _bitmap(_hashed(phrases(tables[1]).select("lang", "phrase")), bits)
        tables.append(merged(allowed._replace(pairs=pairs), "stripes-2"))
    return Stripes(reduce(DataFrame.unionByName, tables), words)


def phrases(table: DataFrame) -> DataFrame:
    """lang, length, phrase, f: the entries of merged stripes, spelled with their prefixes."""
    entries = table.select("lang", F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), F.col("counts").alias("f"))))
    return entries.select("lang", F.size(F.split("phrase", " ")).alias("length"), "phrase", "f")


def _exact(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def candidates(found: Stripes, percent: int = SUBSUMED_PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one subsumes."""
    totals = written(phrases(found.table), "stripes-phrases")
    entries = totals.filter(F.col("length") > 1)
    words = F.split("phrase", " ")
    # the largest extension to the right is in the stripe of the phrase, that to the left in the stripe of another first word
    wider = entries.filter(F.col("length") > 2)
    right = wider.select("lang", F.expr("substring_index(phrase, ' ', length - 1)").alias("phrase"), "f")
    left = wider.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    most = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = entries.join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f")))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"),
    )
    side = lambda part, name: totals.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(found.words, "lang")
    product = _exact(F.col("a")) * _exact(F.col("n")) * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("product", product.cast("decimal(38,0)")).withColumn("parts", (_exact(F.col("l")) * _exact(F.col("r"))).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int | None = TOP, percent: int = SUBSUMED_PERCENT,
                 min_count: int = MIN_COUNT, **settings) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases, the best ``top`` or all."""
    scored = candidates(stripes(docs, text, lang, min_count, **settings), percent)
    by_lang = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.select("lang", F.row_number().over(by_lang).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


ORACLE = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (SELECT lang, doc, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM s, (SELECT unnest(range(1, 6)) AS size))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100),
held AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < size) GROUP BY ALL
), kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * f),
cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT cut.*, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN n ON n.lang = cut.lang
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low
QUALIFY rank <= 2000
"""
