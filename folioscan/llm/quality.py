"""Quality rules: counts of a text, and a log-likelihood ratio of hashed n-grams.

Words and pairs of adjacent words are hashed into ``buckets`` each. Two multinomials
over the buckets are estimated with add-``smoothing`` counts: the trusted target from
labelled documents of good quality, the raw corpus from all documents. A document's
score is the sum of the log ratios of its n-grams, divided by their number. Every
document is held against one threshold, which is placed where labelled documents that
took no part in the target separate best; losing a good one weighs ``good_weight``
times as much as keeping a bad one. No labelled documents: no document is rejected.

The labels know some kinds of text (languages, say) and not others. A bucket of words is
foreign if the corpus fills it so often that the labelled documents should hold it
``FOREIGN_LEAST`` times or more, and they hold it less than one in ``FOREIGN_SHARE`` times as
often. Where more than one in ``FOREIGN_WORDS`` words of a document are foreign, the ratio says
nothing about its quality, only about its kind: it is not judged by it (``abstained``), and
the base rules alone decide. So labels of one language do not reject the others.

Bounds: of the labelled documents at most ``max_labelled`` of either quality are used,
those with the smallest hashes of their ids (their ids are broadcast: 8 bytes each).
The corpus counts and the scores cover all texts whole, however long. The model has 3 * buckets
numbers and is sent with the tasks.

Rules: a null text is empty and has no words; a document without n-grams has score 0.
Equal lines are compared as they are. Repeated rows get the same result. Labels with
nulls are not used; other columns play no part. An empty table gives an empty result.
All of it is column expressions. Verdicts come out of a generator, so a filter on them runs
after them and computes nothing twice.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import SPACE, SPACE_CHARACTERS, words

BUCKETS = 1 << 14
MAX_LABELLED = 20_000
GOOD_WEIGHT = 20
FOREIGN_LEAST, FOREIGN_SHARE, FOREIGN_WORDS = 5, 8, 8
WINDOW = 5
_BINS = 64  # of the score's histogram, for each unit


class Model(NamedTuple):
    weights: str  # log ratios by bucket, comma-separated
    threshold: float
    foreign: str  # 1 or 0 by bucket of words, comma-separated


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the words' hashes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARACTERS)) != "")
    df = docs.select(
        F.struct("*").alias("row"),
        F.transform(words(F.col(text)), lambda word: F.xxhash64(word)).alias("hashes"),
        F.char_length(F.regexp_replace(whole, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW)).otherwise(
        F.array().cast("array<int>")
    )
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    df = df.select(
        "row", "word_chars", "n_symbols", "hashes",
        F.size("hashes").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"),
    )
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("ordered", ordered)
    twice = F.filter("ordered", lambda s, i: F.coalesce(s["h"] == F.get("ordered", i - 1)["h"], F.lit(False))
                     | F.coalesce(s["h"] == F.get("ordered", i + 1)["h"], F.lit(False)))
    df = df.withColumn("at", F.array_sort(F.transform(twice, lambda s: s["i"])))
    reach = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "hashes")


def grams(hashes: str, buckets: int) -> Column:
    """Buckets of the words, then of the pairs of adjacent words."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    follows = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    pairs = F.filter(
        F.zip_with(hashes, follows, lambda a, b: F.when(b.isNotNull(), buckets + F.pmod(F.xxhash64(a, b), F.lit(buckets)))),
        lambda g: g.isNotNull(),
    )
    return F.concat(single, F.transform(pairs, lambda g: g.cast("int")))


def _hashed(docs: DataFrame, doc_id: str, text: str, some: DataFrame | None = None) -> DataFrame:
    """The words' hashes of all documents, or of those in a small table by doc_id; no others are hashed then."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows if some is None else rows.join(F.broadcast(some), "doc_id")
    hashed = F.transform(words(F.col("text")), lambda word: F.xxhash64(word))
    return rows.select(*[c for c in rows.columns if c != "text"], hashed.alias("hashes"))


def _labelled(labels: DataFrame, good: bool, bound: int) -> DataFrame:
    rows = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) if good else F.col("quality") == 0)
    rows = rows.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(
        "doc_id", F.lit(good).alias("good"), (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(2)) == 0).alias("fit")
    )


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        buckets: int = BUCKETS, smoothing: float = 1.0, max_labelled: int = MAX_LABELLED,
        good_weight: float = GOOD_WEIGHT) -> Model:
    both = _labelled(labels, True, max_labelled).unionByName(_labelled(labels, False, max_labelled))
    # an id with both labels says nothing
    both = both.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("other"), F.first("fit").alias("fit"))
    both = both.filter(F.col("good") == F.col("other")).drop("other")
    gram = F.explode(grams("hashes", buckets)).alias("gram")
    marks = both.select("doc_id", F.when(F.col("good") & F.col("fit"), 1).alias("trusted"))
    # at most 2 * buckets rows each
    raw = _hashed(docs, doc_id, text).select(gram).groupBy("gram").agg(F.count("*").alias("raw")).collect()
    known = (
        _hashed(docs, doc_id, text, marks).select("trusted", gram)
        .groupBy("gram").agg(F.count("trusted").alias("target"), F.count("*").alias("labelled")).collect()
    )
    of = {row["gram"]: row for row in known}
    counted = [{"gram": r["gram"], "raw": r["raw"], **{n: of[r["gram"]][n] if r["gram"] in of else 0 for n in ("target", "labelled")}} for r in raw]
    n_raw = sum(row["raw"] for row in counted) + smoothing * 2 * buckets
    n_target = sum(row["target"] for row in counted) + smoothing * 2 * buckets
    ratios = [math.log(smoothing / n_target) - math.log(smoothing / n_raw)] * (2 * buckets)
    for row in counted:
        ratios[row["gram"]] = math.log((row["target"] + smoothing) / n_target) - math.log((row["raw"] + smoothing) / n_raw)
    weights = ",".join(f"{x:.5f}" for x in ratios)
    singles = [row for row in counted if row["gram"] < buckets]
    share = sum(row["labelled"] for row in singles) / max(1, sum(row["raw"] for row in singles))
    often = {row["gram"] for row in singles if share * row["raw"] >= FOREIGN_LEAST and FOREIGN_SHARE * row["labelled"] < share * row["raw"]}
    foreign = ",".join("1" if gram in often else "0" for gram in range(buckets))
    held = both.filter(~F.col("fit"))
    binned = (
        _hashed(docs, doc_id, text, held).filter(~abstains("hashes", foreign, buckets))
        .select("good", F.floor(score("hashes", weights, buckets) * _BINS).alias("bin"))
        .groupBy("bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .orderBy("bin").collect()  # scores are between the smallest and largest log ratio
    )
    return Model(weights, _threshold([tuple(row) for row in binned], good_weight), foreign)


def _threshold(bins: list[tuple[int, int, int]], good_weight: float) -> float:
    """Edge at which scores are kept: the cheapest, in the middle between the bins that have rows."""
    if not any(good for _, good, _ in bins) or not any(bad for _, _, bad in bins):
        return -math.inf
    cost = float(sum(bad for _, _, bad in bins))
    best, low, high = cost, bins[0][0], bins[0][0]
    for (at, good, bad), after in zip(bins, [*(b[0] for b in bins[1:]), bins[-1][0] + 1]):
        cost += good_weight * good - bad
        if cost < best:
            best, low, high = cost, at + 1, after
    return (low + high) // 2 / _BINS


def score(hashes: str, weights: str, buckets: int = BUCKETS) -> Column:
    """The sum of the weights of ``grams``, by their number; word and pair of a place are looked up together."""
    table = F.split(F.lit(weights), ",").cast("array<double>")
    weight = lambda bucket: F.get(table, bucket.cast("int"))
    follows = F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0)))
    each = F.zip_with(
        hashes, follows,
        lambda a, b: weight(F.pmod(a, F.lit(buckets)))
        + F.when(b.isNotNull(), weight(buckets + F.pmod(F.xxhash64(a, b), F.lit(buckets)))).otherwise(0.0),
    )
    total = F.aggregate(each, F.lit(0.0), lambda sum_, w: sum_ + w)
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1)).otherwise(0.0)


def abstains(hashes: str, foreign: str, buckets: int = BUCKETS) -> Column:
    """Whether too many words are foreign to the labels."""
    if "1" not in foreign:
        return F.lit(False)
    table = F.split(F.lit(foreign), ",").cast("array<int>")
    n = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))
    return FOREIGN_WORDS * n > F.size(hashes)


def verdicts(docs: DataFrame, model: Model, text: str = "text", buckets: int = BUCKETS, counts: bool = True) -> DataFrame:
    """Every row (as ``row``) with base_failed, score, abstained and kept, and its counts if these are asked for."""
    counted = with_counts(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    columns = ["row", *(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if counts else [])]
    judged = counted.select(
        *columns, failed.alias("base_failed"), score("hashes", model.weights, buckets).alias("score"),
        abstains("hashes", model.foreign, buckets).alias("abstained"),
    )
    kept = ~F.col("base_failed") & (F.col("abstained") | (F.col("score") >= model.threshold))
    names = [*columns, "base_failed", "score", "abstained"]
    # as the output of a generator: a filter on it is not pushed below, where it would compute the columns again
    return judged.select(F.inline(F.array(F.struct(*names, kept.alias("kept")))))


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows that are kept, with their columns."""
    return verdicts(docs, fit(docs, labels, text=text, **settings), text, counts=False).filter("kept").select("row.*")
