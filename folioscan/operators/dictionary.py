"""Subject lookup with the dictionary as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscan.functions import metadata
from folioscan.functions.text import WORD

BITS = 1 << 20  # of the index; also the most that it can take in the plan and in every task


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def _place(token: Column, length: Column) -> Column:
    """Bit of a first token and a number of tokens."""
    return F.xxhash64(token, length.cast("int")).bitwiseAND(F.lit(BITS - 1))


def first_token_index(words: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of tokens that words have, and a bitmap over the hashes of first token and number.

    Its size is fixed, whatever the dictionary: at most ``BITS`` / 64 rows come to the driver.
    """
    heads = words.select(F.get(_tokens("word"), 0).alias("first"), F.size(_tokens("word")).alias("n")).filter("n > 0")
    lengths = sorted(row["n"] for row in heads.select("n").distinct().collect())  # as many as words can be long
    place = _place(F.col("first"), F.col("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    held = [0] * (BITS // 64)
    for row in heads.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        held[row["slot"]] = row["bits"]
    return lengths, held


def spans(text: Column, lengths: list[int], bitmap: list[int]) -> Column:
    """The stretches of a text that begin like a dictionary word of their number of tokens; each once.

    All others are sorted out in the array, before there is a row for them.
    """
    # tokens and the text between them alternate: t0 s0 t1 s1 t2 …
    parts = F.regexp_extract_all(text, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))
    table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def starts(own: Column, n: int) -> Column:
        def may(i: Column) -> Column:
            place = _place(F.get(own, i), F.lit(n))
            return F.getbit(F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

        places = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)))
        return F.transform(F.filter(places, may), lambda i: F.array_join(F.slice(own, i + 1, F.lit(2 * n - 1)), ""))

    if not lengths:
        return F.array().cast("array<string>")
    return F.array_distinct(F.get(F.transform(F.array(parts), lambda own: F.flatten(F.array(*[starts(own, n) for n in lengths]))), 0))


def subjects_from_table(texts: DataFrame, words: DataFrame, key: str = "key") -> DataFrame:
    """Subject of each text by the first dictionary word in it.

    ``texts`` has a unique ``key`` and a lower-case ``text``; ``words`` has
    ``word, subject, position`` with lower-case words that begin and end with a
    letter or digit. A word matches between word bounds, so it must be a span
    of whole tokens. Spans are made only where first token and length are in
    the index of the dictionary, so the rows that are joined, on equality, grow
    with the matches and not with the length of the texts. Nothing is compared
    pairwise, and the dictionary may be of any size.
    """
    lengths, bitmap = first_token_index(words)
    found = texts.select(key, F.explode(spans(F.col("text"), lengths, bitmap)).alias("word"))
    hits = found.join(words, "word").groupBy(key).agg(F.min(F.struct("position", "subject")).alias("hit"))
    found = texts.join(hits, key, "left")
    return found.select(key, F.coalesce(F.col("hit.subject"), metadata.subject_forms(F.col("text"))).alias("subject"))
