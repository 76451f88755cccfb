"""Language identification by compression.

For each language a raw-content dictionary is cut from labelled texts. A text is
lower-cased and encoded with zstandard in blocks of ``block`` bytes, once with every
language's dictionary; the language with the smallest total wins. Blocks are encoded
apart from each other, so that a long text is still read through the dictionary and not
through its own past. Of equal sizes the language with more labelled documents wins,
then the first code. The score is the winner's share when each byte more than the
smallest size divides a language's share of the labelled documents by four. A text is
rejected if the runner-up is within ``margin`` of the smallest size.

Bounds: a dictionary has at most ``dictionary_bytes``, cut from at most
``docs_per_language`` texts with the smallest hashes of their ids, at most
``piece`` characters of each, from a place that the hash chooses; of texts that do not fit, those
with larger hashes are left out. There is one dictionary for each of the ``max_languages`` most
frequent labels. Every text is predicted whole.

Rules: null texts and texts without a letter are ``und`` with score 0, and so is
everything if nothing is labelled; an empty label is a label like others; rows without
an id are predicted but not learned from, and of rows that share an id (with equal texts or not)
no more are learned from than of others; repeated rows get the same result; a letter is what
``str.isalpha`` says; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import ship_package

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 200
DICTIONARY_BYTES = 112 << 10
PIECE = 1200
BLOCK = 1024
LEVEL = 6
MARGIN = 0.02
MAX_LANGUAGES = 256


class Language(NamedTuple):
    code: str
    share: float
    dictionary: bytes


def fit(docs: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        docs_per_language: int = DOCS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES, piece: int = PIECE,
        max_languages: int = MAX_LANGUAGES) -> list[Language]:
    """Dictionaries from the labelled rows for which ``learn`` holds."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.filter(learn) if learn is not None else rows
    rows = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    shares = {row["lang"]: row["n"] for row in counts.collect()}
    rows = rows.filter(F.col("lang").isin(list(shares)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang", F.row_number().over(order).alias("nth")).filter(F.col("nth") <= docs_per_language)
    ids = sorted({row["id"] for row in chosen.select("id").collect()})
    start = F.pmod(F.xxhash64(F.lit("piece"), "id"), F.greatest(F.char_length("text") - piece + 1, F.lit(1))) + 1
    pieces = rows.filter(F.col("id").isin(ids)).select("lang", "id", F.substring("text", start.cast("int"), F.lit(piece)).alias("text"))
    # an id may stand for any number of rows: again the first ones only
    few = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    pieces = pieces.withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= docs_per_language)
    held: dict[str, list[bytes]] = {}
    for row in sorted(pieces.collect(), key=lambda row: (row["lang"], -row["nth"])):
        held.setdefault(row["lang"], []).append(row["text"].lower().encode())
    total = sum(shares.values())
    return [
        Language(code, shares[code] / total, b"\n".join(texts)[-dictionary_bytes:]) for code, texts in sorted(held.items())
    ]


class _Encoders:
    def __init__(self, languages: list[Language]) -> None:
        self.languages = languages
        self.encoders = []
        for language in languages:
            raw = zstandard.ZstdCompressionDict(language.dictionary or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(encoder.compress(block)) for block in blocks) for encoder in self.encoders]
        ranked = sorted(zip(sizes, self.languages), key=lambda pair: (pair[0], -pair[1].share, pair[1].code))
        least = ranked[0][0]
        parts = [language.share * 4.0 ** max(least - size, -400) for size, language in ranked]
        margin = (ranked[1][0] - least) / least if len(ranked) > 1 else 1.0
        return ranked[0][1].code, parts[0] / sum(parts), margin


def predictions(docs: DataFrame, languages: list[Language], doc_id: str = "doc_id", text: str = "text",
                margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _Encoders(languages)
        for batch in batches:
            found = [encoders.predict(value) for value in batch.column("text").to_pylist()]
            codes, scores, margins = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(codes, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()), pa.array([m < margin for m in margins], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")
