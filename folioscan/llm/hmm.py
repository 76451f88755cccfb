"""Scoring by a hidden Markov language model.

The model emits word classes: every word with more than one in ``classes`` training
tokens is a class, the others share ``shared`` classes by their last three bytes. Inside
a class a word has its share of the class under the add-one unigram model, so a text's
probability is that of its class sequence under the Markov model, times those shares;
with one state it is exactly the unigram probability.

Training is Baum-Welch. Tasks run the scaled forward and backward recursions over their
texts, many texts at a time, and send expected counts of a fixed size; Spark adds these
up across tasks, and the next round starts from the sums. All training texts take part
in every round. Scoring is the scaled forward recursion over each whole text.

Unigram counts are taken over all training tokens. For the score of each text, words with
more than one in ``HEAD`` training tokens (so at most that many words) come with the tasks;
the rest is joined by word. Such a word is rare in training; one that held-out texts alone
repeat has no count to join, and is split like any skewed key by the adaptive join.

Rules: words are lower-cased in A-Z; every text ends with one end token; a null text is
empty and has only that one. Every row is scored, repeated ones each; a null id counts as
empty when the held-out part is chosen. Without training tokens every word
is unknown and the score is the unigram score. Both recursions run over whole texts; above
``SEGMENT`` tokens they go piece by piece, with the vectors of forward and backward
carried over the borders, so memory is bounded and the counts are the same. An empty table gives an
empty result. Other columns play no part.

Limits: what states emit is learned for classes, not for each word. The number of classes is
bounded (``classes`` + ``shared``), as each task holds the model; only the unigram part grows with the
vocabulary. In a corpus of fewer than ``classes`` tokens every word is a class of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.session import ship_package, written

END = " "  # no word is a space
HEAD = 1 << 19
CLASSES, SHARED = 2048, 512
STATES, ROUNDS = 8, 3
SEGMENT = 1 << 18
TOKENS_AT_ONCE = 250_000
TEXT_AT_ONCE = 2 << 20
COUNTS_AT_ONCE = 1 << 20
SCALED_EVERY = 4  # places; an emission is never so small that the product of four is zero


class Vocabulary(NamedTuple):
    classes: dict[bytes, int]
    shared: int
    mass: np.ndarray  # of each class under the unigram model
    frequent: dict[bytes, float]  # log10 probabilities, at most HEAD

    def of(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of distinct tokens, and their log10 probabilities; NaN for those that do not come with the tasks."""
        known, first = map(self.classes.get, tokens), len(self.classes)
        numbers = [first + zlib.crc32(token[-3:]) % self.shared if number is None else number for token, number in zip(tokens, known)]
        return np.array(numbers, np.int16), np.array(list(map(self.frequent.get, tokens)), np.float64)

    def one(self, token: bytes) -> int:
        number = self.classes.get(token)
        return len(self.classes) + zlib.crc32(token[-3:]) % self.shared if number is None else number


class Model(NamedTuple):
    start: np.ndarray  # by state
    step: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state


def token_counts(docs: DataFrame, text: str, at_once: int = COUNTS_AT_ONCE) -> DataFrame:
    """token, c: tasks count their tokens part by part, and hold about ``at_once`` distinct ones and those of a part."""

    def merged(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")])
        return sums.select(["token", "c_sum"]).rename_columns(["token", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in (part for whole in batches for part in _slices(whole)):
            _, codes, distinct = _tokens(batch.column("text"))
            seen = np.bincount(codes, minlength=len(distinct))
            used = np.flatnonzero(seen)
            held.append(pa.table({"token": distinct.take(pa.array(used)), "c": seen[used].astype(np.int64)}))
            if sum(map(len, held)) > at_once:
                held = [merged(held)]
                if len(held[0]) > at_once // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    counts = docs.select(F.col(text).alias("text")).mapInArrow(run, "token string, c long")
    return written(counts.groupBy("token").agg(F.sum("c").alias("c")), "token-counts")


def rare_scores(sequences: DataFrame, counts: DataFrame, n: int, v: int) -> DataFrame:
    """uid, rare_score, n_rare_known: what the words that do not come with the tasks add to the unigram score."""
    log_p = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    each = sequences.select("uid", F.explode("rare").alias("token"))
    met = each.join(counts.filter(F.col("c") <= n / HEAD), "token", "left")
    return met.groupBy("uid").agg(F.sum(log_p).alias("rare_score"), F.count("c").alias("n_rare_known"))


def vocabulary(counts: DataFrame, n: int, v: int, classes: int = CLASSES, shared: int = SHARED) -> Vocabulary:
    head = {row["token"].encode(): row["c"] for row in counts.filter(F.col("c") > n / HEAD).collect()}
    frequent = sorted((token, c) for token, c in head.items() if c > n / classes)
    numbers = {token: number for number, (token, _) in enumerate(frequent)}
    plain = Vocabulary(numbers, shared, np.zeros(0), {})
    first = len(numbers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shared, np.float64)
        for batch in batches:
            tokens = batch.column("token").cast(pa.binary()).to_pylist()
            at = np.array([plain.one(token) - first for token in tokens], np.int64)
            held += np.bincount(at, weights=batch.column("c").to_numpy() + 1, minlength=shared)
        yield pa.RecordBatch.from_arrays([pa.array(range(shared), pa.int32()), pa.array(held)], names=["class", "mass"])

    rest = counts.filter(F.col("c") <= n / classes).mapInArrow(add, "class int, mass double")
    sums = {row["class"]: row["mass"] for row in rest.groupBy("class").agg(F.sum("mass").alias("mass")).collect()}
    mass = np.array([c + 1.0 for _, c in frequent] + [sums.get(i, 0.0) + 1 / shared for i in range(shared)])
    log_p = {token: math.log10((c + 1) / (n + v + 1)) for token, c in head.items()}
    return Vocabulary(numbers, shared, mass / (n + v + 1), log_p)


def first_model(mass: np.ndarray, states: int = STATES) -> Model:
    """The unigram model with a little noise, and states that like to stay."""
    noise = np.random.default_rng(7).gamma(4.0, 0.25, (len(mass), states)) if states > 1 else 1.0
    emit = mass[:, None] * noise * np.ones((1, states))
    step = np.full((states, states), 0.1 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(step, 0.9)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0))


def _groups(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of texts of like length, longest first, so many that padding them stays small."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    start = 0
    while start < len(order):
        width = len(texts[order[start]])
        count = max(1, min(1024, TOKENS_AT_ONCE // width))
        yield order[start : start + count]
        start += count


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes by place and text, and how many texts reach each place; longest first."""
    sizes = np.array([len(t) for t in texts])
    held = np.zeros((len(texts), sizes[0]), np.int32)
    held[np.arange(sizes[0]) < sizes[:, None]] = np.concatenate(texts)
    reach = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    return np.ascontiguousarray(held.T), reach


def _scaled(reach: np.ndarray) -> np.ndarray:
    """Places at which vectors are scaled: every few, and each at which a text ends."""
    return (np.arange(len(reach)) % SCALED_EVERY == SCALED_EVERY - 1) | (np.append(reach[1:], 0) < reach)


def log10_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion, exact for every text. Vectors lie by state, then text."""
    result = np.zeros(len(texts))
    start, step, emit = model.start[:, None], model.step.T.copy(), model.emit.T.copy()
    for group in _groups(texts):
        held, reach = _padded([texts[i] for i in group])
        total = np.zeros(len(group))
        a = None
        for t, scaled in enumerate(_scaled(reach)):
            n = reach[t]
            a = (start if t == 0 else step @ a[:, :n]) * emit.take(held[t, :n], axis=1)
            if scaled:
                scale = a.sum(0)
                a /= scale
                total[:n] += np.log(scale)
        result[group] = total / math.log(10)
    return result


def _forward(model: Model, text: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors and scales of a piece of one text; before: the vector at the end of the piece before."""
    alpha, scales = np.zeros((len(text), len(model.start))), np.ones(len(text))
    for t, seen in enumerate(text):
        a = (model.start if before is None else before @ model.step) * model.emit[seen]
        scales[t] = a.sum()
        before = alpha[t] = a / scales[t]
    return alpha, scales


def _add_long(model: Model, text: np.ndarray, segment: int, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
    """Add the counts of one long text. Forward vectors are kept at the borders only, and made again piece by piece on the way back."""
    pieces = range(0, len(text), segment)
    borders: list[np.ndarray | None] = [None]
    for at in pieces:
        borders.append(_forward(model, text[at : at + segment], borders[-1])[0][-1])
    beta, ahead = np.ones(len(model.start)), None
    for number in range(len(pieces) - 1, -1, -1):
        piece = text[pieces[number] : pieces[number] + segment]
        alpha, scales = _forward(model, piece, borders[number])
        for t in range(len(piece) - 1, -1, -1):
            if ahead is not None:
                step += np.outer(alpha[t], ahead)
                beta = model.step @ ahead
            ahead = model.emit[piece[t]] * beta / scales[t]
            alpha[t] *= beta
        alpha /= np.maximum(alpha.sum(1, keepdims=True), 1e-300)
        for s in range(len(model.start)):
            emit[:, s] += np.bincount(piece, weights=alpha[:, s], minlength=len(emit))
        if number == 0:
            start += alpha[0]


def expected_counts(model: Model, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
    """Baum-Welch counts of start, step and emission, in one flat array."""
    states, classes = len(model.start), len(model.emit)
    start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    for text in texts:
        if len(text) > segment:
            _add_long(model, text, segment, start, step, emit)
    texts = [text for text in texts if len(text) <= segment]
    onward, emitted = model.step.T.copy(), model.emit.T.copy()
    for group in _groups(texts):
        held, reach = _padded([texts[i] for i in group])
        scaled, scales = _scaled(reach), np.ones(held.shape)
        alpha = np.zeros((len(held), states, len(group)))  # by place, state, text
        for t in range(len(held)):
            n = reach[t]
            a = (model.start[:, None] if t == 0 else onward @ alpha[t - 1, :, :n]) * emitted.take(held[t, :n], axis=1)
            if scaled[t]:
                scales[t, :n] = a.sum(0)
                a /= scales[t, :n]
            alpha[t, :, :n] = a
        beta = np.ones((states, len(group)))
        for t in range(len(held) - 1, -1, -1):
            n = reach[t]
            if t + 1 < len(held):
                after = reach[t + 1]
                w = emitted.take(held[t + 1, :after], axis=1) * beta[:, :after]
                if scaled[t + 1]:
                    w /= scales[t + 1, :after]
                step += alpha[t, :, :after] @ w.T
                beta[:, :after] = model.step @ w
            alpha[t, :, :n] *= beta[:, :n]
        start += alpha[0].sum(1)
        for s in range(states):  # sums over states are one, and zero behind the end of a text
            emit[:, s] += np.bincount(held.ravel(), weights=alpha[:, s].ravel(), minlength=classes)
    return np.concatenate([start, (step * model.step).ravel(), emit.ravel()])


def next_model(sums: np.ndarray, mass: np.ndarray, states: int, prior: float = 100.0) -> Model:
    start, step = sums[:states] + 1.0, sums[states : states + states * states].reshape(states, states) + 1.0
    emit = sums[states + states * states :].reshape(-1, states) + prior * mass[:, None]
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Class sequences, about four million tokens at a time."""
    texts, held = [], 0
    for batch in batches:
        for text in _sequences(batch):
            texts.append(text)
            held += len(text)
            if held > 4_000_000:
                yield texts
                texts, held = [], 0
    if texts:
        yield texts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few megabytes of text, or with one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    start = 0
    while start < len(batch):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + TEXT_AT_ONCE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of tokens of each text with its end, all tokens as numbers, and the distinct ones."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    text = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    encoded = split.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy()
    real = codes != (pc.index(encoded.dictionary, "").as_py())
    codes, text = codes[real].astype(np.int64), text[real]
    distinct = pa.concat_arrays([encoded.dictionary, pa.array([END], encoded.dictionary.type)])
    sizes = np.bincount(text, minlength=len(split)).astype(np.int64) + 1
    # every text is followed by one end
    whole = np.full(sizes.sum(), len(distinct) - 1, np.int64)
    whole[np.arange(len(codes)) + text] = codes
    return sizes, whole, distinct


def class_sequences(docs: DataFrame, words_: Vocabulary, doc_id: str, text: str, train: Column) -> DataFrame:
    """Every row with a number of its own (uid), its classes, its share of the unigram score, and its rare words.

    Written, as every round reads it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), train.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in _slices(whole)):
            sizes, codes, distinct = _tokens(batch.column("text"))
            classes, log_p = words_.of(distinct.cast(pa.binary()).to_pylist())
            text = np.repeat(np.arange(len(sizes)), sizes)
            scores_ = log_p[codes]
            rare = np.isnan(scores_)
            ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            n_rare = np.bincount(text[rare], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(uid, uid + len(sizes)), pa.int64()), batch.column("doc_id"), batch.column("train"),
                    pa.array(sizes), pa.array(sizes - n_rare), pa.array(np.bincount(text[~rare], weights=scores_[~rare], minlength=len(sizes)).astype(np.float64)),
                    pa.ListArray.from_arrays(ends(sizes), pa.array(classes[codes])),
                    pa.ListArray.from_arrays(ends(n_rare), distinct.take(pa.array(codes[rare]))),
                ],
                names=["uid", "doc_id", "train", "n_tokens", "n_head", "head_score", "classes", "rare"],
            )
            uid += len(sizes)

    schema = (
        f"uid long, doc_id {dict(rows.dtypes)['doc_id']}, train boolean, n_tokens long, n_head long, head_score double,"
        " classes array<short>, rare array<string>"
    )
    return written(rows.mapInArrow(run, schema), "classes")


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("classes")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def train(sequences: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    model = first_model(mass, states)
    for _ in range(rounds):
        current = model

        def run(batches: Iterator[pa.RecordBatch], current: Model = current) -> Iterator[pa.RecordBatch]:
            total = None
            for texts in _chunks(batches):
                counts = expected_counts(current, texts)
                total = counts if total is None else total + counts
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

        counts = sequences.filter("train").select("classes").mapInArrow(run, "at int, n double")
        sums = np.zeros(states + states * states + states * len(mass))
        for row in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # as many as the model has numbers
            sums[row["at"]] = row["n"]
        model = next_model(sums, mass, states)
    return model


def text_scores(sequences: DataFrame, model: Model, mass: np.ndarray) -> DataFrame:
    """Every row with model_score (log10 of the class sequence) and class_score (the same under the unigram model)."""
    log_mass = np.log10(mass)
    names = ["uid", "doc_id", "train", "n_tokens", "n_head", "head_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _sequences(batch)
            scores_ = [pa.array(log10_likelihoods(model, texts)), pa.array([float(log_mass[t].sum()) for t in texts], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + scores_, names=[*names, "model_score", "class_score"])

    rows = sequences.select(*names, "classes")
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1]) + ", model_score double, class_score double")


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES,
           states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    held_out: a condition on the columns of docs; the other rows are learned from.
    """
    ship_package(docs.sparkSession)
    counts = token_counts(docs.filter(~held_out), text)
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    words_ = vocabulary(counts, n, v, classes)
    sequences = class_sequences(docs, words_, doc_id, text, ~held_out)
    model = train(sequences, words_.mass, states, rounds)
    found = text_scores(sequences, model, words_.mass).join(rare_scores(sequences, counts, n, v), "uid", "left")
    base = F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("model_score") + base - F.col("class_score")).alias("score"),
    )
