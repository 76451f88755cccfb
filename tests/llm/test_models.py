"""Near duplicates, the Markov model and the pipeline: against brute force, with odd rows."""

import collections
import math
import os
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bag_minhash as bm
from folioscan.llm import hmm, near_dedup, queries
from folioscan.llm.common import remainder
from test_texts import brute_counts

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(15):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        w = rng.geometric(0.4, 300)
        v = np.maximum(w + rng.integers(-1, 3, 300), 0)
        v[:30] = 0
        a, b = np.sort(np.repeat(base, w)), np.sort(np.repeat(base, v))
        exact = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        assert bm.overlap(bm.units(a), bm.units(b)) == np.minimum(w, v).sum()
        times = bm.signatures([a, b, np.zeros(0, np.uint64)], 600)
        assert np.isinf(times[2]).all() and np.isfinite(times[:2]).all()
        errors.append((times[0] == times[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    alone = bm.signatures([np.sort(np.repeat(base[:3], 40_000))])
    assert np.isfinite(alone).all()


def brute_classes(rows, percent=80):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags, texts = [], []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        bags.append(collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else collections.Counter())
        texts.append((text or "").encode().lower())
    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            either = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if texts[i] == texts[j] or shared and 100 * shared >= percent * either:
                parent[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {root: min((x for x in v if x is not None), default=None) for root, v in ids.items()}
    return sorted((rows[i][0] is None, rows[i][0] or 0, least[find(i)] is None, least[find(i)] or 0, len(ids[find(i)])) for i in range(len(rows)))


def _got(docs):
    found = near_dedup.document_classes(docs).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"] is None, r["class_id"] or 0, r["class_size"]) for r in found), found


def test_near_classes(spark, monkeypatch):
    """Groups whose members are linked in chains rather than to one lead; small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for group in range(12):
        text = [word() for _ in range(120)]
        for _ in range(rng.choice([1, 2, 20])):
            rows.append((len(rows), " ".join(text)))
            text = text if rng.random() < 0.2 else list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(150)]
    for _ in range(40):  # a hot group at all distances from its base
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, "same few words" if i % 2 else "Same FEW words") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, found = _got(docs)
    assert got == brute_classes(rows)
    assert sum(r["kept"] for r in found) == len({r["class_id"] for r in found})


def test_few_members_apart(spark, monkeypatch):
    """A large class and a few members that only some of it are near to: no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(17)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for _ in range(400):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(60)] = f"v{rng.randint(0, 10**6)}"
        rows.append((len(rows), " ".join(text)))
    for spoiled in (5, 9, 12):  # further and further from the base, at the other end
        text = rows[7][1].split()
        for i in range(0, spoiled):
            text[99 - 6 * (i // 6) - i % 6] = f"u{spoiled}-{i // 4}"
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, f"{' '.join(base[:95])} x{i} y{i} z{i} a{i} b{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, _ = _got(docs)
    assert got == brute_classes(rows)


def test_near_odd_rows(odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    got, _ = _got(odd_documents)
    assert got == brute_classes(rows)
    one = near_dedup.one_of_each(odd_documents)
    assert one.columns == odd_documents.columns and one.count() == len({g[2:4] for g in got})
    assert near_dedup.document_classes(odd_documents.filter("false")).count() == 0
    assert near_dedup.one_of_each(odd_documents.filter("false")).count() == 0


def test_forward_and_counts_match_all_paths():
    rng = np.random.default_rng(2)
    model = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(4), 2).T)
    texts = [np.array(t, np.int32) for t in ([0, 1, 3], [2], [3, 3, 0, 1, 2], [1, 0])]
    counts = np.zeros(2 + 4 + 8)
    for text, score in zip(texts, hmm.log10_likelihoods(model, texts)):
        total, paths = 0.0, []
        for number in range(2 ** len(text)):
            path = [number >> i & 1 for i in range(len(text))]
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= model.step[path[t - 1], path[t]] * model.emit[text[t], path[t]]
            total += p
            paths.append((path, p))
        assert score == pytest.approx(math.log10(total))
        for path, p in paths:
            counts[path[0]] += p / total
            for t, state in enumerate(path):
                counts[6 + 2 * text[t] + state] += p / total
                if t:
                    counts[2 + 2 * path[t - 1] + state] += p / total
    assert np.allclose(hmm.expected_counts(model, texts), counts)


def test_scores(spark, odd_documents):
    rng = random.Random(8)
    pools = [[f"{c}{i}" for i in range(60)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(pools[i % 2]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = remainder(F.col("doc_id"), 7) == 2
    got = hmm.scores(docs, held, classes=64, states=4).collect()
    train = [r for r in docs.filter(~held).collect()]
    counts = collections.Counter(w for r in train for w in [*r["text"].lower().split(), " "])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        tokens = [*texts[r["doc_id"]].lower().split(), " "]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(t in counts for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    unseen = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + 1
    for r in hmm.scores(docs, held, classes=64, states=1, rounds=0).collect():
        assert r["score"] == pytest.approx(r["base_score"])
    assert hmm.scores(docs.filter("false"), held).count() == 0
    odd = hmm.scores(odd_documents, remainder(F.col("doc_id"), 7) == 2).collect()
    assert len(odd) == odd_documents.count() and all(r["score"] < 0 for r in odd)
    nothing = hmm.scores(odd_documents, F.lit(True)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        if name in ("exact_dedup", "near_dedup"):
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len({t.lower() for t in texts}) <= before.count()
    assert docs.count() == before.count() and "batch" in docs.columns


def test_pipeline_odd_rows(spark, odd_documents, tmp_path):
    """Every stage on nulls in all columns, empty and long texts, ties, repeated rows, other columns and no rows at all."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(None, None, None), (3, None, 1)], schema).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents.unionByName(odd_documents.filter("doc_id is null or doc_id < 3"))
    rows = docs.collect()
    low = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")

    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    # without usable labels the base rules decide
    assert sorted(r["text"] for r in kept.collect()) == sorted(r["text"] for r in rows if not brute_counts(r["text"])[-1])
    single = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    assert sorted(low(r["text"]) for r in single.collect()) == sorted({low(r["text"]) for r in rows})
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert near.count() == len({c[2:4] for c in brute_classes([(r["doc_id"], r["text"]) for r in rows])})
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    times = collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    there = collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(n <= 3 * there[row] for row, n in times.items())
    packed = stages["packing"](spark, docs, str(tmp_path))
    assert len({(r["batch"], r["slot"]) for r in packed.collect()}) == len(rows)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@needs_data
def test_registered():
    from __spark_entry__ import oracle_sql, queries as registered

    assert set(queries.QUERIES) | {"pipeline"} <= set(registered()) and set(queries.ORACLES) <= set(oracle_sql())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_long_texts_are_counted_whole():
    """Vectors are carried over the borders of pieces: counts are those of the whole text, which starts once."""
    rng = np.random.default_rng(11)
    mass = rng.dirichlet(np.ones(9))
    model = hmm.first_model(mass, 3)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 2, 7, 40, 41, 100)]
    whole = hmm.expected_counts(model, texts)
    for segment in (1, 3, 7, 40):
        assert np.allclose(hmm.expected_counts(model, texts, segment), whole, rtol=1e-9)
    assert np.isclose(whole[:3].sum(), len(texts)) and np.isclose(whole[12:].sum(), sum(map(len, texts)))


def test_tokens_are_counted_in_parts_of_bounded_size(spark):
    texts = ["A b  a\tÉ", None, "", " \n", "b c d e f g h a", "a\x85b É é", "c"] * 9
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = collections.Counter(w for t in texts for w in [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")), " "])
    for at_once in (1, 4, 1 << 20):
        counts = hmm.token_counts(docs, "text", at_once)
        assert {r["token"]: r["c"] for r in counts.collect()} == want
        assert [t for _, t in counts.dtypes] == ["string", "bigint"]


def test_vectors_scaled_every_few_places_lose_nothing():
    rng = np.random.default_rng(5)
    mass = np.array([1e-20, 1e-18, 0.3, 0.7])
    model = hmm.first_model(mass, 3)
    texts = [rng.integers(0, 4, n).astype(np.int32) for n in (1, 2, 3, 4, 5, 8, 9, 40)] + [np.zeros(50, np.int32)]
    likely = [sum(np.log10(hmm._forward(model, t, None)[1])) for t in texts]
    assert np.allclose(hmm.log10_likelihoods(model, texts), likely, rtol=1e-12)
    counts = hmm.expected_counts(model, texts)
    assert np.allclose(counts, sum(hmm.expected_counts(model, [t], segment=1) for t in texts), rtol=1e-9)
    assert np.isclose(counts[3 + 9:].sum(), sum(map(len, texts)))
