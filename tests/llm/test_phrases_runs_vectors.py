"""Periodic runs, collocations and nearest neighbours: against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import collocations, nearest, periodic_runs, queries


def brute_lyndon(codes):
    """Longest Lyndon words by their definition."""
    def is_lyndon(w):
        return all(w < w[i:] for i in range(1, len(w)))

    return [max(j - i for j in range(i + 1, len(codes) + 1) if is_lyndon(codes[i:j])) for i in range(len(codes))]


def brute_runs(words, exponent=4, least=6):
    found = []
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                found.append((i, length, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        words += unit * rng.choice([1, 1, 2, 3, 4, 5, 9]) + unit[: rng.randint(0, len(unit))]
    return words


def test_lyndon_arrays_by_grouping():
    rng = random.Random(2)
    for n in [1, 2, 3, 5, 8, 13, 24, 40] * 12:
        codes = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(n)]
        for order in (codes, [-c for c in codes]):
            lengths, groups = periodic_runs.lyndon(order)
            assert lengths == brute_lyndon(order)
            words = [tuple(order[i : i + k]) for i, k in enumerate(lengths)]
            assert len(set(zip(words, groups))) == len(set(words)) == len(set(groups))


@pytest.mark.parametrize("exponent, least", [(4, 6), (3, 1), (5, 12)])
def test_runs_against_brute_force(spark, exponent, least):
    rng = random.Random(exponent)
    texts = [" ".join(repetitive(rng, rng.randint(0, 120), "abcdefgh"[: rng.randint(1, 8)])) for _ in range(150)]
    texts += ["a " * 3000, "a b " * 2000 + "c", " ".join(f"w{i}" for i in range(500)) * 5, None, "", " \t\n", "é é é é é é", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    rows = periodic_runs.periodic_runs(docs, min_exponent=exponent, min_length=least).collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        words = (texts[r["row"]["doc_id"]] or "").split()
        runs = [tuple(x) for x in r["runs"]]
        if len(words) < 300:
            assert runs == brute_runs(words, exponent, least)
        seen += len(runs)
        assert r["collapsed"] == collapsed(words, runs) and r["row"]["runs"] == 1
    assert seen > 50


def test_runs_query_rules(spark, tmp_path, odd_documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 200)))) for i in range(200)]
    rows += [(200, None), (201, ""), (10, "again the same id"), (None, "no id but some words here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    want = collections.Counter()
    for doc_id, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
              sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(words, runs)))] += 1
    assert got == want
    assert periodic_runs.digest(periodic_runs.periodic_runs(odd_documents)).count() == odd_documents.count()
    assert periodic_runs.periodic_runs(odd_documents.limit(0)).count() == 0


def brute_collocations(rows, min_count, top, percent=100, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    good = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    held = collections.Counter()
    for (lang, w), a in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i : i + k]] = max(held[lang, w[i : i + k]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in good.items():
        if 100 * held[lang, w] < percent * a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, each in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(each)[:top], 1)
    )


@pytest.mark.parametrize("settings", [{}, {"bits": 64, "hot": 4, "bytes_at_once": 2000}, {"percent": 90, "hot": 1 << 20, "longest": 4}])
def test_collocations_against_brute_force(spark, settings):
    rng = random.Random(13)
    vocabulary = ["the", "of", "Time", "ÉTÉ", "été", "a_b", "a", "b", "c", "New", "York", "City", "😀", "x" * 300]
    def text():
        words = [rng.choices(vocabulary, range(len(vocabulary), 0, -1))[0] for _ in range(rng.randint(0, 60))]
        return "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words) + "New York City " * rng.randint(0, 3)

    rows = [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(300)] + [(None, "en"), ("", None), (" \t.,", "fr"), ("the of " * 5000, "en")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "text string, lang string, phrase string, n int")
    got = collocations.collocations(docs, min_count=20, top=40, **settings).collect()
    want = brute_collocations(rows, 20, 40, settings.get("percent", 100), settings.get("longest", 5))
    assert sorted(map(tuple, got)) == want and len(want) > 40


def test_collocations_odd_rows(spark, odd_documents):
    assert collocations.collocations(odd_documents.limit(0)).count() == 0
    rows = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    got = collocations.collocations(odd_documents, min_count=2, top=None).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 2, 1 << 30)
    big = spark.createDataFrame([(10**12, 10**13)], "a long, n long")
    product = (collocations._exact(big.a) * collocations._exact(big.n) * 1000).cast("decimal(38,0)")
    assert int(big.select(product).first()[0]) == 10**28


def brute_nearest(rows, k, asked):
    """Exact answers for distinct (id, vector) rows that take part."""
    good = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[vec_id, tuple(np.float32(x).item() + 0.0 for x in v)] = None
    found = {}
    for q_id, q in good:
        if asked(q_id):
            scored = []
            for vec_id, v in good:
                if vec_id != q_id and len(v) == len(q):
                    total = 0.0
                    for x, y in zip(q, v):
                        total += x * y
                    scored.append((-total, vec_id))
            found[q_id, q] = [(vec_id, -s) for s, vec_id in sorted(scored)[:k]]
    return found


def recall_of(got, want, k):
    """Share of the exact neighbours found; every score must be exact and in order."""
    by_query = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by_query) == {q for (q, _), near in want.items() if near}
    hits = total = 0
    for (q, _), near in want.items():
        mine = by_query[q]
        assert len(mine) == len(near) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len(set(mine) & set(near))
        total += len(near)
    return hits / total


@pytest.mark.parametrize("kind", ["unit", "clusters", "lengths"])
def test_nearest_recall(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 3000, 24
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] * 4 + 0.3 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, (n, 1))
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.nearest(df, F.col("id") % 20 == 0, shard_size=800).collect()
    assert recall_of(got, brute_nearest(rows, 20, lambda i: i % 20 == 0), 20) >= 0.95


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(6)
    one = lambda: [float(np.float32(c)) for c in rng.normal(size=5)]
    common, rows = one(), []
    rows += [(i, common) for i in range(0, 300)] + [(i, one()) for i in range(300, 500)] + [(7, common)] * 5
    rows += [(500, None), (None, one()), (502, [0.0] * 5), (503, []), (504, [1.0, None, 2.0, 0.0, 0.0]), (505, [math.nan] + one()[1:]),
             (506, [math.inf] * 5), (520, [1.0, 2.0]), (521, [2.0, 1.0]), (540, [-0.0, 0.0, 1.0, 0.0, 0.0]), (541, [0.0, 0.0, 1.0, 0.0, 0.0]),
             (560, [1e30] * 5), (580, [3.0])]
    df = spark.createDataFrame([(*r, 1, "s", 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, shard string, score double")
    want = brute_nearest(rows, 20, lambda i: i % 20 == 0)
    for settings in ({}, {"shard_size": 64}):
        got = nearest.nearest(df, F.col("id") % 20 == 0, **settings).collect()
        assert recall_of(got, want, 20) == 1.0
    assert nearest.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest.nearest(df, F.col("id") < 0).count() == 0
    few = df.filter("vec_id in (520, 521)")
    assert [tuple(r) for r in nearest.nearest(few, F.col("id") == 520).collect()] == [(520, 1, 521, 4.0)]
