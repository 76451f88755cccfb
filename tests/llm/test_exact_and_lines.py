"""Exact dedup, line dedup, mixing, packing: against plain Python, with odd rows."""

import collections
import hashlib
import itertools
import random

import pytest

from folioscan.llm import exact_dedup, line_dedup, mixing, packing

SPACES = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("settings", [{}, {"bucket_bytes": 60, "fan_out": 2}])
def test_exact_groups(odd_documents, settings):
    """Small buckets force spilling over several levels; rows with equal id and text leave one."""
    docs = odd_documents.repartition(3)
    rows = docs.select("doc_id", "text").collect()
    by_text = collections.defaultdict(list)
    for r in rows:
        by_text[low(r["text"])].append(r["doc_id"])
    run = exact_dedup.Grace(docs, **settings)
    assert run.levels > 1 or not settings
    got = run.groups().collect()
    assert len(got) == len(rows)
    kept = collections.Counter()
    shas = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by_text.items()}
    for r in got:
        ids = shas[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(by_text)
    stay = run.survivors()
    assert stay.columns == docs.columns and stay.dtypes == docs.dtypes and stay.count() == len(by_text)
    assert sorted(low(r["text"]) for r in stay.collect()) == sorted(by_text)


def test_content_table_compares_content():
    table = exact_dedup.ContentTable()
    assert table.place(5, b"a") == (0, True) and table.place(5, b"b") == (1, True) and table.place(5, b"a") == (0, False)
    many = [table.place(i % 7, str(i).encode()) for i in range(3000)]
    assert len({n for n, _ in many}) == 3000 and table.place(3, b"10") == (many[10][0], False)


def brute_lines(rows):
    docs = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = low(line.strip(SPACES))
            if len(key) >= 20:
                docs[key].add(doc_id)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in docs.items() if len(v) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keys = [low(line.strip(SPACES)) for line in lines]
        kept = [line for line, k in zip(lines, keys) if k not in last or last[k] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_odd_rows(odd_documents):
    want = brute_lines([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    got = sorted((tuple(r) for r in line_dedup.line_counts(odd_documents).collect()), key=repr)
    assert got == want and sum(r[2] for r in got) == 3


def test_line_dedup_hot_line(spark):
    """A line in nearly all documents takes the salted way."""
    rng = random.Random(1)
    pool = [f"a shared line of some length {i}" for i in range(30)]
    rows = [(i, "\n".join([rng.choice(pool) for _ in range(rng.randint(0, 4))] + ["The One Very Common Line Here"] * (i % 3) + [f"line of document {i} alone"]))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in line_dedup.line_counts(docs).collect()), key=repr) == brute_lines(rows)
    assert line_dedup.line_counts(docs.filter("false")).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            free.remove(s)
    return target


def test_mixing(spark, odd_documents):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(900)]
    rows += [(1000, "lonely words", "tiny"), (1001, None, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(docs).collect()
    sizes = collections.Counter()
    source = {i: s for i, _, s in rows}
    for i, text, s in rows:
        sizes[s] += len((text or "").split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 150 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.taken_words(docs.filter("false")).count() == 0 and mixing.mixed_documents(docs.filter("false")).count() == 0
    odd = mixing.taken_words(odd_documents).collect()
    assert len(odd) == odd_documents.count() and all(r["taken"] <= 3 * r["size"] for r in odd)
    assert mixing.mixed_documents(odd_documents).count() == sum(r["copies"] for r in odd)


def test_best_bounds():
    rng = random.Random(3)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        histogram = [(s, rng.randint(1, 20)) for s in sizes]
        k = rng.randint(1, 5)

        def padding(bounds):
            return sum(n * (min(x for x in bounds if x >= s) - s) for s, n in histogram)

        best = min(padding(c) for r in range(1, min(k, len(sizes)) + 1) for c in itertools.combinations(sizes, r) if c[-1] == sizes[-1])
        assert padding(packing.best_bounds(histogram, k)) == best


def test_packing(spark, odd_documents):
    docs = odd_documents.unionByName(odd_documents).unionByName(odd_documents)
    got = packing.pack_documents(docs, n_buckets=4, budget=64).collect()
    assert len(got) == docs.count()
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["bucket_length"]
        batches[r["batch"]].append(r)
    for rows in batches.values():
        assert len({r["bucket"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert len(rows) * rows[0]["bucket_length"] <= 64 or len(rows) == 1
    assert sorted(batches) == list(range(len(batches)))
    assert packing.pack_documents(docs.filter("false")).count() == 0
    sizes = spark.createDataFrame([(n,) for n in (1, 4095, 4096, 4097, 8191, 8193, 10**6)], "n long").select("n", packing.rounded(packing.F.col("n")).alias("r")).collect()
    assert [r["r"] for r in sizes] == [1, 4095, 4096, 4098, 8192, 8196, 1000192]


def test_one_table_for_each_bucket(spark):
    """Every bucket is a task of its own, within its bytes unless it is one content; ids count, too."""
    rng = random.Random(21)
    rows = [(i, "same text" if i % 3 == 0 else "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    run = exact_dedup.Grace(docs, bucket_bytes=2000)
    sizes = run.found.selectExpr("spark_partition_id() AS p", "octet_length(lower(c1)) AS n").groupBy("p").agg({"n": "sum", "*": "count"}).collect()
    assert max(r["sum(n)"] for r in sizes) <= 2000
    hot = run.spill.filter("c1 = 'same text'")
    assert hot.count() > 3 and hot.selectExpr("max(size(members)) AS n").first()["n"] <= 2000 // 8
    assert sum(r["group_size"] for r in run.groups().filter("kept").collect()) == len(rows)
    empty = exact_dedup.Grace(docs.limit(0))
    assert empty.groups().count() == 0 and empty.survivors().columns == docs.columns and empty.survivors().count() == 0


def test_rows_without_ids_spread(spark):
    """A third of the rows without an id: no block takes them all."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " * (i % 40), "s") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.with_copies(mixing.sized(docs))
    blocks = mixed.groupBy("source", "size_class", "block").count().collect()
    assert max(r["count"] for r in blocks) < 600
    got = mixing.taken_words(docs).collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 150 and len(got) == len(rows)
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.taken_words(docs.repartition(3)).collect()))
    packed = packing.pack_documents(docs.withColumn("text", packing.F.lit("five words of a text"))).collect()
    assert len(packed) == len(rows) and len({(r["batch"], r["slot"]) for r in packed}) == len(rows)
    lengths = docs.select("doc_id", packing.F.lit(7).cast("long").alias("n_tokens"), packing.F.xxhash64("doc_id", "text").alias("code"))
    assert lengths.select("code").distinct().count() == docs.select("doc_id", "text").distinct().count()


def test_texts_that_keep_their_lines_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"line {i} of a document alone\n" + ("a line that many documents share\n" if i < 5 else "")) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sorted((tuple(r) for r in line_dedup.line_counts(docs).collect()), key=repr) == brute_lines(rows)
    plan = line_dedup.deduped(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    below = plan.split("Union", 1)[1]
    assert "may" in below
