"""Queries over rows that only larger tables hold."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.functions import markup
from folioscan.operators import fetch
from folioscan.session import written
from folioscan.sources import landed
from folioscan.workload.queries import QUERIES


def shown(size: int) -> str:
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        if size < 1024 ** (power + 1):
            return f"{size / 1024**power:.2f} {unit}"
    return f"{size / 1024**5:.2f} PB"


def test_format_bytes_of_sizes_past_64_bits(spark, tmp_path):
    keys = [0, 1, 2, 3, 55_107, 55_111, 900_002, 9_000_003, 54_000_003]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    sizes = {k: (k, k**2, k**3 * 17, k**4)[k % 4] for k in keys}
    got = {row["row_key"]: row["shown"] for row in QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {k: shown(size) for k, size in sizes.items()}
    # past 38 digits a size is a double
    huge = 5_000_000_003
    spark.createDataFrame([(huge,)], "o_orderkey bigint").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    number, unit = QUERIES["format_bytes"](spark, str(tmp_path)).first()["shown"].split()
    assert (float(number), unit) == (pytest.approx(huge**4 / 1024**5), "PB")


def test_rows_and_cells_are_cut_by_patterns_that_are_compiled_once(spark):
    """``split`` compiles its pattern for every text, so none may work on single rows or cells."""
    from folioscan.operators import extract

    pages = spark.createDataFrame([(1, "u", "<tbody><tr><td>a</td><td>b<td> c <b> d</b></td><td>&eacute;</td><td><a href=x>")], "page_no bigint, url string, html string")
    rows = extract.listing_rows(pages)
    assert [tuple(row)[:6] for row in rows.collect()] == [(1, 1, "a", "b", "cd", "é")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(row" not in plan and "split(cell" not in plan.split("array_join")[0] and "[Tt][Rr], 2)" not in plan


def test_running_sum_of_many_blocks(spark):
    from pyspark.sql import functions as F

    from folioscan.functions import nesting

    values = [(i * 7) % 5 - 2 for i in range(40_000)]
    sums = spark.createDataFrame([(values,)], "v array<int>").select(nesting.running_sum(F.col("v"))).first()[0]
    assert sums == [sum(values[: i + 1]) for i in range(0, 200)] + sums[200:] and sums[-1] == sum(values)


def test_streams_have_state_for_the_cores_and_leave_the_session_alone(spark, tmp_path):
    from folioscan import schemas
    from folioscan.streaming import landing

    page = "<tbody><tr><td>2024</td><td>b</td><td>c</td><td>d</td><td></td></tr></tbody>"
    spark.createDataFrame([(n, "u", page) for n in range(8)], schemas.LANDED_PAGES).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pages = landing.stream_pages(spark, str(tmp_path / "in"), files_per_batch=4)
        landing.start_distinct_values(pages, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    partitions = [p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(partitions) == 2 * spark.sparkContext.defaultParallelism
    found = landing.latest_distinct_values(spark, str(tmp_path / "out")).collect()
    assert sorted((row["field"], row["value"], row["n"]) for row in found) == [
        ("Discipline", "b", 8), ("Localisation", "d", 8), ("Serie", "c", 8), ("Session", "2024", 8)
    ]


def test_failures_are_worked_out_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from folioscan.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def error(n):
        seen.add(1)
        return f"503 {n}"

    failures = spark.range(0, 20, 1, 1).select(F.lit("u").alias("url"), error("id").alias("error"), F.current_timestamp().alias("timestamp"))
    assert sinks.write_failures(failures, str(tmp_path / "failures"))
    assert (seen.value, sinks.read_failures(spark, str(tmp_path / "failures")).count()) == (20, 20)
    assert not sinks.write_failures(failures.filter("url = 'x'"), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_archive_batches_are_bounded():
    from folioscan.sources import archives

    rows = [((f"{n}.zip", "text.txt", 1 << 20, b"x" * (1 << 20), None), 1 << 20) for n in range(10)]
    batches = list(archives.in_batches(iter(rows), archives._MEMBERS))
    assert [batch.num_rows for batch in batches] == [4, 4, 2]
    assert [tuple(row.values()) for batch in batches for row in batch.to_pylist()] == [row for row, _ in rows]


def test_values_and_frequent_references_take_no_second_pattern(spark):
    """A value is cut without its quotes by the pattern that finds it; frequent references need no tokens."""
    assert "regexp_replace" not in str(markup.attribute(F.col("tag"), "href"))
    assert "&eacute;" in str(markup.decode_references(F.col("html")))
    tags = {
        "<a href=\"a'b\">": "a'b", "<a href='a\"b'>": 'a"b', "<a href=ab>": "ab", "<a href = \"\">": "", "<a href='&lt;&amp;'>": "<&",
        "<a title=\"href='x'\" href=y>": "y", "<a>": "", "<a href=\"'a'\">": "'a'",
    }
    texts = {
        "&nbsp;&eacute;": "\xa0é", "&ea&nbsp;cute;": "&ea\xa0cute;", "&amp;nbsp;": "&amp;nbsp;", "&#38;eacute;": "&amp;eacute;",
        "&&eacute;;": "&é;", "&eacute": "&eacute", "&rsquo;&oelig;&#233;": "’œé",
    }
    pages = {
        "a<!-- - -- x --->b": "a<!>b", "a<!--": "a<!>", "a<!---->b": "a<!>b", "<script a='>'>< </scr</SCRIPT >c": "<!>c", "<style>x</script>": "<!>",
        "<s>a</s><scripty>b": "<s>a</s><scripty>b",
    }
    for cases, found in ((tags, lambda c: markup.attribute(c, "href")), (texts, markup.decode_references), (pages, markup.visible)):
        rows = spark.createDataFrame(list(cases.items()), "given string, want string")
        for row in rows.select("want", found(F.col("given")).alias("got")).collect():
            assert row["got"] == row["want"]


def test_listing_many_small_files_takes_a_few_tasks_for_each_core(spark, tmp_path):
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    bodies = {f"{i}.pdf": b"%PDF" + b"x" * i for i in range(3 * most)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # each file is a task of its own
        files = landed.list_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= most
        judged = fetch.kept_verdicts(files).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert {r["path"].rsplit("/", 1)[1]: r["size"] for r in judged} == {name: len(body) for name, body in bodies.items()}


def test_tables_inside_tables_are_cut_without_slices_of_whole_pages(spark):
    """``slice`` took each cell, row and block out of the arrays of the whole page."""
    from folioscan.functions import nesting
    from folioscan.functions.markup_parser import rows_of

    assert "slice" not in str(nesting.nested_rows(F.col("html"), markup.MIN_CELLS))
    row = "<tr><td>{0}<td>b<table><tr><td>in {0}</table></td><th>h<td>c</td><td></td><td><a href=x>{0}</a></td></tr>"
    html = "<table><tbody>" + "".join(row.format(i) for i in range(700)) + "</table><tr><td>out"
    got = spark.createDataFrame([(html,)], "html string").select(F.inline(nesting.nested_rows(F.col("html"), markup.MIN_CELLS))).collect()
    assert [r["row_no"] for r in got] == [r["row_no"] for r in rows_of(html)] == list(range(1, 1401, 2))
    assert [r["cells"][0] for r in got] == [str(i) for i in range(700)] and got[-1]["cells"][2] == "in 699"
    values = [(i * 5) % 7 - 3 for i in range(1100)]
    sums = spark.createDataFrame([(values[:n],) for n in (0, 1, 7, 8, 9, 64, 513, 1100)], "v array<int>").select(nesting.running_sum(F.col("v"))).collect()
    assert [r[0] for r in sums] == [[sum(values[: i + 1]) for i in range(n)] for n in (0, 1, 7, 8, 9, 64, 513, 1100)]


def _odd_folder(folder):
    names = ["a.pdf", "é b.PDF", "100%.txt", "x#y.txt", "[b].txt", "noext", "_a=b.txt", "_hidden.txt", ".dot", "c._COPYING_", "_metadata"]
    names += ["deep/er/q.zip", "d=1/e=2/f.txt", "_bodies_1/2/x.pdf", ".h/x.txt", "_p=1/x.txt", *(f"many/{i}.pdf" for i in range(200)), *(f"{i}/same.pdf" for i in range(40))]
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"%PDF" + name.encode())
    (folder / "empty.pdf").write_bytes(b"")
    (folder / "link.pdf").symlink_to("a.pdf")
    (folder / "broken.pdf").symlink_to("nowhere")
    (folder / "linked").symlink_to("deep")
    for at, name in enumerate(("a.pdf", "100%.txt", "x#y.txt")):
        os.utime(folder / name, ns=(0, (0, -1_500_001, 1_700_000_000_123_999_999)[at]))


def test_folders_are_listed_by_the_tasks_as_the_scan_lists_them(spark, tmp_path, monkeypatch):
    """The scan's list of all files was held by the driver, and made a task for every few of them."""
    _odd_folder(tmp_path)
    rows = lambda files: sorted(map(tuple, files.select("path", "length", F.unix_micros("modificationTime")).collect()))
    cases = [(root, glob) for root in (str(tmp_path), f"file://{tmp_path}/", str(tmp_path / "deep")) for glob in ("*", "*.{pdf,PDF}", "[!a]*.???", "same.pdf")]
    want = [rows(landed.read_files(spark, *case)) for case in cases]
    monkeypatch.setattr(landed, "read_files", lambda *a: pytest.fail("listed by the driver"))
    for case, expected in zip(cases, want):
        assert rows(landed.list_files(spark, *case)) == expected
    # each file has one share, and the shares are even within a folder and over folders
    shares = [[path for path, _, _ in landed._share(str(tmp_path), ".*pdf", n, 4)] for n in range(4)]
    assert sorted(p for share in shares for p in share) == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.pdf") if p.exists() and p.stat().st_size and "_bodies" not in str(p))
    assert all(30 <= sum(p.startswith("many/") for p in share) <= 70 and sum("same" in p for p in share) >= 3 for share in shares)


def test_a_list_of_files_stays_as_it_was(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    files = landed.list_files(spark, str(tmp_path))
    (tmp_path / "later.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    for _ in range(2):
        assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.pdf"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landed.list_files(spark, str(tmp_path / "nothing"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in landed.list_files(spark, str(tmp_path / "*.pdf")).collect()) == ["a.pdf", "later.pdf"]


def test_verdicts_of_a_later_run_scan_no_folder_and_join_once(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"{i}.pdf").write_bytes(b"%PDF" + b"x" * (1000 + i))
    known = fetch.kept_verdicts(landed.list_files(spark, str(tmp_path))).filter("size % 2 = 0")
    known = known.unionByName(known).withColumn("valid", F.when(F.col("size") != 1010, F.col("valid")))  # twice, and one without a verdict
    now = fetch.kept_verdicts(landed.list_files(spark, str(tmp_path)), written(known, "verdicts"))
    plan = now._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and plan.count("Join ") == 1
    got = {r["size"]: (r["valid"], r["judged"]) for r in now.collect()}
    assert got == {n: (None if n == 1010 else n >= 1024, n % 2 == 1) for n in range(1004, 1054)}


def test_small_files_are_opened_together_and_large_ones_alone(tmp_path):
    """A batch for each file cost more than to open it."""
    sizes = [100] * 300 + [3 << 20] * 3 + [9 << 20, 1]
    for i, size in enumerate(sizes):
        (tmp_path / str(i)).write_bytes(bytes([i % 251]) * size)
    names = [f"file:{tmp_path}/{i}" for i in range(len(sizes))] + [f"file:{tmp_path}/gone"]
    given = pa.RecordBatch.from_pydict({"path": names, "held": [None] + [False] * (len(sizes) - 1) + [True]})
    batches = list(landed._filled(iter([given]), "held"))
    assert [b.num_rows for b in batches] == [301, 1, 1, 1, 2]
    rows = [row for batch in batches for row in batch.to_pylist()]
    assert [r["path"] for r in rows] == names and rows[-1]["content"] is None
    assert all(r["content"] == bytes([i % 251]) * sizes[i] for i, r in enumerate(rows[:-1]))
    plain = given.slice(0, 300).select(["path"])
    assert [b.num_rows for b in landed._filled(iter([plain]), None)] == [300]
