"""The same operators over a landing folder that keeps growing.

Checkpoints and outputs live in folders that all executors share. Each batch is
written to its own folder in overwrite mode, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan import schemas
from folioscan.operators import catalogue, extract, fetch, links
from folioscan.plans import download
from folioscan.session import STATE_STORE, drop_path
from folioscan.sources import sinks


_PARTITIONS = "spark.sql.shuffle.partitions"


def stream_pages(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.LANDED_PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_responses(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.RESPONSES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    """Run all that has landed, batch by batch; state is kept in RocksDB, on the disks of the executors.

    Every batch commits every partition of the state, so a new stream has no more of them than
    two for each core. The number is taken over at the start and belongs to the checkpoint.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    partitions = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(min(int(partitions), 2 * spark.sparkContext.defaultParallelism)))
    try:
        return (
            df.writeStream.outputMode(mode)
            .foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_PARTITIONS, partitions)


def _dealt(pages: DataFrame) -> DataFrame:
    """The pages of a batch over all cores: its few files alone would keep as many tasks busy."""
    return pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism)


def fresh_links(found: DataFrame) -> DataFrame:
    """Links of a stream whose URL no earlier batch has had, each with its first place in the batch.

    For update mode. The state holds the time of the batch that a URL was first seen in,
    which a repeated batch finds unchanged: only URLs first seen now are let through. As an
    aggregation it has a map-side part, so a URL that fills a third of the links gives
    one row for each task and batch. Seen URLs are kept as long as the stream lives.
    """
    first = F.min(F.struct("seen", "page_no", "link_no", "data_name"))
    known = found.withColumn("seen", F.current_timestamp()).groupBy("url").agg(first.alias("first"))
    return known.filter(F.col("first.seen") == F.current_timestamp()).select(
        "url", "first.page_no", "first.link_no", "first.data_name"
    )


def start_new_links(pages: DataFrame, base_url: str, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Links not seen before in the stream, one row per URL."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return _start(fresh_links(extract.page_links(_dealt(pages), base_url, **options)), write, checkpoint, "update")


def _write_state(output: str) -> Callable[[DataFrame, int], None]:
    """Each batch writes all that is known; tables before the last one are dropped, as no repeated batch needs them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")
        drop_path(batch.sparkSession, f"{output}/batch={number - 2}")

    return write


def _latest(spark: SparkSession, output: str) -> DataFrame:
    """The last written state; its batch number is found from the folders alone."""
    known = spark.read.parquet(output)
    last = known.agg(F.max("batch").alias("batch"))
    return known.join(F.broadcast(last), "batch").drop("batch")


def start_distinct_values(pages: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Running counts of raw label values: one row for each value, however many batches there were."""
    counts = extract.label_values(extract.listing_rows(_dealt(pages))).groupBy("field", "value").agg(F.count("*").alias("n"))
    return _start(counts, _write_state(output), checkpoint, "complete")


def latest_distinct_values(spark: SparkSession, output: str) -> DataFrame:
    """Current counts: ``field, value, n``."""
    return _latest(spark, output).select("field", "value", "n")


def start_statistics(responses: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Running number and bytes of valid responses per file type."""
    good = fetch.described(responses).filter(F.col("error").isNull() & F.col("valid"))
    counts = good.groupBy("extension").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return _start(counts, _write_state(output), checkpoint, "complete")


def latest_statistics(spark: SparkSession, output: str) -> DataFrame:
    """Current statistics: ``extension, n, bytes``."""
    return _latest(spark, output).select("extension", "n", "bytes")


def start_page_by_page(pages: DataFrame, base_url: str, output: str, checkpoint: str) -> StreamingQuery:
    """After each batch of pages: its entries, its new links, and the entry of each new link.

    Coded rows and new links leave the stream as one table, which is written once for each
    batch (``items``, by kind); all else is made from that. What is new is known from the
    state of the stream: nothing that earlier batches wrote is read again, but for one
    row with their highest id. The work for a batch depends on its own pages only.

    A repeated batch gives the same rows in the same folders. Files also go into the layout
    by year and subject, below a folder for the batch.
    """
    dealt = _dealt(pages)
    rows = catalogue.coded_rows(extract.listing_rows(dealt, names=("entry_name",)), base_url)
    fresh = fresh_links(extract.page_links(dealt, base_url))
    items = rows.withColumn("kind", F.lit("row")).unionByName(fresh.withColumn("kind", F.lit("link")), allowMissingColumns=True)

    def handle(batch: DataFrame, number: int) -> None:
        # the session of a batch plans without adaptive execution, which holds for the stream alone
        spark = pages.sparkSession
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{output}/items/batch={number}")
        held = spark.read.schema(items.schema).parquet(f"{output}/items/batch={number}")
        coded = held.filter("kind = 'row'").select(*rows.columns)
        highest = spark.read.parquet(f"{output}/last/batch={number - 1}").first()["id"] if number else 0
        catalogue.Catalogue(coded, highest + 1).files.write.mode("overwrite").parquet(f"{output}/files/batch={number}")
        files = spark.read.parquet(f"{output}/files/batch={number}")
        last = files.agg(F.coalesce(F.max("id"), F.lit(highest)).cast("bigint").alias("id"))
        last.write.mode("overwrite").parquet(f"{output}/last/batch={number}")
        plan = download.with_target_path(download.download_plan(files))
        sinks.write_by_year_and_subject(plan, f"{output}/layout/batch={number}")
        new = held.filter("kind = 'link'").select(*fresh.columns)
        links.with_entries(new, files).write.mode("overwrite").parquet(f"{output}/links/batch={number}")

    return _start(items, handle, checkpoint, "update")
