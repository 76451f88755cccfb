"""Consecutive numbers over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGE_SPAN = 1 << 16  # pages whose counts are summed together
ROW_BLOCK = 1 << 20  # rows of one page that are numbered together


def number_rows(rows: DataFrame, first: Column, id_column: str = "id", start: int = 1) -> DataFrame:
    """Number the distinct (page_no, row_no) start, start+1, … in that order.

    Rows with the same key, such as the files of one listing row, share a number;
    ``first`` holds for exactly one of them.
    Keys are numbered inside blocks of at most ``ROW_BLOCK`` row numbers of a
    page, so one huge page is split over many tasks. Block counts are summed up
    inside spans of ``PAGE_SPAN`` pages, and only span totals, one row for
    65,536 pages, meet in a single task. The rows are exchanged once.

    ``rows`` is read twice (numbers and counts): pass a written table.
    """
    keyed = rows.withColumn("block", F.floor(F.col("row_no") / ROW_BLOCK))
    span = F.floor(F.col("page_no") / PAGE_SPAN)

    counts = keyed.groupBy("page_no", "block").agg(F.count_if(first).alias("n")).withColumn("span", span)
    before = (Window.unboundedPreceding, -1)
    in_span = Window.partitionBy("span").orderBy("page_no", "block").rowsBetween(*before)
    over_spans = Window.orderBy("span").rowsBetween(*before)
    totals = counts.groupBy("span").agg(F.sum("n").alias("n"))
    totals = totals.select("span", F.coalesce(F.sum("n").over(over_spans), F.lit(0)).alias("span_start"))
    starts = counts.select(
        "page_no", "block", "span", F.coalesce(F.sum("n").over(in_span), F.lit(0)).alias("block_start")
    ).join(totals, "span")
    starts = starts.select("page_no", "block", (F.col("span_start") + F.col("block_start")).alias("offset"))

    in_block = F.dense_rank().over(Window.partitionBy("page_no", "block").orderBy("row_no"))
    numbered = keyed.withColumn("in_block", in_block).join(starts, ["page_no", "block"])
    number = (F.col("offset") + F.col("in_block") + F.lit(start - 1)).cast("bigint")
    return numbered.withColumn(id_column, number).drop("block", "in_block", "offset")
