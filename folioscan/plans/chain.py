"""Order of pages along their next-page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscan.session import written


def page_chain(edges: DataFrame, starts: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages reached from each start: ``start_url, page_no, url``.

    A chain ends where there is no next page, where the next page has not
    landed, where it comes back to a page that it has passed, or at
    ``max_pages`` if that is given. Each round doubles the distance covered, so
    a thousand pages take ten joins of the narrow edge table for any number of
    starts; the rounds end when one brings no page that is new for its start.
    Every round is written, which keeps the plan from doubling as well.
    """
    limit = None if max_pages is None else max(max_pages, 1)
    known = edges.groupBy("url").agg(F.min_by("next_url", "page_no").alias("next_url"))
    known = written(known, "chain-edges")
    jumps = known.join(known.select(F.col("url").alias("next_url")), "next_url", "left_semi").select("url", "next_url")
    walked = starts.select(F.col("url").alias("start_url"), F.lit(1).cast("bigint").alias("page_no"), "url").join(
        known.select("url"), "url", "left_semi"
    )
    covered = 1
    while limit is None or covered < limit:
        if covered > 1:
            onward = jumps.select(F.col("url").alias("next_url"), F.col("next_url").alias("far_url"))
            jumps = jumps.join(onward, "next_url").select("url", F.col("far_url").alias("next_url"))
        jumps = written(jumps, "chain-jumps")
        further = walked.join(jumps, "url").select(
            "start_url", (F.col("page_no") + covered).alias("page_no"), F.col("next_url").alias("url")
        )
        further = further if limit is None else further.filter(F.col("page_no") <= limit)
        # a page that a loop leads back to keeps its first number
        further = further.groupBy("start_url", "url").agg(F.min("page_no").alias("page_no"))
        fresh = written(further.join(walked, ["start_url", "url"], "left_anti").select("start_url", "page_no", "url"), "chain-new")
        if fresh.isEmpty():
            break
        walked = written(walked.select("start_url", "page_no", "url").unionByName(fresh), "chain-walked")
        covered *= 2
    return walked
