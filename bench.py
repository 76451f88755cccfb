"""Time the headline queries and print one JSON line.

The listing pages are rendered from the driver's orders into Parquet first; that
is landing, not part of any query. Each query is then run in full (``noop``
sink): once cold, then twice warm; the value is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from folioscan.operators import catalogue, extract, links, reports
from folioscan.plans import download
from folioscan.session import build_session, new_path
from folioscan.sources.landed import read_pages
from folioscan.workload import fixtures as fx
from folioscan.workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    landing = new_path(spark, "bench-pages")
    fx.landed_pages(spark, SF_DIR).write.parquet(landing)
    pages = read_pages(spark, landing)

    def coded():
        return catalogue.coded_rows(extract.listing_rows(pages, names=("entry_name",)), fx.BASE_URL)

    def built():
        return catalogue.build_catalogue(pages, fx.BASE_URL)

    headline = {
        "link_extract": lambda: QUERIES["link_extract"](spark, SF_DIR),
        "listing_rows": lambda: extract.listing_rows(pages),
        "exam_entries": lambda: built().entries,
        "exam_files": lambda: built().files,
        "summary": lambda: reports.summary(catalogue.accepted_files(coded())),
        "validation_report": lambda: reports.validation_report(built().files),
        "distinct_values": lambda: extract.distinct_values(extract.listing_rows(pages)),
        "link_dedup": lambda: links.first_links(extract.page_links(pages, fx.BASE_URL)),
        "download_plan": lambda: download.with_target_path(download.download_plan(built().files)),
        "parse_metadata": lambda: QUERIES["parse_metadata"](spark, SF_DIR),
        "url_resolve": lambda: QUERIES["url_resolve"](spark, SF_DIR),
        "norm_whole_texts": lambda: QUERIES["norm_whole_texts"](spark, SF_DIR),
        "file_validate": lambda: QUERIES["file_validate"](spark, SF_DIR),
        "zip_members": lambda: QUERIES["zip_members"](spark, SF_DIR),
    }
    seconds, cold = {}, {}
    for name, make in headline.items():
        times = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        cold[name], seconds[name] = round(times[0], 3), round(statistics.median(times), 3)
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "page_bytes": size,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
