"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from webaudit.plans.catalog import QUERIES
from webaudit.session import local_session

HEADLINES = (
    "issues_by_rule", "page_checks", "leak_mentions", "link_issues", "duplicate_titles",
    "hreflang_reciprocity", "sitemap_drift", "normalize_urls", "dom_links", "robots_allowed",
    "frontier_admission", "crawl_frontier", "strike_backoff", "peak_in_flight", "top_findings",
    "full_audit",
)


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The tables with the pages in ``files`` files, as a cluster's table would be; not timed.

    The given file has one row group, which one task would read whatever the number of cores.
    """
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    for name in os.listdir(sf_dir):
        if name == "pages.parquet":
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{sf_dir}/{name}", f"{folder}/{name}")
    return folder


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = laid_out(spark, given, cores)
    QUERIES["hosts_by_site"](spark, sf_dir).collect()  # start-up is not a query
    timings = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(given).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
