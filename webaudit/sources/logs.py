"""Reducing crawl logs: redirect hops, browser events, retried fetches and probes.

Every reduction keeps one row per key through ``min``/``max_by`` aggregates, which combine
on the map side, so a key with a huge share of the log costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..operators.checks.console import console_issue, request_issue


def build_redirect_chains(hops: DataFrame) -> DataFrame:
    """``page_id, redirectChain`` in hop order.

    Browsers give up after 20 redirects, which bounds each list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("hop_no", "url")))
    return hops.groupBy("page_id").agg(
        F.transform(ordered, lambda h: h["url"]).alias("redirectChain"))


def console_entries(events: DataFrame) -> DataFrame:
    """Errors and warnings worth keeping: the browser's own 404 notes are reported elsewhere."""
    logged = (F.col("event") == "console") & F.col("type").isin("error", "warning") & ~F.col(
        "text").startswith("Failed to load resource:")
    return events.where(logged | (F.col("event") == "pageerror")).select(
        "page_id", "seq",
        F.when(F.col("event") == "pageerror", "pageerror").otherwise(F.col("type")).alias("type"),
        "text", "location")


def failed_requests(events: DataFrame) -> DataFrame:
    """Failed or refused subresources; aborted ones and the page's own document are not."""
    aborted = F.coalesce(F.col("failure"), F.lit("")).rlike("ERR_ABORTED|NS_BINDING_ABORTED")
    failed = (F.col("event") == "requestfailed") & ~aborted
    refused = (F.col("event") == "response") & (F.col("status") >= 400) & ~F.coalesce(
        F.col("is_main_document"), F.lit(False))
    return events.where(failed | refused).select(
        "page_id", "seq", "url",
        F.when(F.col("event") == "requestfailed", 0).otherwise(F.col("status")).alias("status"),
        "method", F.col("resource_type").alias("resourceType"),
        F.when(F.col("event") == "requestfailed",
               F.coalesce(F.col("failure"), F.lit("unknown"))).alias("failure"))


def request_urls(events: DataFrame) -> DataFrame:
    return events.where(F.col("event") == "request").select("page_id", "seq", "url")


def console_issues_from_log(events: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Console findings straight from the event log: the first of equal texts per page."""
    def entries(df: DataFrame, key: Column, item: Column, late: int) -> DataFrame:
        return df.select("page_id", key.alias("key"), F.lit(late).alias("late"), "seq",
                         item.alias("issue"))

    e = F.struct("type", "text", "location")
    r = F.struct("url", "status", "method", "resourceType", "failure")
    both = entries(
        console_entries(events).withColumn("e", e).withColumn("url", F.lit(None).cast("string")),
        F.col("text"), console_issue(F.col("e"), cfg), 0,
    ).unionByName(entries(
        failed_requests(events).withColumn("r", r),
        F.concat(F.col("status").cast("string"), F.lit(":"), F.col("url")),
        request_issue(F.col("r"), cfg), 1))
    first = both.groupBy("page_id", "key").agg(
        F.min_by("issue", F.struct("late", "seq")).alias("i"))
    return first.select("page_id", "i.*")


def reduce_probe_attempts(attempts: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Link status per URL from its probe log.

    ``duration_ms`` is the time of one attempt. A later attempt supersedes an earlier one
    (GET after a refused HEAD, one retry after no answer); a URL that failed in both rounds
    says so. The time of a URL is that of its last round, from HEAD to the end of GET. ``keys``, one
    of which is ``url``, tell one probe from another where a URL is probed on several occasions.
    """
    rounds = attempts.groupBy(*keys, "round").agg(
        F.max_by(F.struct("status", "final_url", "redirected", "error"), "attempt_no").alias("a"),
        F.sum("duration_ms").alias("spent"))
    last = rounds.groupBy(*keys).agg(
        F.max_by(F.struct("a.*", "round", "spent"), "round").alias("a"))
    failed = F.col("a.status") == 0
    error = F.coalesce(F.col("a.error"), F.lit("request failed"))
    return last.select(
        *keys, F.col("a.status").alias("status"),
        F.when(~failed & (F.col("a.final_url") != F.col("url")),
               F.col("a.final_url")).alias("finalUrl"),
        F.when(~failed & F.coalesce(F.col("a.redirected"), F.lit(False)), 1).otherwise(0)
        .alias("redirects"),
        F.when(failed & (F.col("a.round") > 1), F.concat(error, F.lit(" (retried once)")))
        .when(failed, error).alias("error"),
        F.col("a.spent").alias("durationMs"))


def reduce_page_attempts(attempts: DataFrame, blocked_retries: int = 2,
                         keys: Sequence[str] = ("url",)) -> tuple[DataFrame, DataFrame]:
    """``(results, retries)``: the last fetch of each URL, and retries issued per site.

    A rate-limited fetch with retries left is not a result. ``keys`` tell fetches of one page from
    those of another, where several pages may have the same URL.
    """
    retried = (F.col("status") == 429) & (F.col("attempt_no") <= blocked_retries)
    columns = [c for c in attempts.columns if c not in keys]
    last = attempts.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.col("attempt_no")).alias("a")).select(*keys, "a.*")
    results = last.where(~retried).withColumnRenamed("attempt_no", "attempts")
    return results, attempts.groupBy("site").agg(F.count_if(retried).alias("rateLimited"))
