"""Streaming queries: each reads the driver's files as a stream and has a batch twin as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming as S
from ..functions.urls import normalize_url, site_of
from ..session import scratch_path
from ..sources.html import extract_dom
from . import derived as D
from .check_queries import COLUMNS, found, page_union
from .registry import CONFIG, LINKS, LINK_STATUS, norm, query, site

PAGES = "page_id bigint, url string, html string"
EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")
MONTH = "40 days"  # the test events span one month and arrive in one file, in any order


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream(spark, sf_dir, PAGES, "pages.parquet").withColumn("site", site_of("url"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_stream(spark, sf_dir, EVENTS, "events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.concat(F.lit("h"), "user_id", F.lit(".example.com")).alias("host"), "ts", "event_id",
        F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), 15000)
        .alias("retry_after_ms"))


@query("stream_checks", page_union(f"SELECT {COLUMNS} FROM kept", "self"))
def stream_checks(spark, sf_dir):
    """Findings of all row checks as each page lands."""
    stream = S.page_findings(D.captures_of(_pages(spark, sf_dir)), CONFIG)
    return found(S.run_available(stream, "checks"))


@query("stream_link_issues", f"""
WITH {LINKS}, {LINK_STATUS}
SELECT DISTINCT page_id, CASE WHEN status IN (403, 999) THEN 'link-refused' WHEN status = 0 THEN 'link-unreachable'
 WHEN status = 500 THEN 'link-server-error' WHEN status = 404 THEN 'link-dead' WHEN redirects > 0 THEN 'link-redirects' END AS rule,
 link_url AS target FROM links JOIN link_status USING (link_url) WHERE status <> 200 OR redirects > 0
UNION ALL SELECT DISTINCT page_id, 'link-slow', link_url FROM links JOIN link_status USING (link_url)
 WHERE status <> 0 AND duration_ms > 15000""")
def stream_link_issues(spark, sf_dir):
    """Pages as a stream, joined to the static table of probe results."""
    from ..operators.frontier import probe_worklist
    static = D.html_captures(spark, sf_dir, "links")
    status = D.link_status(probe_worklist(static, CONFIG))
    pages = extract_dom(_pages(spark, sf_dir), surfaces=("links",)).withColumn(
        "seq", F.col("page_id"))
    stream = S.probe_findings(pages, status, CONFIG)
    return S.run_available(stream, "links").select(F.col("seq").alias("page_id"), "rule", "target")


@query("stream_page_sink", f"SELECT {site('url')} AS site, count(*) AS pages FROM pages GROUP BY 1")
def stream_page_sink(spark, sf_dir):
    """A per-batch hook that writes its own table, keyed by batch so a re-run overwrites."""
    out = scratch_path(spark, "sink")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("site").agg(F.count("*").alias("pages")).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")

    S.per_batch(_pages(spark, sf_dir).select("site", "page_id"), write,
                scratch_path(spark, "sink-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("site").agg(F.sum("pages").alias("pages"))


@query("stream_dedupe", f"""SELECT DISTINCT {norm('url')} AS url FROM pages WHERE {norm('url')} NOT LIKE '%.html'
 AND {norm('url')} NOT IN (SELECT {norm('url')} FROM pages WHERE page_id % 10 = 4)""")
def stream_dedupe(spark, sf_dir):
    """URLs to probe, each once, without those whose status is known."""
    links = _pages(spark, sf_dir).select(
        F.explode(F.array(F.col("url"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))))
        .alias("url"))
    known = D.pages(spark, sf_dir).where("page_id % 10 = 4").select(normalize_url("url").alias("url")).distinct()
    cfg = CONFIG.with_(ignorePatterns=(".html",))
    out, mark = scratch_path(spark, "probe-once"), scratch_path(spark, "probe-mark")
    S.probe_batches(links, cfg, out, mark, known).awaitTermination()
    return spark.read.schema("url string").parquet(out).select("url")


_TICK = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS pages,
 CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
 CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM events GROUP BY 1"""


def _scored(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select(
        "ts", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("errors"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("warnings"))


def _updated(stream: DataFrame, name: str) -> DataFrame:
    """Windows in update mode: the newest row of each, closed or not."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    S.upsert_batches(stream, out, scratch_path(spark, f"{name}-state")).awaitTermination()
    return S.latest(spark, out, stream.schema, ["start", "end"])


def _closed(log: DataFrame) -> DataFrame:
    """A finite log followed by an event long after it, which closes what the log left open."""
    spark, path = log.sparkSession, scratch_path(log.sparkSession, "last-event")
    spark.range(1).select(*[(F.to_timestamp(F.lit("2100-01-01")) if f.name == "ts" else F.lit(None))
                            .cast(f.dataType).alias(f.name) for f in log.schema.fields]).write.parquet(path)
    return log.unionByName(spark.readStream.schema(log.schema).parquet(path))


@query("stream_heartbeat", f"SELECT *, pages / 60.0 AS pages_per_min FROM ({_TICK})")
def stream_heartbeat(spark, sf_dir):
    return _updated(S.heartbeat(_scored(spark, sf_dir), "1 hour"), "heartbeat").drop("end").withColumn(
        "start", F.col("start").cast("timestamp_ntz"))


@query("stream_heartbeat_sliding", """
WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events)
SELECT b - INTERVAL 1 HOUR * k AS start, count(*) AS pages FROM e, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1""")
def stream_heartbeat_sliding(spark, sf_dir):
    stream = S.heartbeat(_scored(spark, sf_dir), "3 hours", "1 hour")
    return _updated(stream, "sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "pages")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT 'h' || user_id || '.example.com' AS host, min(ts) AS start, count(*) AS requests FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf_dir):
    stream = S.crawl_sessions(_closed(_log(spark, sf_dir)), "1 day", MONTH)
    return S.run_available(stream, "sessions").where("host IS NOT NULL").select(
        "host", F.col("start").cast("timestamp_ntz").alias("start"), "requests")


@query("stream_backoff", """
WITH hits AS (SELECT 'h' || user_id || '.example.com' AS host, event_id, epoch_us(ts) AS us,
  CASE WHEN event_id % 3 = 0 THEN 15000 END AS retry FROM events WHERE event_type = 'error'),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 86400000000 THEN 0 ELSE 1 END AS fresh FROM hits
 WINDOW w AS (PARTITION BY host ORDER BY us, event_id)),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY us, event_id) AS epoch FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY host, epoch ORDER BY us, event_id) AS strike FROM e),
w AS (SELECT *, CAST(least(greatest(10000 * power(2, strike - 1), coalesce(retry, 0)), 60000) AS BIGINT) AS wait_ms FROM s)
SELECT host, event_id, CAST(strike AS BIGINT) AS strike, wait_ms, CAST(max(us // 1000 + wait_ms) OVER (PARTITION BY host ORDER BY us, event_id) AS BIGINT) AS cooldown_until_ms FROM w""")
def stream_backoff(spark, sf_dir):
    cfg = CONFIG.with_(forgetMs=86_400_000)
    out, state, mark = (scratch_path(spark, n) for n in ("strikes", "strike-state", "strike-mark"))
    S.strike_batches(_log(spark, sf_dir), cfg, out, state, mark).awaitTermination()
    return spark.read.parquet(out).select(
        "host", "event_id", F.col("strike").cast("bigint").alias("strike"), "wait_ms", "cooldown_until_ms")


@query("stream_retry", """
SELECT url, CASE page_id % 10 WHEN 6 THEN 429 ELSE 200 END AS status, CASE page_id % 10 WHEN 3 THEN 2 WHEN 6 THEN 3 ELSE 1 END AS attempts,
 CASE page_id % 10 WHEN 3 THEN 1 WHEN 6 THEN 2 ELSE 0 END AS retried FROM pages WHERE page_id % 10 <> 9""")
def stream_retry(spark, sf_dir):
    """Rate-limited fetches are offered again; only the fetch that counts comes out."""
    return S.run_available(S.final_captures(D.page_attempts(_pages(spark, sf_dir)), CONFIG), "retry")
