"""Stream transformations.

Each has a batch twin in ``operators``; watermarks bound the state that the original keeps
for the length of a run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import AuditConfig
from ..functions.urls import matches_ignore_pattern, normalize_url
from ..operators.backoff import SLICE, strike_backoff, strike_state
from ..operators.checks import check_links
from ..plans.audit import run_page_checks

CAPTURE_DELAY = "10 minutes"


def page_findings(captures: DataFrame, cfg: AuditConfig, link_status: DataFrame | None = None
                  ) -> DataFrame:
    """Findings as each page lands: the batch page pass, stateless, in append mode.

    Link findings join the stream to a static table of probe results.
    """
    return run_page_checks(captures, cfg, link_status)


def probe_findings(captures: DataFrame, link_status: DataFrame, cfg: AuditConfig) -> DataFrame:
    return check_links(captures, link_status, cfg)


def per_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``fn(batch, batch_id)`` for each micro-batch of results."""
    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _wanted(links: DataFrame, cfg: AuditConfig) -> DataFrame:
    return links.withColumn("url", normalize_url("url")).where(
        F.col("url").isNotNull() & ~matches_ignore_pattern(F.col("url"), cfg.ignorePatterns))


def new_probe_urls(links: DataFrame, cfg: AuditConfig, delay: str = CAPTURE_DELAY,
                   known: DataFrame | None = None) -> DataFrame:
    """URLs to probe, each once: ``links`` has ``ts`` and ``url``.

    A URL is not offered again while the watermark still remembers it, nor if ``known`` (``url``)
    has its status. ``probe_batches`` forgets none.
    """
    wanted = _wanted(links.select("ts", "url"), cfg)
    if known is not None:
        wanted = wanted.join(known.select("url"), "url", "left_anti")
    return wanted.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def probe_batches(links: DataFrame, cfg: AuditConfig, output: str, checkpoint: str,
                  known: DataFrame | None = None):
    """URLs to probe, each once ever, however far apart its links arrive.

    What was offered is a stored table, a folder per batch, and a batch keeps only what neither an
    earlier one nor ``known`` (``url`` with a status) has. The stream itself has no state, so
    nothing grows in an executor's memory; a replayed batch overwrites its own folder.
    """
    spark = links.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        new = _wanted(batch.select("url"), cfg).distinct()
        if known is not None:
            new = new.join(known.select("url"), "url", "left_anti")
        if batch_id > 0:
            before = spark.read.schema("url string, batch long").parquet(output).where(
                F.col("batch") < batch_id)
            new = new.join(before, "url", "left_anti")
        new.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return per_batch(links, step, checkpoint)


def upsert_batches(changes: DataFrame, output: str, checkpoint: str):
    """Store what each batch changed of an aggregate, in update mode.

    A batch is a folder named by its id, so a replayed batch overwrites itself; ``latest`` reads
    the newest row of each key. Only windows that the watermark keeps open stay in the state
    store, while complete mode would keep and rewrite them all.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (changes.writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(spark: SparkSession, output: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key that ``upsert_batches`` stored."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(output)
    values = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(
        *[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in schema.names])


def heartbeat(pages: DataFrame, window: str = "1 minute", slide: str | None = None,
              delay: str = CAPTURE_DELAY) -> DataFrame:
    """Pages and findings per window, and the rate per minute.

    ``pages`` has ``ts, errors, warnings``. With ``slide`` the windows overlap.
    """
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60
    return pages.withWatermark("ts", delay).groupBy(span.alias("w")).agg(
        F.count("*").alias("pages"), F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pages", "errors", "warnings",
        (F.col("pages") / minutes).alias("pages_per_min"))


def crawl_sessions(log: DataFrame, gap: str = "5 minutes", delay: str = CAPTURE_DELAY) -> DataFrame:
    """Bursts of requests per host, ended by a quiet gap."""
    return log.withWatermark("ts", delay).groupBy(
        "host", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("requests")).select(
        "host", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "requests")


def strike_batches(log: DataFrame, cfg: AuditConfig, output: str, state: str, checkpoint: str,
                   slice_unit: str = SLICE):
    """Back-off per host, batch by batch, with the strikes carried in a small table.

    Each batch runs the sliced batch scan, so a host with most of the refusals is still cut
    into slices; a keyed state store would hand all its rows to one task. Results and state
    are stored per batch id, so a replayed batch overwrites itself.
    """
    spark = log.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{state}/batch={batch_id - 1}")
        target = f"{output}/batch={batch_id}"
        strike_backoff(batch, cfg, slice_unit, before).write.mode("overwrite").parquet(target)
        done = spark.read.parquet(target)
        strike_state(done, before, cfg).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    hits = log.where("status = 429")
    return (hits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def final_captures(attempts: DataFrame, cfg: AuditConfig) -> DataFrame:
    """The fetch that counts of each URL, as soon as it lands: ``url, status, attempts, retried``.

    A fetch that asked for patience counts only when no retry is left; each fetch knows by its
    number how many came before it. So nothing is remembered, also of URLs that never return.
    """
    waits = (F.col("status") == 429) & (F.col("attempt_no") <= cfg.blockedRetries)
    return attempts.where(~waits).select(
        "url", F.col("status").cast("bigint").alias("status"),
        F.col("attempt_no").cast("bigint").alias("attempts"),
        (F.col("attempt_no") - 1).cast("bigint").alias("retried"))
