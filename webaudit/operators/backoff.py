"""Rate-limit audits over a request log.

Both run per host and in time order, and one host may hold a third of the log. So each host is
cut into time slices; slices are scanned in parallel, their small summaries are scanned per
host, and the carried-over state is joined back. The result equals one sequential scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AuditConfig

SLICE = "minute"


def strike_backoff(log: DataFrame, cfg: AuditConfig, slice_unit: str = SLICE,
                   state: DataFrame | None = None) -> DataFrame:
    """Per 429: ``host, ts, event_id, strike, wait_ms, cooldown_until_ms``.

    Strikes count up while refusals keep coming within ``forgetMs``; the wait doubles per
    strike, honours Retry-After, and is capped; a cooldown is never shortened.
    ``log`` has ``host, ts, event_id, status, retry_after_ms``; ``state`` (one row per host,
    from :func:`strike_state`) continues an earlier log.
    """
    hits = (log.where("status = 429")
            .select("host", "ts", "event_id", "retry_after_ms",
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
                    F.date_trunc(slice_unit, F.col("ts")).alias("_slice")))
    forget = cfg.forgetMs * 1000
    in_slice = W.partitionBy("host", "_slice").orderBy("_us", "event_id")
    gap = F.col("_us") - F.lag("_us").over(in_slice)
    inside = hits.withColumn(
        # The first hit of a slice is decided later, against the slice before it.
        "_reset", F.when(gap.isNull(), 0).otherwise((gap >= forget).cast("int"))
    ).withColumn("_epoch", F.sum("_reset").over(in_slice))
    inside = inside.withColumn("_n", F.row_number().over(
        W.partitionBy("host", "_slice", "_epoch").orderBy("_us", "event_id")))

    slices = inside.groupBy("host", "_slice").agg(
        F.min("_us").alias("first_us"), F.max("_us").alias("last_us"),
        F.max("_epoch").alias("resets"),
        F.max_by("_n", F.struct("_us", "event_id")).alias("tail"))
    if state is not None:
        # What came before acts as one more slice, ahead of all others.
        slices = slices.unionByName(state.select(
            "host", F.lit(None).cast("timestamp").alias("_slice"),
            F.col("last_us").alias("first_us"), "last_us", F.lit(1).cast("bigint").alias("resets"),
            F.col("strike").cast("int").alias("tail")))
    by_host = W.partitionBy("host").orderBy(F.asc_nulls_first("_slice"))
    joins = F.coalesce(F.col("first_us") - F.lag("last_us").over(by_host) < forget, F.lit(False))
    # A chain of strikes goes on through slices that join on and hold no reset.
    chained = slices.withColumn("_joins", joins)
    # Strikes carried into a slice = tails of the slices before it back to the chain's start.
    running = by_host.rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(running), F.lit(0))
    start = chained.withColumn("_before", total).withColumn(
        "_chain_base", F.when(~F.col("_joins") | (F.col("resets") > 0), F.col("_before")))
    prior = F.last("_chain_base", ignorenulls=True).over(running)
    carried = start.withColumn(
        "carry", F.when(F.col("_joins"), F.col("_before") - F.coalesce(prior, F.lit(0)))
        .otherwise(0)).select("host", "_slice", "carry")

    strikes = inside.join(carried, ["host", "_slice"]).withColumn(
        "strike", F.col("_n") + F.when(F.col("_epoch") == 0, F.col("carry")).otherwise(0))
    doubled = F.lit(cfg.rateLimitBackoffMs) * F.pow(
        F.lit(2.0), F.least(F.col("strike"), F.lit(60)) - 1)
    wait = F.least(F.greatest(doubled, F.coalesce("retry_after_ms", F.lit(0)).cast("double")),
                   F.lit(cfg.maxRateLimitBackoffMs).cast("double")).cast("bigint")
    timed = strikes.withColumn("wait_ms", wait).withColumn(
        "_until", F.floor(F.col("_us") / 1000) + F.col("wait_ms"))
    # A wait is at most maxRateLimitBackoffMs, so only the maximum so far matters.
    best = timed.groupBy("host", "_slice").agg(F.max("_until").alias("_best"))
    if state is not None:
        best = best.unionByName(state.select(
            "host", F.lit(None).cast("timestamp").alias("_slice"), F.col("until_ms").alias("_best")))
    before = best.withColumn("_carried_until", F.max("_best").over(running)).drop("_best")
    done = timed.join(before, ["host", "_slice"]).withColumn(
        "cooldown_until_ms", F.greatest(F.max("_until").over(in_slice), F.col("_carried_until")))
    return done.select("host", "ts", "event_id", "strike", "wait_ms", "cooldown_until_ms")


def strike_state(strikes: DataFrame, state: DataFrame | None, cfg: AuditConfig) -> DataFrame:
    """Per host what the next batch needs: ``host, strike, last_us, until_ms``.

    A host quiet for ``forgetMs`` before the newest refusal is forgotten; by then neither its
    strikes nor its cooldown could matter.
    """
    now = strikes.groupBy("host").agg(
        F.max_by("strike", F.struct("ts", "event_id")).cast("bigint").alias("strike"),
        F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"),
        F.max("cooldown_until_ms").cast("bigint").alias("until_ms"))
    if state is not None:
        now = now.unionByName(state.join(now, "host", "left_anti"))
    newest = now.agg(F.max("last_us")).scalar()
    return now.where(newest - F.col("last_us") < F.lit(cfg.forgetMs * 1000))


def peak_in_flight(log: DataFrame, slice_unit: str = SLICE) -> DataFrame:
    """``host, peak``: the most requests open at once. ``log`` has ``host, start_ts, end_ts``.

    A request that ends at an instant frees its slot before one that starts then.
    """
    def edge(column: str, delta: int) -> Column:
        return F.struct(F.col(column).alias("ts"), F.lit(delta).alias("delta"))

    edges = log.select("host", F.inline(F.array(edge("start_ts", 1), edge("end_ts", -1))))
    # Equal instants need no order among themselves beyond ends before starts.
    steps = edges.groupBy("host", "ts", "delta").agg(F.sum("delta").alias("step")).withColumn(
        "_slice", F.date_trunc(slice_unit, F.col("ts")))
    in_slice = W.partitionBy("host", "_slice").orderBy("ts", "delta").rowsBetween(
        W.unboundedPreceding, 0)
    slices = steps.withColumn("open", F.sum("step").over(in_slice)).groupBy("host", "_slice").agg(
        F.max("open").alias("high"), F.sum("step").alias("net"))
    carried = F.coalesce(F.sum("net").over(
        W.partitionBy("host").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slices.withColumn("_top", F.col("high") + carried).groupBy("host").agg(
        F.greatest(F.max("_top"), F.lit(0)).alias("peak"))
